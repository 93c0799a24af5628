"""Monthly series: orders pivoted to one column per month and back."""

from __future__ import annotations

import calendar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import joins, series
from parcelwise.plans.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

MONTHS = [f"{y}-{m:02d}-{calendar.monthrange(y, m)[1]:02d}" for y in range(1995, 2002) for m in range(1, 13) if y < 2001 or m <= 8]


def wide(spark, sf) -> DataFrame:
    """One row per key with one column per month end; early months of some keys and the newest of others are empty."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    df = o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 20).cast("string")).alias("key"), (F.col("c_custkey") % 20).alias("k"),
        F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd").alias("month"), "o_totalprice")
    df = df.where("not (k % 3 = 0 and month >= '2001-06-01')")
    return df.groupBy("key").pivot("month", MONTHS).agg(F.max("o_totalprice"))


_LONG = """
    long as (select c_mktsegment || '-' || (c_custkey % 20) as key, last_day(o_orderdate)::date as month, max(o_totalprice) as value
             from orders join customer on o_custkey = c_custkey
             where not (c_custkey % 20 % 3 = 0 and last_day(o_orderdate) >= date '2001-06-01') group by all),
    latest as (select key, round_even(arg_max(value, month), 2) as latest_value, max(month) as latest_month, date_trunc('month', max(month))::date as period_start from long group by 1),
    modal as (select latest_month, count(*) as n from latest group by 1 order by n desc, latest_month desc limit 1)"""


def long(spark, sf) -> DataFrame:
    return series.to_long(wide(spark, sf), ["key"])


@R.add("q_unpivot_series", f"with {_LONG} select * from long")
def _(spark, sf):
    return long(spark, sf)


@R.add("q_latest_value", f"with {_LONG} select * from latest")
def _(spark, sf):
    return series.latest(long(spark, sf), ["key"])


@R.add("q_history", f"""with {_LONG}
    select key, count(*) as months, string_agg(strftime(month, '%Y-%m-%d'), ' ' order by month) as listed, sum(round_even(value, 2)::decimal(18,2))::double as total
    from long where month >= date '2001-03-31' group by 1""")
def _(spark, sf):
    h = series.history(long(spark, sf), ["key"], MONTHS[-6:])
    cents = F.aggregate(F.map_values("history"), F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x.cast("decimal(18,2)")).cast("decimal(28,2)"))
    return h.select("key", F.size("history").cast("bigint").alias("months"), F.array_join(F.map_keys("history"), " ").alias("listed"),
                    cents.cast("double").alias("total"))


@R.add("q_modal_month", f"with {_LONG} select * from modal")
def _(spark, sf):
    return series.modal_month(series.latest(long(spark, sf), ["key"]))


@R.add("q_lag", f"with {_LONG} select latest_month, date '2001-09-11' - latest_month as lag_days, date '2001-09-11' - latest_month > 30 as flagged from modal")
def _(spark, sf):
    lag = series.lag_days(F.col("latest_month"), F.lit("2001-09-11").cast("date")).cast("bigint")
    return series.modal_month(series.latest(long(spark, sf), ["key"])).select("latest_month", lag.alias("lag_days"), (lag > 30).alias("flagged"))


@R.add("q_series_areas", f"""with {_LONG}, areas as (select distinct c_mktsegment || '-' || (c_custkey % 25) as key from customer)
    select key, latest_value, latest_value is null as missing, coalesce(l.latest_month, (select latest_month from modal)) as current_month
    from areas left join latest l using (key)""")
def _(spark, sf):
    areas = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 25).cast("string")).alias("key")).distinct()
    return series.areas_with_series(areas, series.latest(long(spark, sf), ["key"]), "key").select("key", "latest_value", "missing", "current_month")


@R.add("q_series_observations", f"""with {_LONG}
    select 'zori:zip:' || key || ':' || strftime(latest_month, '%Y-%m') || ':all_units' as m_id, 'zcta:' || key as area_id, period_start as m_period, latest_value as m_value,
           'zcta:' || key || ':2020' as geometry_id from latest""")
def _(spark, sf):
    latest = series.latest(long(spark, sf), ["key"])
    obs = series.observation_rows(latest, "key", "zori:zip:").select("m_id", "area_id", "m_period", "m_value")
    areas = series.area_rows(latest, "key", "2020").select(F.col("market_area_id").alias("area_id"), "geometry_id")
    return obs.join(areas, "area_id")


@R.add("q_first_observation", """
    select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1""")
def _(spark, sf):
    return joins.first_per_key(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@R.add("q_nested_series", f"""with {_LONG} select key, count(*) as n, min(month) as first_month, arg_max(value, month) as last_value from long group by 1""")
def _(spark, sf):
    n = series.nested(long(spark, sf), ["key"], "month")
    last = F.element_at("observations", -1)
    return n.select("key", F.size("observations").cast("bigint").alias("n"), F.get("observations", 0)["period"].alias("first_month"),
                    last["value"].alias("last_value"))
