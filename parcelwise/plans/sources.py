"""Table shapes of the sources, built as wide text tables from the lines, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import compare
from parcelwise.plans.base import Registry, table
from parcelwise.sources import sinks, tabular

R = Registry()
QUERIES, SQL = R.queries, R.sql

BEDS = (0, 1, 2, 3, 4)


def limits_table(spark, sf) -> DataFrame:
    """One row per supplier with a text column for each of five remainders of the line number; some cells are empty or not numbers."""
    li, s, n, r = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation", "region"))
    per = li.withColumn("bed", (F.col("l_linenumber") - 1) % len(BEDS)).groupBy("l_suppkey").pivot("bed", list(BEDS)).agg((F.max("l_extendedprice") / 8).alias("v"))
    cell = lambda b: F.when(F.col("l_suppkey") % 9 == b, "n/a").otherwise(F.col(str(b)).cast("string"))
    return per.join(s, per.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        (F.col("l_suppkey") * 7).cast("string").alias("ZIP Code"), F.concat(F.lit(" A"), F.col("n_nationkey").cast("string")).alias("HUD Area  Code"),
        F.concat("n_name", F.lit(", "), "r_name", F.lit(" ")).alias("Area Name"), *[cell(b).alias(f"SAFMR {b}BR") for b in BEDS])


_LIMITS = """
    lim as (
      select l_suppkey as k, (l_linenumber - 1) % 5 as bedroom, max(l_extendedprice) / 8 as v from lineitem group by all),
    limits as (
      select case when length((k * 7)::varchar) < 5 then lpad((k * 7)::varchar, 5, '0') else (k * 7)::varchar end as zip, 'A' || n_nationkey as area_code,
             n_name || ', ' || r_name as area_name, bedroom::int as bedroom, round_even(v, 0)::bigint as value
      from lim join supplier on k = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
      where r_name like '%A%' and k % 9 <> bedroom and round_even(v, 0) > 0)"""


def limits(spark, sf) -> DataFrame:
    return tabular.bedroom_limits(limits_table(spark, sf), "ZIP Code", "Area Name", "HUD Area Code", "SAFMR", "A")


@R.add("q_bedroom_limits", f"with {_LIMITS.replace(chr(39) + '%A%' + chr(39), chr(39) + '%' + chr(39))} select * from limits where area_name like '%A%'")
def _(spark, sf):
    return limits(spark, sf)


@R.add("q_bedroom_maps", f"""with {_LIMITS.replace(chr(39) + '%A%' + chr(39), chr(39) + '%' + chr(39))}
    select zip, area_code, string_agg(bedroom || '=' || value, ' ' order by bedroom) as bedrooms from limits where area_name like '%A%' group by all""")
def _(spark, sf):
    pairs = F.transform(F.map_entries("bedrooms"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return tabular.bedroom_maps(limits(spark, sf)).select("zip", "area_code", F.array_join(F.array_sort(pairs), " ").alias("bedrooms"))


@R.add("q_limit_package", f"""with {_LIMITS.replace(chr(39) + '%A%' + chr(39), chr(39) + '%' + chr(39))}
    select zip as key, area_code || '|' || area_name as nested from (select distinct zip, area_code, area_name from limits where area_name like '%A%')""")
def _(spark, sf):
    packed = sinks.package(tabular.bedroom_maps(limits(spark, sf)), "zip", ["area_code", "area_name", "bedrooms"])
    return packed.select("key", F.concat_ws("|", "attributes.area_code", "attributes.area_name").alias("nested"))


# fixed values of these queries: area codes and programs of the program table
_AREAS = {"0": "north", "1": "south", "2": "east", "3": "west"}
_PROGRAMS = {("F", "1-URGENT"): "urgent", ("O", "1-URGENT"): "open_urgent", ("F", "5-LOW"): "low", ("X", "5-LOW"): "never"}


def program_table(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy(
        (F.col("c_nationkey") % 5).cast("string").alias("code"), F.col("o_orderstatus").alias("program"), F.col("o_orderpriority").alias("sub")).agg(
        F.count("*").alias("units"), F.max("o_totalprice").alias("rent"))
    cells = rows.select("code", "program", "sub", F.when(F.col("units") % 3 == 0, -4).otherwise(F.col("units")).cast("string").alias("units"),
                        F.when(F.col("units") % 4 == 0, "missing").otherwise(F.col("rent").cast("string")).alias("rent"))
    return cells.unionByName(cells.where("code = '2' and program = 'F' and sub = '5-LOW'"))


_PROGRAM_SQL = """
    p0 as (select (c_nationkey % 5)::varchar as code, o_orderstatus as program, o_orderpriority as sub, count(*) as units, max(o_totalprice) as rent
           from orders join customer on o_custkey = c_custkey group by all),
    p1 as (select * from p0 union all select * from p0 where code = '2' and program = 'F' and sub = '5-LOW'),
    p2 as (select case code when '0' then 'north' when '1' then 'south' when '2' then 'east' when '3' then 'west' end as geography_id,
                  case program || sub when 'F1-URGENT' then 'urgent' when 'O1-URGENT' then 'open_urgent' when 'F5-LOW' then 'low' end as program_id, units, rent from p1),
    prog as (select geography_id, program_id, statistic, source_value, case when source_value >= 0 then source_value end as value,
                    case when coalesce(source_value < 0, true) then 'missing or suppressed code' end as unavailable_reason
             from (select geography_id, program_id, 'units' as statistic, case when units % 3 = 0 then -4 else units end::double as source_value from p2
                   union all select geography_id, program_id, 'rent', case when units % 4 <> 0 then rent end from p2)
             where geography_id is not null and program_id is not null)"""


def programs(spark, sf) -> DataFrame:
    return tabular.program_rows(program_table(spark, sf), "code", _AREAS, _PROGRAMS, ("program", "sub"), ["units", "rent"])


@R.add("q_program_table", f"with {_PROGRAM_SQL} select * from prog")
def _(spark, sf):
    return programs(spark, sf)


@R.add("q_program_problems", f"""with {_PROGRAM_SQL}, want as (
      select g as geography_id, p as program_id from (select unnest(['north','south','east','west']) as g), (select unnest(['urgent','open_urgent','low','never']) as p)),
    n as (select geography_id, program_id, count(*) as n from prog where statistic = 'units' group by all)
    select geography_id, program_id, case when n > 1 then 'duplicate geographic program' else 'missing geographic program' end as problem
    from want left join n using (geography_id, program_id) where n > 1 or n is null""")
def _(spark, sf):
    return tabular.program_problems(programs(spark, sf), _AREAS, _PROGRAMS, ["units", "rent"])


_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]


@R.add("q_market_series", """
    with m as (select n_name as "areaName", r_name as "areaType", strftime(o_orderdate, '%Y-%m') as period, max(o_totalprice) as v
               from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all),
    k as (select distinct "areaName", "areaType" from m),
    p as (select strftime(unnest(generate_series(date '1996-01-01', date '2001-12-01', interval 1 month)), '%Y-%m') as period)
    select "areaName", "areaType", period, v as value from k cross join p left join m using ("areaName", "areaType", period) where "areaType" in ('ASIA', 'EUROPE', 'AFRICA')""")
def _(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    wide = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).withColumn(
        "month", F.date_format("o_orderdate", "yyyy-MM")).groupBy(F.col("n_name").alias("areaName"), F.col("r_name").alias("areaType")).pivot("month", _MONTHS).agg(F.max("o_totalprice"))
    text = wide.select("areaName", "areaType", *[F.coalesce(F.col(f"`{m}`").cast("string"), F.lit("")).alias(m) for m in _MONTHS])
    return tabular.wide_market_series(text, ["ASIA", "EUROPE", "AFRICA"], "1996-01")


@R.add("q_metro_rows", """
    select s_suppkey, n_name as "Metro" from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where r_name = 'AMERICA' and n_name like '%A%'""")
def _(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "s_suppkey", F.concat(F.lit(" "), "r_name").alias("State"), F.col("n_name").alias("Metro"))
    return tabular.metro_rows(rows, "AMERICA", "A").select("s_suppkey", "Metro")


@R.add("q_bedroom_observations", """
    select l_suppkey as area_id, ((l_linenumber - 1) % 5)::int as m_bedroom, max(l_extendedprice) as m_value from lineitem group by all""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("bed", (F.col("l_linenumber") - 1) % len(BEDS))
    wide = li.groupBy(F.col("l_suppkey").alias("area_id")).pivot("bed", list(BEDS)).agg(F.max("l_extendedprice"))
    wide = wide.select("area_id", *[F.col(str(b)).alias(f"b{b}") for b in BEDS])
    return compare.observation_rows(wide, "area_id", {b: f"b{b}" for b in BEDS}).select("area_id", "m_bedroom", "m_value")
