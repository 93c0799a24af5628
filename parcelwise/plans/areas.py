"""Fixed-shape joins: crosswalks, reconciliation, semi and anti joins, lookups, program rows, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.operators import checks, joins, scenario
from parcelwise.plans.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("q_strict_join", "select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def _(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined, _problems = checks.strict_join(lab, d.select("doc_id", "lang"), "doc_id", ["lang"])
    return joined.select("doc_id", "lang", "quality", "toxic")


@R.add("q_strict_join_problems", """
    select doc_id::varchar as key, 'left_unmatched' as problem from documents where doc_id not in (select doc_id from labels) and doc_id % 50 <> 0
    union all select '', 'left_duplicate_or_blank' from documents where doc_id % 50 = 0 having count(*) > 0
    union all select doc_id::varchar, 'right_duplicate_or_blank' from labels where doc_id % 20 = 0""")
def _(spark, sf):
    # every fiftieth document loses its key and every twentieth label occurs twice
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("key"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"), "quality", "doc_id")
    twice = lab.unionByName(lab.where("doc_id % 20 = 0")).drop("doc_id")
    _joined, problems = checks.strict_join(d, twice, "key", ["quality"])
    return problems


@R.add("q_crosswalk_join", """
    select s_suppkey, case when s_suppkey % 4 = 0 then case when s_suppkey % 3 = 0 then 'own' end when n_name is not null and n_regionkey < 3 then n_name
        when s_suppkey % 3 = 0 then 'own' end as label, case when n_regionkey < 3 and s_suppkey % 4 <> 0 then 'crosswalk' else 'feature' end as join_method
    from supplier join nation on s_nationkey = n_nationkey""")
def _(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    feats = s.select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, -1).otherwise(F.col("s_nationkey")).alias("k"),
                     F.when(F.col("s_suppkey") % 3 == 0, "own").otherwise("").alias("label"))
    attrs = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"))
    return joins.crosswalk(feats, attrs, "k", ["label"]).select("s_suppkey", "label", "join_method")


@R.add("q_crosswalk_scan", """
    select trim(c_mktsegment) as seg, arg_max(c_name, c_custkey) as name from customer where c_mktsegment <> 'BUILDING' group by 1""")
def _(spark, sf):
    from parcelwise.sources.tabular import read_crosswalk
    c = table(spark, sf, "customer").select(
        F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("seg"),
        F.concat("c_name", F.lit(" ")).alias("name"), "c_custkey")
    return read_crosswalk(c, "seg", ["name"], F.col("c_custkey"))


@R.add("q_reconcile", """
    select coalesce(a.k, b.k) as k, case when a.k is not null and b.k is not null then 'matched' when a.k is not null then 'left_only' else 'right_only' end as status
    from (select distinct case when o_custkey % 3 = 0 then -o_custkey else o_custkey end as k from orders) a
    full join (select case when c_custkey % 5 = 0 then -7 * c_custkey else c_custkey end as k from customer) b on a.k = b.k""")
def _(spark, sf):
    a = table(spark, sf, "orders").selectExpr("case when o_custkey % 3 = 0 then -o_custkey else o_custkey end as k")
    b = table(spark, sf, "customer").selectExpr("case when c_custkey % 5 = 0 then -7 * c_custkey else c_custkey end as k")
    return joins.reconcile(a, b, "k")


@R.add("q_area_left_join", """
    select n_nationkey, n_name, value, value is null as missing from nation
    left join (select s_nationkey as n_nationkey, max(s_acctbal) as value from supplier where s_nationkey % 4 <> 0 group by 1) using (n_nationkey)""")
def _(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    v = s.where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("value"))
    return joins.keep_areas(n.select("n_nationkey", "n_name"), v, "n_nationkey", "value")


@R.add("q_area_counts", """
    select count(*) filter (where v is not null) as matched, count(*) filter (where v is null) as missing from nation
    left join (select distinct s_nationkey as v from supplier where s_nationkey % 4 <> 0) on n_nationkey = v""")
def _(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    v = s.where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("value"))
    return joins.keep_areas(n, v, "n_nationkey", "value").agg(F.count_if(~F.col("missing")).alias("matched"), F.count_if("missing").alias("missing"))


@R.add("q_semi", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R' and l_quantity > 45)")
def _(spark, sf):
    used = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(used, "o_orderkey", "left_semi").select("o_orderkey")


@R.add("q_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def _(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@R.add("q_key_lookup", "select n_nationkey, n_name from nation where n_nationkey = 7 or lower(n_name) like '%united%'")
def _(spark, sf):
    n = table(spark, sf, "nation")
    return n.where((F.col("n_nationkey") == 7) | F.lower("n_name").contains("united")).select("n_nationkey", "n_name")


# Program rows: event counts per (program, area, day); area is a user group, "all" or "total".
_PROGRAMS = """
    prog as (select event_type as program, case user_id % 4 when 0 then 'north' when 1 then 'south' when 2 then 'nyc' else 'program_total' end as geo,
                    strftime(ts, '%Y-%m-%d') as period, case when extract(day from ts) % 7 = 0 then null else count(*) end as value from events group by 1, 2, 3, ts::date, extract(day from ts))"""


def programs(spark, sf):
    u = F.col("user_id") % 4
    geo = F.when(u == 0, "north").when(u == 1, "south").when(u == 2, "nyc").otherwise("program_total")
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("program"), geo.alias("geo"), F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return e.select("program", "geo", F.date_format("d", "yyyy-MM-dd").alias("period"), F.when(F.day("d") % 7 != 0, F.col("n")).alias("value"))


@R.add("q_program_rows", f"with {_PROGRAMS} select program, geo, period, value from prog where geo in ('north', 'nyc', 'program_total')")
def _(spark, sf):
    return programs(spark, sf).where(F.col("geo").isin("north", "nyc", "program_total"))


@R.add("q_headline", f"""with {_PROGRAMS}
    select program, geo, period, value from prog where geo in ('north', 'nyc', 'program_total') and value is not null
    qualify row_number() over (partition by program order by period desc, case when geo = 'north' then 0 else 1 end, geo) = 1""")
def _(spark, sf):
    rows = programs(spark, sf).where(F.col("geo").isin("north", "nyc", "program_total") & F.col("value").isNotNull())
    return joins.first_per_key(rows, ["program"], F.desc("period"), (F.col("geo") == "north").desc(), F.col("geo"))


@R.add("q_scenario_sweep", """
    with p as (select n_nationkey, count(*)::double as eligible, sum(c_acctbal::decimal(18,2))::double as stock from customer join nation on c_nationkey = n_nationkey group by 1),
    s as (select * from p, (select unnest([0.25, 0.5, 1.5]::double[]) as take_up), (select unnest([0.0, 1.0]::double[]) as supply_elasticity))
    select n_nationkey, take_up, supply_elasticity,
      case when n_nationkey % 6 = 0 then 'source_missing' when take_up > 1 then 'fraction_out_of_range' when stock <= 0 then 'invalid_stock_horizon_or_elasticity' end as reason,
      case when n_nationkey % 6 <> 0 and take_up <= 1 and stock > 0 then round(100.0 * (eligible * take_up * 0.2 / stock) / (supply_elasticity + 0.5), 10) end as percent_change from s""")
def _(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    base = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_nationkey").agg(
        F.count("*").cast("double").alias("eligible"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("stock"))
    src = F.when(F.col("n_nationkey") % 6 == 0, F.lit([*["table"] * 6, " "])).otherwise(F.lit(["table"] * 7))
    params = base.withColumn("take_up", F.explode(F.lit([0.25, 0.5, 1.5]))).withColumn("supply_elasticity", F.explode(F.lit([0.0, 1.0]))).select(
        "*", F.lit(0.2).alias("incremental"), F.lit(0.5).alias("demand_elasticity"), F.lit(12).alias("horizon_months"), src.alias("sources"))
    return scenario.scenarios(params).select("n_nationkey", "take_up", "supply_elasticity", "reason", F.round("percent_change", 10).alias("percent_change"))
