"""De-duplication and source resolution on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import dedupe
from parcelwise.plans.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("q_first_wins_dedupe", """
    with r as (select p_name, p_partkey, p_size, p_brand, first_value(p_partkey) over w as kk, first_value(p_size) over w as ks,
                      first_value(p_brand) over w as kb from part window w as (partition by p_name order by p_partkey))
    select p_name, p_partkey, case when p_partkey = kk then 'kept' when p_size = ks and p_brand = kb then 'identical' else 'conflict' end as reason,
           case when p_partkey <> kk then kk end as kept_partkey, case when p_partkey <> kk then ks end as kept_size from r""")
def _(spark, sf):
    p = table(spark, sf, "part")
    kept, dropped = dedupe.first_wins(p, "p_name", "p_partkey", ["p_size", "p_brand"])
    return kept.select("p_name", "p_partkey", F.lit("kept").alias("reason"), F.lit(None).cast("bigint").alias("kept_partkey"),
                       F.lit(None).cast("int").alias("kept_size")).unionByName(
        dropped.select("p_name", "p_partkey", "reason", F.col("kept_p_partkey").alias("kept_partkey"), F.col("kept_p_size").alias("kept_size")))


@R.add("q_priority_dedupe", """
    with r as (select p_name, p_partkey, p_size % 3 as v, case when p_type like 'PROMO%' then 'primary' else 'secondary' end as section from part),
    h as (select p_name, min(p_partkey) as f, min(p_partkey) filter (where section = 'primary') as b from r group by 1),
    k as (select r.*, f, b, (select v from r x where x.p_partkey = f) as fv, (select v from r x where x.p_partkey = b) as bv from r join h using (p_name))
    select p_name, p_partkey, case when p_partkey = coalesce(b, f) then 'kept' when p_partkey = f then 'superseded'
        when v = (case when b is null or p_partkey < b then fv else bv end) then 'identical' else 'conflict' end as outcome,
        case when p_partkey = coalesce(b, f) then null when p_partkey = f then bv when b is null or p_partkey < b then fv else bv end as kept_value
    from k""")
def _(spark, sf):
    p = table(spark, sf, "part").select(
        "p_name", "p_partkey", (F.col("p_size") % 3).alias("v"),
        F.when(F.startswith("p_type", F.lit("PROMO")), "primary").otherwise("secondary").alias("section"))
    return dedupe.prefer_section(p, "p_name", "p_partkey", "v", "section", "primary").select("p_name", "p_partkey", "outcome", "kept_value")


# Two sources per customer: single orders (older) and the monthly roll-up of their lines (newer).
_POOL_SQL = """
    older as (select o_custkey as subject_id, 'o:' || o_orderkey as observation_id, o_orderdate::date as period, o_totalprice as value, 0 as pool, o_orderkey as seq
              from orders where o_custkey is not null),
    newer as (select o_custkey as subject_id, 'n:' || o_orderkey as observation_id,
                     case when o_orderkey % 23 = 0 then null else date_trunc('month', o_orderdate)::date end as period, sum(l_extendedprice::decimal(18,2))::double as value,
                     1 as pool, o_orderkey as seq
              from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 4 <> 1 group by all),
    pooled as (select * from older union all select * from newer),
    ranked as (select *, row_number() over (partition by subject_id order by period desc nulls last, pool desc, seq) as rn,
                      count(*) over (partition by subject_id) as candidates from pooled),
    winners as (select subject_id, observation_id, period, value, case when pool = 1 then 'newer' else 'older' end as source,
                       coalesce(pool = 0 and period < date '2000-06-01', false) as stale, candidates from ranked where rn = 1)"""


def sources(spark, sf) -> tuple[DataFrame, DataFrame]:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    older = o.select(
        F.col("o_custkey").alias("subject_id"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("observation_id"),
        F.col("o_orderdate").cast("date").alias("period"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    lines = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    newer = o.join(lines, o.o_orderkey == lines.l_orderkey).select(
        F.col("o_custkey").alias("subject_id"), F.concat(F.lit("n:"), F.col("o_orderkey").cast("string")).alias("observation_id"),
        F.when(F.col("o_orderkey") % 23 != 0, F.trunc("o_orderdate", "MM")).alias("period"), "value", F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 4 == 1, "LOW").when(F.col("o_orderkey") % 4 == 2, "medium").alias("confidence"))
    return older, newer


def pools(spark, sf) -> DataFrame:
    return dedupe.pool_sources(*sources(spark, sf))


@R.add("q_newest_resolution", f"with {_POOL_SQL} select * from winners")
def _(spark, sf):
    return dedupe.newest(pools(spark, sf), "2000-06-01")


@R.add("q_resolution_history", f"""with {_POOL_SQL}
    select r.subject_id, r.observation_id, r.value, w.observation_id as selected_id from ranked r join winners w using (subject_id) where rn > 1""")
def _(spark, sf):
    pooled = pools(spark, sf)
    return dedupe.history(pooled, dedupe.newest(pooled, "2000-06-01")).select("subject_id", "observation_id", "value", "selected_id")


@R.add("q_vintage_report", f"""with {_POOL_SQL}
    select 'count' as part, 'current' as value, count(*) as n from winners union all select 'count', 'advanced', count(*) from winners where source = 'newer'
    union all select 'count', 'retained', count(*) from winners where source = 'older' union all select 'count', 'stale', count(*) from winners where stale
    union all select 'count', 'older_candidates', count(*) from older
    union all select 'count', 'rejected', count(*) from orders where o_orderkey % 4 = 1 and o_orderkey in (select l_orderkey from lineitem)
    union all select 'source', source, count(*) from winners group by all
    union all select 'period', coalesce(period::varchar, 'UNKNOWN'), count(*) from winners group by all""")
def _(spark, sf):
    older, newer = sources(spark, sf)
    return dedupe.vintage_report(dedupe.newest(dedupe.pool_sources(older, newer), "2000-06-01"), older, newer)


@R.add("q_current_vs_previous", f"""with {_POOL_SQL},
    prev as (select subject_id, arg_max(value, (period, -seq)) as v, arg_max(period, (period, -seq)) as p from pooled
             where pool = 0 and observation_id not in (select observation_id from winners) group by 1)
    select subject_id, value as current_value, period as current_period, coalesce(v, case when source = 'older' then value end) as previous_value,
           coalesce(p, case when source = 'older' then period end) as previous_period from winners left join prev using (subject_id)""")
def _(spark, sf):
    pooled = pools(spark, sf)
    return dedupe.current_and_previous(dedupe.newest(pooled, "2000-06-01"), pooled)


@R.add("q_attribute_merge", """
    with a as (select case when c_custkey % 5 = 0 then -c_custkey else c_custkey end as id, case when c_custkey % 3 = 0 then null else c_name end as name, c_acctbal as units from customer),
         b as (select s_suppkey as id, s_name as name, case when s_suppkey % 2 = 0 then null else s_acctbal end as units, s_suppkey % 4 = 0 as won from supplier)
    select coalesce(a.id, b.id) as id, case when coalesce(won, false) then coalesce(b.name, a.name) else coalesce(a.name, b.name) end as name,
           case when coalesce(won, false) then coalesce(b.units, a.units) else coalesce(a.units, b.units) end as units
    from a full join b on a.id = b.id""")
def _(spark, sf):
    a = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 5 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("units"))
    b = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 != 0, F.col("s_acctbal")).alias("units"))
    won = F.coalesce((F.col("id") % 4 == 0) & (F.col("_b_name").isNotNull()), F.lit(False))
    return dedupe.merge_attributes(a, b, "id", ["name", "units"], won)


@R.add("q_names", """
    select p_partkey, case when s_suppkey is not null then s_name else 'TDS ' || p_partkey end as name,
           case when s_suppkey is not null then 'crosswalk' else 'placeholder' end as name_source
    from part left join (select * from supplier where s_suppkey % 3 <> 0) on p_partkey = s_suppkey""")
def _(spark, sf):
    names = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"))
    return dedupe.assign_names(table(spark, sf, "part").select("p_partkey"), names, "p_partkey", "TDS ")


_OVERLAY_SQL = """
    select p_partkey, case when p_partkey % 10 = 0 then p_type end as source_program,
           case when p_partkey % 10 = 0 then 'CONVERTED' else p_type end as program,
           case when p_partkey % 10 = 0 then case when p_brand = 'Brand#11' then 'Brand#11 | ' || p_name else 'Brand#11 | ' || p_name || ' | ' || p_brand end
                else p_brand end as aliases,
           case when p_partkey % 10 = 0 then date '2024-05-01' end as transition_date from part"""


@R.add("q_overlay", _OVERLAY_SQL)
def _(spark, sf):
    p = table(spark, sf, "part")
    base = p.select("p_partkey", F.col("p_type").alias("program"), F.array("p_brand").alias("aliases"))
    change = p.where("p_partkey % 10 = 0").select(
        "p_partkey", F.lit("CONVERTED").alias("new_program"), F.array(F.lit("Brand#11"), F.col("p_name")).alias("new_aliases"),
        F.lit("2024-05-01").cast("date").alias("effective"))
    once = dedupe.overlay_transitions(base, change, "p_partkey", "program")
    twice = dedupe.overlay_transitions(once, change, "p_partkey", "program")  # idempotent
    return twice.select("p_partkey", "source_program", "program", F.array_join("aliases", " | ").alias("aliases"), "transition_date")


@R.add("q_marked_observations", """
    select o_orderkey, o_custkey, case when o_custkey % 10 = 0 then 'retained_source_not_verified_current' end as evidence_status from orders""")
def _(spark, sf):
    changed = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return dedupe.mark_observations(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), changed, "o_custkey")


@R.add("q_union_first", """
    select o_custkey as key, arg_min(o_orderkey, o_orderkey) filter (where o_orderkey % 3 <> 0) is null as late,
           coalesce(min(o_orderkey) filter (where o_orderkey % 3 <> 0), min(o_orderkey)) as line from orders group by 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    # several orders of one customer in both sources
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("key"), F.lit(False).alias("late"), F.col("o_orderkey").alias("line"))
    b = o.select(F.col("o_custkey").alias("key"), F.lit(True).alias("late"), F.col("o_orderkey").alias("line"))
    return dedupe.union_first([a, b], "key", "line")


@R.add("q_duplicate_review", "select p_name as key, count(*) as n from part group by 1 having count(*) > 1")
def _(spark, sf):
    return dedupe.duplicate_keys(table(spark, sf, "part").select(F.col("p_name").alias("key")), "key")
