"""Typed ingest on raw texts that the queries derive from the driver tables, with bad tokens injected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import arrays, rules, typed
from parcelwise.operators import checks, ingest
from parcelwise.plans.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

# The raw table in SQL; ``raw`` below derives the same strings in Spark.
RAW_SQL = """
    select c_custkey as row_id,
      case when c_custkey % 19 = 0 then ' N/A ' when c_custkey % 53 = 0 then 'not money' when c_custkey % 59 = 0 then '-5'
           when c_custkey % 61 = 0 then '$1,2,3'
           else ' $' || cast(c_custkey % 7000 as varchar(20)) || '.50' end as rent_raw,
      case when c_custkey % 29 = 0 then 'null' else concat('00', cast(c_custkey % 400 as varchar(20)), case when c_custkey % 2 = 0 then '.0' else '' end) end as key_raw,
      case when c_custkey % 31 = 0 then '13/45/2025' when c_custkey % 37 = 0 then '' when c_custkey % 2 = 0 then '1/5/2025'
           else '2025-01-01T00:00:00' end as date_raw,
      case when c_custkey % 41 = 0 then '  ' else concat('  ', c_name, '   x ') end as name_raw,
      case when c_custkey % 43 = 0 then '1.5' when c_custkey % 3 = 0 then '1,234.0' else cast(c_custkey as varchar(20)) end as units_raw,
      case when c_custkey % 47 = 0 then 'abc' else concat(cast(c_custkey % 100 as varchar(20)), '.25%') end as share_raw,
      case when c_custkey % 5 = 0 then 'queens' when c_custkey % 5 = 1 then ' Bronx ' else 'elsewhere' end as borough_raw,
      case when c_custkey % 3 = 0 then cast(c_custkey as varchar(20)) when c_custkey % 3 = 1 then concat('zip 1', cast(10000 + c_custkey as varchar(20)))
           else 'none' end as zip_raw
    from customer"""

FIELDS = {
    "name": ("name", "name_raw"), "key": ("id", "key_raw"), "as_of": ("date", "date_raw"), "value": ("money", "rent_raw"),
    "units": ("whole", "units_raw"), "share": ("number", "share_raw"), "zip": ("zip", "zip_raw"),
}
BOROUGHS = {"MANHATTAN": "MN", "BRONX": "BX", "BROOKLYN": "BK", "QUEENS": "QN", "STATEN ISLAND": "SI"}


def raw(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    num = k.cast("string")
    return table(spark, sf, "customer").select(
        k.alias("row_id"),
        F.when(k % 19 == 0, " N/A ").when(k % 53 == 0, "not money").when(k % 59 == 0, "-5").when(k % 61 == 0, "$1,2,3")
        .otherwise(F.concat(F.lit(" $"), (k % 7000).cast("string"), F.lit(".50"))).alias("rent_raw"),
        F.when(k % 29 == 0, "null").otherwise(F.concat(F.lit("00"), (k % 400).cast("string"), F.when(k % 2 == 0, ".0").otherwise("")))
        .alias("key_raw"),
        F.when(k % 31 == 0, "13/45/2025").when(k % 37 == 0, "").when(k % 2 == 0, "1/5/2025").otherwise("2025-01-01T00:00:00")
        .alias("date_raw"),
        F.when(k % 41 == 0, "  ").otherwise(F.concat(F.lit("  "), "c_name", F.lit("   x "))).alias("name_raw"),
        F.when(k % 43 == 0, "1.5").when(k % 3 == 0, "1,234.0").otherwise(num).alias("units_raw"),
        F.when(k % 47 == 0, "abc").otherwise(F.concat((k % 100).cast("string"), F.lit(".25%"))).alias("share_raw"),
        F.when(k % 5 == 0, "queens").when(k % 5 == 1, " Bronx ").otherwise("elsewhere").alias("borough_raw"),
        F.when(k % 3 == 0, num).when(k % 3 == 1, F.concat(F.lit("zip 1"), (k + 10000).cast("string"))).otherwise("none").alias("zip_raw"),
    )


def flagged(spark, sf) -> DataFrame:
    df = ingest.type_columns(raw(spark, sf), FIELDS).withColumn("borough", typed.code_of(F.col("borough_raw"), BOROUGHS))
    return df.withColumn("reason", ingest.row_reason("name", "key", "as_of", "value", 1.0, 5000.0))


_TYPED = f"""
    raw as ({RAW_SQL}),
    t as (
      select row_id, rent_raw, key_raw, date_raw, name_raw,
        case when row_id % 41 <> 0 then trim(regexp_replace(name_raw, '\\s+', ' ', 'g')) end as name,
        case when row_id % 29 <> 0 then (row_id % 400)::varchar end as key,
        case when row_id % 31 = 0 or row_id % 37 = 0 then null when row_id % 2 = 0 then date '2025-01-05' else date '2025-01-01' end as as_of,
        case when row_id % 19 = 0 or row_id % 53 = 0 then null when row_id % 59 = 0 then -5 when row_id % 61 = 0 then null
             else row_id % 7000 + 0.5 end::double as value,
        case when row_id % 43 = 0 then null when row_id % 3 = 0 then 1234 else row_id end as units,
        case when row_id % 47 <> 0 then row_id % 100 + 0.25 end::double as share,
        case when row_id % 5 = 0 then 'QN' when row_id % 5 = 1 then 'BX' end as borough,
        case when row_id % 3 = 0 then lpad(row_id::varchar, greatest(5, length(row_id::varchar))::int, '0')
             when row_id % 3 = 1 then substr('1' || (10000 + row_id)::varchar, 1, 5) end as zip,
        case when row_id % 31 = 0 then 'as_of' when row_id % 19 <> 0 and (row_id % 53 = 0 or (row_id % 59 <> 0 and row_id % 61 = 0)) then 'value'
             when row_id % 43 = 0 then 'units' when row_id % 47 = 0 then 'share' end as bad
      from raw),
    f as (
      select *, case when bad is not null then 'parse_error: ' || bad when name is null then 'missing_name' when key is null then 'missing_key'
          when as_of is null then 'missing_date' when value is null then 'missing_value' when value <= 0 then 'non_positive_value'
          when value not between 1 and 5000 then 'value_out_of_band' end as reason
      from t)"""


@R.add("q_typed_ingest", f"with {_TYPED} select row_id, name, key, as_of, value, units, share, borough, zip from f where reason is null")
def _(spark, sf):
    return flagged(spark, sf).where("reason is null").select("row_id", "name", "key", "as_of", "value", "units", "share", "borough", "zip")


@R.add("q_quarantine", f"""with {_TYPED}
    select row_id, reason, rent_raw, key_raw, date_raw, name_raw from f where reason is not null""")
def _(spark, sf):
    q = ingest.quarantine_rows(flagged(spark, sf), "row_id", ["rent_raw", "key_raw", "date_raw", "name_raw"])
    return q.select("row_id", "reason", *[F.col("fields")[c].alias(c) for c in ("rent_raw", "key_raw", "date_raw", "name_raw")])


@R.add("q_subject_observation_split", f"""with {_TYPED}
    select 'subject' as part, 'dev:' || key as id, count(*) as n from f where reason is null group by all
    union all select 'observation', 'dev:' || key || ':avg-gross-rent:' || strftime(as_of, '%Y-%m-%d'), count(*) from f where reason is null group by all""")
def _(spark, sf):
    valid = flagged(spark, sf).where("reason is null").select(
        typed.joined_id("dev:", F.col("key")).alias("development_id"), "name", "borough", "value",
        typed.joined_id("dev:", F.col("key"), ":avg-gross-rent:", F.date_format("as_of", "yyyy-MM-dd")).alias("observation_id"))
    s, o = ingest.subject_and_observation(valid, ["development_id", "name", "borough"], ["observation_id", "development_id", "value"])
    return (s.groupBy(F.lit("subject").alias("part"), F.col("development_id").alias("id")).agg(F.count("*").alias("n"))
            .unionByName(o.groupBy(F.lit("observation").alias("part"), F.col("observation_id").alias("id")).agg(F.count("*").alias("n"))))


@R.add("q_source_health", f"""with {_TYPED}
    select count(*) as raw, count(*) filter (where reason is null) as valid, count(*) filter (where reason is not null) as quarantined,
           count(*) filter (where reason is null)::double / count(*) as valid_share from f""")
def _(spark, sf):
    return ingest.source_health(flagged(spark, sf))


@R.add("q_distributions", f"""with {_TYPED}
    select 'reason' as field, coalesce(reason, 'UNKNOWN') as value, count(*) as n from f group by all
    union all select 'borough', coalesce(borough, 'UNKNOWN'), count(*) from f group by all
    union all select 'as_of', coalesce(strftime(as_of, '%Y-%m-%d'), 'UNKNOWN'), count(*) from f group by all""")
def _(spark, sf):
    return ingest.distributions(flagged(spark, sf), ["reason", "borough", "as_of"])


@R.add("q_coverage", f"""with {_TYPED}
    select count(*) filter (where value is not null) as with_value, count(*) filter (where reason is null) as valid,
           count(*) filter (where borough is null) as without_borough, count(*) filter (where value > 1000) as high from f""")
def _(spark, sf):
    return ingest.coverage(flagged(spark, sf), {
        "with_value": F.col("value").isNotNull(), "valid": F.col("reason").isNull(), "without_borough": F.col("borough").isNull(),
        "high": F.col("value") > 1000})


# fixed values of this query: required columns and row-count bands
_BANDS = {"customer": (["c_custkey", "c_name"], 1, 10**15), "orders": (["o_orderkey", "o_missing"], 1, 10**15), "region": (["r_name"], 6, 10)}


@R.add("q_schema_gate", """
    select 'customer' as "table", '' as missing, count(*) as n, count(*) >= 1 as ok from customer
    union all select 'orders', 'o_missing', count(*), false from orders
    union all select 'region', '', count(*), count(*) between 6 and 10 from region""")
def _(spark, sf):
    parts = [checks.schema_gate(table(spark, sf, t), t, need, lo, hi) for t, (need, lo, hi) in _BANDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("q_completeness_gate", """
    select r.r_name, s.seg from region r, (select distinct c_mktsegment as seg from customer) s
    where not exists (select 1 from customer join nation on c_nationkey = n_nationkey
                      where n_regionkey = r.r_regionkey and c_mktsegment = s.seg and c_custkey % 10 = 7)
    union all select 'ATLANTIS', 'BUILDING'""")
def _(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    want = r.select("r_name", F.explode(F.lit(segs)).alias("seg")).unionByName(
        spark.createDataFrame([("ATLANTIS", "BUILDING")], "r_name string, seg string"))
    have = c.where("c_custkey % 10 = 7").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "r_name", F.col("c_mktsegment").alias("seg")).distinct()
    return checks.completeness(want, have, ["r_name", "seg"])


@R.add("q_relation_gate", """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem
    where not abs(l_extendedprice - round(l_extendedprice * l_discount, 2) - (l_extendedprice * (1 - l_discount) + case when l_partkey % 10 = 0 then l_linenumber else 0 end)) <= 3
       or l_quantity > 49""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    # the net part of every tenth part number is off by the line number
    net = p * (1 - d) + F.when(F.col("l_partkey") % 10 == 0, F.col("l_linenumber")).otherwise(0)
    return checks.relation_breaks(li, p, [F.round(p * d, 2), net], 3, F.col("l_quantity") <= 49).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@R.add("q_usable_values", """
    select count(*) as n, count(*) filter (where v > 0 and w > 0) as usable, count(*) filter (where coalesce(not w > 0, true)) as bad_weight,
           sum(case when w > 0 then w end)::bigint as weight
    from (select case when o_orderkey % 7 = 0 then null else o_totalprice end as v,
                 case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then 0 else o_orderkey % 5 end as w from orders)""")
def _(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        F.when(k % 7 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("v"),
        F.when(k % 11 == 0, "x").when(k % 13 == 0, "0").otherwise((k % 5).cast("string")).alias("w"))
    v, w = typed.finite(F.col("v")), typed.finite(F.col("w"))
    return o.agg(F.count("*").alias("n"), F.count_if((v > 0) & (w > 0)).alias("usable"),
                 F.count_if(~F.coalesce(w > 0, F.lit(False))).alias("bad_weight"),
                 F.sum(F.when(w > 0, w)).cast("bigint").alias("weight"))


@R.add("q_buckets", """
    select case when v between 1 and 13 then case when v < 4 then v::varchar else '4+' end end as bucket, count(*) as n
    from (select l_orderkey, count(*) as v from lineitem group by 1) group by 1""")
def _(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("v"))
    return v.groupBy(typed.size_bucket(F.col("v"), 1, 13).alias("bucket")).agg(F.count("*").alias("n"))


@R.add("q_labels", """
    select c_custkey, 'cust:' || c_custkey || ':' || c_nationkey as id, lpad((c_nationkey)::varchar, 2, '0') as code,
           case c_custkey % 4 when 1 then 'yes' when 2 then 'no' when 3 then 'not_applicable' else 'unknown' end as answer,
           case c_custkey % 6 when 0 then 'Market Studio (HUD)' when 1 then 'Market 2BR (HUD)' when 2 then 'Market all-units (ZORI)'
                when 3 then 'Market (RentHop)' when 4 then 'Market 4BR' else 'Market all-units' end as label,
           case c_custkey % 6 when 0 then 'measured (regulatory benchmark)' when 1 then 'measured (regulatory benchmark)'
                when 2 then 'measured (observed-rent index)' when 3 then 'measured (listing median)' when 4 then 'measured' else 'unknown' end as measured,
           case c_custkey % 3 when 0 then 'hud_safmr' when 1 then 'zori' end as inferred
    from customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    m = k % 6
    basis = F.when(m <= 1, "regulatory_market_benchmark").when(m == 2, "index").when(m == 3, "asking")
    source = F.when(m == 3, "renthop")
    bedroom = F.when(m == 0, 0).when(m == 1, 2).when(m == 4, 4)
    scope = F.when(m == 5, "all_units")
    art = F.lit("").cast("string")
    cid = F.when(k % 3 == 0, "x__hud-safmr:1").when(k % 3 == 1, "x__zori:2").otherwise("x")
    code = F.when(k % 4 == 1, "1").when(k % 4 == 2, "2").when(k % 4 == 3, "-2").otherwise("7")
    return table(spark, sf, "customer").select(
        "c_custkey", typed.joined_id("cust:", k, ":", F.col("c_nationkey")).alias("id"),
        typed.padded_code(F.col("c_nationkey").cast("string")).alias("code"), typed.answer(code).alias("answer"),
        rules.market_label(basis, source, art, bedroom, scope).alias("label"),
        rules.measured_label(m != 5, basis).alias("measured"), rules.source_from_id(cid).alias("inferred"))


@R.add("q_text_integers", """
    select s_suppkey, s_suppkey + 1000000 as first, s_suppkey % 50 as last, 2 as n from supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    line = F.concat(F.lit("Cases "), F.format_number(k + 1000000, 0), F.lit(" at 12.5 and 7% until "), (k % 50).cast("string"))
    ints = typed.integers(line)
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.get(ints, 0).alias("first"), F.element_at(ints, -1).alias("last"), F.size(ints).alias("n"))


@R.add("q_reason_lists", """
    select p_partkey, case when p_size % 2 = 0 then 'small | big' else 'big' end as merged,
           'Periods differ' || case when p_size % 3 = 0 then ' | other reason' else '' end as folded from part""")
def _(spark, sf):
    s = F.col("p_size")
    first = arrays.when_list((s % 2 == 0, "small"), (s > 0, "big"))
    folded = arrays.fold_reasons(F.array(F.lit("Periods differ"), F.lit("periods   DIFFER"), F.lit(" "),
                                         F.when(s % 3 == 0, "other reason").otherwise("")))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(arrays.add_reasons(first, F.array(F.lit("big"))), " | ").alias("merged"),
        F.array_join(folded, " | ").alias("folded"))
