"""Survey statistics on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import rules, typed
from parcelwise.operators import cells as cel
from parcelwise.operators import checks, gaps
from parcelwise.operators import median as med
from parcelwise.plans.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

N_REPS = 80
CELL_REPS = 16


def median_sql(src: str, by: str, v: str = "v", w: str = "w", midpoint: bool = True) -> str:
    """Weighted median in SQL over a subquery with the columns of ``by``, v and w."""
    at = f"case when cum * 2 = tot and nx is not null then ({v} + nx) / 2 else {v} end" if midpoint else v
    return f"""
      select {by}, arg_min({at}, {v}) filter (where cum * 2 >= tot) as m
      from (select *, sum({w}) over (partition by {by} order by {v}) as cum, sum({w}) over (partition by {by}) as tot,
                   lead({v}) over (partition by {by} order by {v}) as nx
            from (select {by}, {v}, sum({w}) as {w} from ({src}) where {w} > 0 group by all))
      group by {by}"""


def replicate_weights(weight, a, b, n: int):
    """Derived whole replicate weights: the weight times 0, 1 or 2 by key arithmetic."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: weight * (((a * (2 * i + 1) + b * i) % 7) % 3))


def numbered_weights(weight, a, b):
    """The same weights by their number."""
    return lambda i: weight * (((a * (2 * i + 1) + b * i) % 7) % 3)


def replicate_sql(weight: str, a: str, b: str, i: str = "r") -> str:
    return f"{weight} * ((({a} * (2 * {i} + 1) + {b} * {i}) % 7) % 3)"


UNC_SQL = """
      select {by}, p as point, {n} as replicates_used, var as variance, sqrt(var) as standard_error,
             1.96 * sqrt(var) as margin_of_error, p - 1.96 * sqrt(var) as ci_lower, p + 1.96 * sqrt(var) as ci_upper,
             sqrt(var) / p as cv
      from (select {by}, p, 0.05 * sum((m - p) * (m - p)) filter (where r > 0) as var
            from (select *, max(m) filter (where r = 0) over (partition by {by}) as p from ({meds})) group by all)"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


# ---- weighted medians --------------------------------------------------------------------------------


@R.add("q_weighted_median_groups", median_sql(
    "select l_returnflag, l_linestatus, l_extendedprice as v, l_quantity::bigint as w from lineitem",
    "l_returnflag, l_linestatus").replace("as m\n", "as median\n"))
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return med.weighted_median(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", kind=med.WHOLE)


@R.add("q_weighted_median_fractional", median_sql(
    """select l_shipmode_key, l_extendedprice as v, w from (
         select l_suppkey % 20 as l_shipmode_key, l_extendedprice, (round(l_quantity * (1 - l_discount), 4))::decimal(20,8) as w
         from lineitem)""", "l_shipmode_key").replace("as m\n", "as median\n"))
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("l_shipmode_key"), "l_extendedprice",
        F.round(F.col("l_quantity") * (1 - F.col("l_discount")), 4).alias("w"))
    return med.weighted_median(li, ["l_shipmode_key"], "l_extendedprice", "w")


# Values that all fall into one bucket (a band of a tenth of a percent) or next to zero.
_CLOSE = """select 'band' as what, 1000 + l_extendedprice / 131072 as v, l_quantity::bigint as w from lineitem
         union all select 'tiny', l_extendedprice / 67108864, l_quantity::bigint from lineitem"""


@R.add("q_weighted_median_close", median_sql(_CLOSE, "what").replace("as m\n", "as median\n"))
def _(spark, sf):
    li, x = table(spark, sf, "lineitem"), F.col("l_extendedprice")
    band = li.select(F.lit("band").alias("what"), (x / 131072 + 1000).alias("v"), "l_quantity")
    tiny = li.select(F.lit("tiny").alias("what"), (x / 67108864).alias("v"), "l_quantity")
    return med.weighted_median(band.unionByName(tiny), ["what"], "v", "l_quantity", kind=med.WHOLE)


_CLOSE_UNC = UNC_SQL.format(by="l_returnflag", n=N_REPS, meds=median_sql(
    f"""select l_returnflag, r, 1000 + l_extendedprice / 131072 as v,
               (case when r = 0 then l_quantity else {replicate_sql('l_quantity', 'l_orderkey', 'l_partkey')} end)::bigint as w
        from lineitem, range({N_REPS + 1}) t(r)""", "l_returnflag, r"))


@R.add("q_replicates_close", "select l_returnflag, point, replicates_used, round(variance * 1e9, 4) as variance from (" + _CLOSE_UNC + ")")
def _(spark, sf):
    """All values of a group in a band of a tenth of a percent, with 80 replicate weights."""
    li = table(spark, sf, "lineitem").withColumn("v", F.col("l_extendedprice") / 131072 + 1000)
    reps = numbered_weights(F.col("l_quantity"), F.col("l_orderkey"), F.col("l_partkey"))
    got = med.median_uncertainty(li, ["l_returnflag"], "v", "l_quantity", reps, N_REPS, multiplier=0.05, critical=1.96, kind=med.WHOLE)
    return got.select("l_returnflag", "point", "replicates_used", F.round(F.col("variance") * 1e9, 4).alias("variance"))


@R.add("q_unweighted_median", """
    select 'line' as what, median(l_extendedprice) as median from lineitem
    union all select 'order', median(o_totalprice) from orders""")
def _(spark, sf):
    a = table(spark, sf, "lineitem").select(F.lit("line").alias("what"), F.col("l_extendedprice").alias("v"))
    b = table(spark, sf, "orders").select(F.lit("order").alias("what"), F.col("o_totalprice").alias("v"))
    return med.median(a.unionByName(b), ["what"], "v")


def _uncertainty(spark, sf):
    reps = numbered_weights(F.col("l_quantity"), F.col("l_orderkey"), F.col("l_partkey"))
    return med.median_uncertainty(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", reps, N_REPS,
        multiplier=0.05, critical=1.96, kind=med.WHOLE)


_UNC = UNC_SQL.format(by="l_returnflag, l_linestatus", n=N_REPS, meds=median_sql(
    f"""select l_returnflag, l_linestatus, r, l_extendedprice as v,
               (case when r = 0 then l_quantity else {replicate_sql('l_quantity', 'l_orderkey', 'l_partkey')} end)::bigint as w
        from lineitem, range({N_REPS + 1}) t(r)""", "l_returnflag, l_linestatus, r"))

_ROUND_UNC = {"variance": 4, "standard_error": 5, "margin_of_error": 5, "ci_lower": 5, "ci_upper": 5, "cv": 8}


def _round_sql(sql: str, digits: dict[str, int], keep: str) -> str:
    return f"select {keep}, " + ", ".join(f"round({c}, {d}) as {c}" for c, d in digits.items()) + f" from ({sql})"


@R.add("q_replicate_uncertainty", _round_sql(_UNC, _ROUND_UNC, "l_returnflag, l_linestatus, point, replicates_used"))
def _(spark, sf):
    return rounded(_uncertainty(spark, sf), **_ROUND_UNC)


@R.add("q_interval_overlap", f"""
    with u as ({_UNC})
    select a.l_returnflag as left_flag, b.l_returnflag as right_flag, a.l_linestatus,
           a.ci_lower <= b.ci_upper and b.ci_lower <= a.ci_upper as overlap
    from u a join u b on a.l_linestatus = b.l_linestatus and a.l_returnflag < b.l_returnflag""")
def _(spark, sf):
    u = _uncertainty(spark, sf).select("l_returnflag", "l_linestatus", "ci_lower", "ci_upper")
    a = u.select(F.col("l_returnflag").alias("left_flag"), "l_linestatus", F.col("ci_lower").alias("al"), F.col("ci_upper").alias("ah"))
    b = u.select(F.col("l_returnflag").alias("right_flag"), "l_linestatus", F.col("ci_lower").alias("bl"), F.col("ci_upper").alias("bh"))
    # one row per group on both sides
    return a.join(b, "l_linestatus").where("left_flag < right_flag").select(
        "left_flag", "right_flag", "l_linestatus",
        rules.intervals_overlap(F.col("al"), F.col("ah"), F.col("bl"), F.col("bh")).alias("overlap"))


# ---- overlapping cells -------------------------------------------------------------------------------


def cell_rows(spark, sf) -> DataFrame:
    """All line items with their supplier's region; some values and weights are missing."""
    li, s, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return rows.select(
        "n_regionkey", "l_returnflag", F.year("l_shipdate").alias("yr"),
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice")).alias("v"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 50 == 0), F.lit(0.0))
        .otherwise(F.col("l_quantity")).alias("w"), "l_quantity", "l_orderkey", "l_partkey")


def cell_dims() -> dict:
    region, flag, yr = F.col("n_regionkey"), F.col("l_returnflag"), F.col("yr")
    return {
        "geography_id": {"all": region.isin(0, 1, 2, 3, 4), "outer": region.isin(1, 2, 3, 4),
                         **{f"r{i}": region == i for i in range(5)}, "nowhere": region == 9},
        "population": {"wide": flag.isin("R", "A"), "returned": flag == "R", "kept": flag == "N"},
        "cohort": {"recent": cel.cohort(yr, 1999, 2000), "incumbent": cel.cohort(yr, None, 1998)},
    }


def cell_frame(spark, sf) -> DataFrame:
    rows = cell_rows(spark, sf)
    reps = numbered_weights(F.col("l_quantity"), F.col("l_orderkey"), F.col("l_partkey"))
    return cel.cell_estimates(rows, cell_dims(), "v", "w", reps, cel.Replicates(CELL_REPS), kind=med.WHOLE)


_CELL_ROWS = f"""
    cell_rows as (
      select n_regionkey, l_returnflag, year(l_shipdate) as yr,
             case when l_orderkey % 11 <> 0 then l_extendedprice end as v,
             case when l_returnflag = 'A' and l_orderkey % 50 = 0 then 0 else l_quantity end as w,
             l_quantity as q, l_orderkey as a, l_partkey as b
      from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
    tagged as (
      select *,
        unnest(list_filter(['all', case when n_regionkey > 0 then 'outer' end, 'r' || n_regionkey], lambda x: x is not null)) as geography_id
      from cell_rows),
    tagged2 as (
      select *, unnest(list_filter([case when l_returnflag in ('R','A') then 'wide' end, case when l_returnflag = 'R' then 'returned' end,
                                    case when l_returnflag = 'N' then 'kept' end], lambda x: x is not null)) as population,
             case when yr between 1999 and 2000 then 'recent' when yr <= 1998 then 'incumbent' end as cohort
      from tagged),
    members as (select * from tagged2 where cohort is not null),
    skeleton as (
      select * from (select unnest(['all','outer','r0','r1','r2','r3','r4','nowhere']) as geography_id),
                    (select unnest(['wide','returned','kept']) as population), (select unnest(['recent','incumbent']) as cohort)),
    totals as (
      select geography_id, population, cohort, count(*) as eligible_n, count(*) filter (where v > 0 and w > 0) as usable_n,
             count(*) filter (where not w > 0) as invalid_weight_n, sum(w) filter (where w > 0) as eligible_weight,
             sum(w) filter (where v > 0 and w > 0) as usable_weight
      from members group by all),
    unc as ({UNC_SQL.format(by='geography_id, population, cohort', n=CELL_REPS, meds=median_sql(
        f"select geography_id, population, cohort, r, v, (case when r = 0 then w else {replicate_sql('q', 'a', 'b')} end)::bigint as w "
        f"from members, range({CELL_REPS + 1}) t(r) where v > 0 and w > 0", "geography_id, population, cohort, r"))}),
    cells0 as (
      select s.*, coalesce(eligible_n, 0) as eligible_n, coalesce(usable_n, 0) as usable_n,
             coalesce(invalid_weight_n, 0) as invalid_weight_n, coalesce(eligible_weight, 0) as eligible_weight,
             coalesce(usable_weight, 0) as usable_weight, u.* exclude (geography_id, population, cohort),
             coalesce(point is not null and coalesce(invalid_weight_n, 0) = 0, false) as available
      from skeleton s left join totals t using (geography_id, population, cohort)
                      left join unc u using (geography_id, population, cohort)),
    cells as (
      select geography_id, population, cohort, eligible_n, usable_n, invalid_weight_n, eligible_weight, usable_weight, available,
             case when available then round_even(point, 0) end as value,
             case when available then replicates_used else 0 end as replicates_used,
             case when available then round_even(variance, 4) end as variance,
             case when available then round_even(standard_error, 4) end as standard_error,
             case when available then round_even(margin_of_error, 4) end as margin_of_error,
             case when available then round_even(ci_lower, 4) end as ci_lower,
             case when available then round_even(ci_upper, 4) end as ci_upper,
             case when available then round_even(cv, 6) end as cv,
             case when not available then '' else
               concat_ws(' | ', case when usable_n < 30 then 'Small sample: ' || usable_n || ' rent responses.' end,
                         case when cv is null then 'Uncertainty could not be estimated' when cv > 0.30 then 'High sampling uncertainty.'
                              when cv > 0.15 then 'Higher sampling uncertainty.' end) end as caveats,
             case when available and cv is null then 'invalid_replicate_weights_or_variance' end as uncertainty_reason,
             case when invalid_weight_n > 0 then 'invalid_full_sample_weights'
                  when point is null then 'no_usable_rent_observations' end as unavailable_reason
      from cells0),
    cellsf as (select *, case when not available then 'unavailable' when caveats <> '' then 'use_with_caution' else 'reliable' end
               as reliability from cells)"""

_CELL_COLUMNS = """geography_id, population, cohort, eligible_n, usable_n, invalid_weight_n, eligible_weight, usable_weight, available,
    value, replicates_used, round(variance, 2) as variance, round(standard_error, 3) as standard_error,
    round(margin_of_error, 3) as margin_of_error, round(ci_lower, 3) as ci_lower, round(ci_upper, 3) as ci_upper,
    round(cv, 5) as cv, caveats, uncertainty_reason, unavailable_reason, reliability"""

_CELL_ROUND = {"variance": 2, "standard_error": 3, "margin_of_error": 3, "ci_lower": 3, "ci_upper": 3, "cv": 5}


@R.add("q_cell_estimates", f"with {_CELL_ROWS} select {_CELL_COLUMNS} from cellsf")
def _(spark, sf):
    return rounded(cell_frame(spark, sf), **_CELL_ROUND).withColumn("caveats", F.array_join("caveats", " | "))


@R.add("q_cell_observations", f"""with {_CELL_ROWS}
    select 'survey:2000:' || geography_id || ':' || population || ':' || cohort as observation_id, value,
           usable_n as sample_size, usable_weight as weighted_population, 'weighted_median' as statistic,
           'descriptive_only' as inference_class, reliability, available from cellsf""")
def _(spark, sf):
    obs = cel.observations(cell_frame(spark, sf), ["geography_id", "population", "cohort"], "2000", "survey")
    return obs.select("observation_id", "value", "sample_size", "weighted_population", "statistic", "inference_class",
                      "reliability", "available")


def gap_frame(spark, sf) -> DataFrame:
    obs = cel.observations(cell_frame(spark, sf), ["geography_id", "population", "cohort"], "2000", "survey")
    wanted = gaps.gap_rules(["wide", "returned", "kept"], ("kept", "returned"), ("recent", "incumbent"))
    return gaps.gap_pairs(obs, wanted)


_GAP_SQL = """
    gap_rules as (
      select * from (values
        ('incumbency_within_regime','wide','recent','wide','incumbent'),
        ('incumbency_within_regime','returned','recent','returned','incumbent'),
        ('incumbency_within_regime','kept','recent','kept','incumbent'),
        ('same_tenure_regulation','kept','recent','returned','recent'),
        ('same_tenure_regulation','kept','incumbent','returned','incumbent'),
        ('illustrative_cross_regime','returned','recent','kept','incumbent')) t(kind, lp, lc, rp, rc)),
    gaps as (
      select concat_ws(':', l.geography_id, kind, lp, lc, 'minus', rp, rc) as gap_id, kind, l.geography_id,
             l.value - r.value as difference, round_even(100 * (l.value - r.value) / r.value, 6) as percent,
             case when l.value > r.value then 'positive' when l.value < r.value then 'negative' else 'zero' end as direction,
             kind = 'illustrative_cross_regime' as illustrative, lp as left_population, lc as left_cohort,
             l.reliability as left_reliability, r.reliability as right_reliability,
             l.caveats as left_caveats, r.caveats as right_caveats
      from gap_rules join cellsf l on lp = l.population and lc = l.cohort
           join cellsf r on rp = r.population and rc = r.cohort and l.geography_id = r.geography_id
      where l.available and r.available)"""


@R.add("q_gap_pairs", f"""with {_CELL_ROWS}, {_GAP_SQL}
    select gap_id, kind, difference, round(percent, 5) as percent, direction, illustrative, left_caveats, right_caveats from gaps""")
def _(spark, sf):
    g = gap_frame(spark, sf).where(F.size("mismatched") == 0)
    text = lambda c: F.array_join(F.try_element_at("component_caveats", F.col(c)), " | ")
    return g.select("gap_id", "kind", "difference", F.round("percent", 5).alias("percent"), "direction", "illustrative",
                    text("left_id").alias("left_caveats"), text("right_id").alias("right_caveats"))


def with_artifacts(cells: DataFrame) -> DataFrame:
    """Cells with the artifacts they were made from; every fifth count names one of them twice, an injected fault."""
    second = F.when(F.col("eligible_n") % 5 == 0, "occupied").otherwise("all_units")
    return cells.withColumn("artifact_ids", F.array(F.lit("occupied"), second))


@R.add("q_gap_mismatches", f"""with {_CELL_ROWS}, {_GAP_SQL}
    select gap_id, case when (lp = 'returned') <> (rp = 'returned') then 'statistic' else '' end as mismatched,
           case when (lp = 'returned') = (rp = 'returned') then difference end as difference
    from (select gaps.*, lp, rp from gaps join gap_rules on gaps.kind = gap_rules.kind and left_population = lp and left_cohort = lc)""")
def _(spark, sf):
    # one population is measured by another statistic, so its pairs with others carry no difference
    obs = cel.observations(cell_frame(spark, sf), ["geography_id", "population", "cohort"], "2000", "survey")
    obs = obs.withColumn("statistic", F.when(F.col("population") == "returned", "weighted_mean").otherwise(F.col("statistic")))
    wanted = gaps.gap_rules(["wide", "returned", "kept"], ("kept", "returned"), ("recent", "incumbent"))
    return gaps.gap_pairs(obs, wanted).select("gap_id", F.array_join("mismatched", " ").alias("mismatched"), "difference")


@R.add("q_cell_contracts", f"""with {_CELL_ROWS}, {_GAP_SQL}, broken as (
      -- every seventh value is taken away and the direction of falling gaps is turned, as injected faults
      select geography_id || ':' || population || ':' || cohort as id, available, case when eligible_n % 7 = 0 then null else value end as value,
             unavailable_reason, reliability, replicates_used, variance from cellsf)
    select id, 'available_has_value' as contract from broken where available and value is null
    union all select id, 'unavailable_has_no_value' from broken where not available and value is not null
    union all select geography_id || ':' || population || ':' || cohort, 'artifacts_are_unique' from cellsf where eligible_n % 5 = 0
    union all select gap_id, 'direction_is_sign' from gaps where difference < 0""")
def _(spark, sf):
    c = cell_frame(spark, sf).withColumn("id", F.concat_ws(":", "geography_id", "population", "cohort"))
    c = with_artifacts(c.withColumn("value", F.when(F.col("eligible_n") % 7 != 0, F.col("value"))))
    g = gap_frame(spark, sf).withColumn("id", F.col("gap_id"))
    g = g.withColumn("direction", F.when(F.col("difference") < 0, "positive").otherwise(F.col("direction")))
    return checks.violations(c, "id", checks.cell_contracts("artifact_ids")).unionByName(checks.violations(g, "id", checks.gap_contracts()))


@R.add("q_load_state", f"""with {_CELL_ROWS}
    select count(*) as rows, count(*) filter (where available and eligible_n % 7 = 0 or eligible_n % 5 = 0) as broken,
           case when count(*) filter (where available and eligible_n % 7 = 0 or eligible_n % 5 = 0) = 0 then 'ready' else 'error' end as status from cellsf""")
def _(spark, sf):
    c = cell_frame(spark, sf).withColumn("value", F.when(F.col("eligible_n") % 7 != 0, F.col("value")))
    return checks.load_state(with_artifacts(c), checks.cell_contracts("artifact_ids"))


# ---- groups and shares -------------------------------------------------------------------------------

# fixed values of this query: which priority stands for which building code
_CODES = {"1-URGENT": "05", "2-HIGH": "32", "3-MEDIUM": "80", "4-NOT SPECIFIED": "90", "5-LOW": "97"}
_GROUPS = ["public_housing", "rent_stabilized", "section8_voucher", "rent_controlled", "other_regulated",
           "other_or_unspecified_assistance", "unknown", "unassisted_market"]


def labelled_orders(spark, sf) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    code = F
    for k, v in _CODES.items():
        code = code.when(F.col("o_orderpriority") == k, v)
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        "o_orderkey", "o_totalprice", "n_regionkey", (F.col("o_orderstatus") != "P").alias("eligible"),
        rules.regime(typed.padded_code(F.ltrim(code.otherwise("0")))).alias("regime"),
        typed.answer(F.when(F.col("o_orderkey") % 13 == 0, "-2").when(F.col("o_orderkey") % 3 == 0, "1").when(
            F.col("o_orderkey") % 17 == 0, "9").otherwise("2")).alias("assisted"),
        typed.answer(F.when(F.col("o_custkey") % 11 == 0, "1").otherwise("2")).alias("voucher"),
        (F.col("o_orderkey") % 9 + 1).cast("double").alias("w"))
    args = [F.col(x) for x in ("eligible", "regime", "assisted", "voucher")]
    return df.withColumn("grp", rules.primary_group(*args)).withColumn("issues", rules.group_issues(*args))


_LABELLED = """
    labelled0 as (
      select o_orderkey, o_totalprice, n_regionkey, o_orderstatus <> 'P' as eligible,
        case o_orderpriority when '1-URGENT' then 'public_housing' when '2-HIGH' then 'rent_stabilized' when '3-MEDIUM' then 'unregulated'
          when '4-NOT SPECIFIED' then 'rent_controlled' when '5-LOW' then 'other_regulated' else 'unknown' end as regime,
        case when o_orderkey % 13 = 0 then 'not_applicable' when o_orderkey % 3 = 0 then 'yes' when o_orderkey % 17 = 0 then 'unknown'
          else 'no' end as assisted,
        case when o_custkey % 11 = 0 then 'yes' else 'no' end as voucher, o_orderkey % 9 + 1 as w
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
    labelled as (
      select *, case when not eligible then 'ineligible'
          when assisted = 'not_applicable' or (assisted = 'no' and voucher = 'yes') or (regime = 'public_housing' and voucher = 'yes') then 'unknown'
          when regime = 'public_housing' then 'public_housing' when voucher = 'yes' then 'section8_voucher'
          when regime in ('rent_stabilized','rent_controlled','other_regulated') then regime
          when assisted = 'yes' then 'other_or_unspecified_assistance'
          when regime = 'unregulated' and assisted = 'no' then 'unassisted_market' else 'unknown' end as grp
      from labelled0)"""


@R.add("q_protection_labels", f"""with {_LABELLED}
    select grp, regime, assisted, voucher, count(*) as n, concat_ws(' | ', case when eligible and assisted = 'not_applicable' then 'renter_assistance_not_applicable' end,
        case when eligible and assisted = 'no' and voucher = 'yes' then 'voucher_conflicts_with_no_assistance' end,
        case when eligible and regime = 'public_housing' and voucher = 'yes' then 'public_housing_voucher_overlap_requires_review' end) as issues
    from labelled group by all""")
def _(spark, sf):
    return labelled_orders(spark, sf).groupBy("grp", "regime", "assisted", "voucher", F.array_join("issues", " | ").alias("issues")).agg(F.count("*").alias("n"))


def group_cells(spark, sf) -> DataFrame:
    rows = labelled_orders(spark, sf)
    region, grp = F.col("n_regionkey"), F.col("grp")
    dims = {"geography_id": {"all": region.isNotNull(), **{f"r{i}": region == i for i in range(5)}},
            "population": cel.Label(grp, tuple(_GROUPS))}
    return cel.cell_estimates(rows, dims, "o_totalprice", "w", kind=med.WHOLE)


_GROUP_SQL = _LABELLED + """,
    gmem as (select grp as population, o_totalprice as v, w, unnest(['all', 'r' || n_regionkey]) as geography_id
             from labelled where grp <> 'ineligible'),
    gmed as (""" + median_sql("select geography_id, population, v, w from gmem", "geography_id, population") + """),
    gcells as (
      select geography_id, population, coalesce(n, 0) as usable_n, round_even(m, 0) as value, m is not null as available
      from (select * from (select unnest(['all','r0','r1','r2','r3','r4']) as geography_id), (select unnest([""" + ",".join(
    f"'{g}'" for g in _GROUPS) + """]) as population))
      left join (select geography_id, population, count(*) as n from gmem group by all) using (geography_id, population)
      left join gmed using (geography_id, population))"""


@R.add("q_group_estimates", f"with {_GROUP_SQL} select * from gcells")
def _(spark, sf):
    return group_cells(spark, sf).select("geography_id", "population", "usable_n", "value", "available")


@R.add("q_group_difference", f"""with {_GROUP_SQL}
    select geography_id, max(case when population = 'unassisted_market' and available then value end)
      - max(case when population = 'public_housing' and available then value end) as difference
    from gcells group by 1""")
def _(spark, sf):
    return gaps.group_difference(group_cells(spark, sf), "unassisted_market", "public_housing").orderBy(
        F.desc_nulls_last("difference"))


_PEOPLE, _BEDS = ["1", "2", "3", "4+"], ["0", "1", "2", "3", "4+"]
_SHARE_REPS = 8
_PRIORITIES = ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW")


def share_frame(spark, sf) -> DataFrame:
    o, c, n, li = (table(spark, sf, t) for t in ("orders", "customer", "nation", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
    rows = o.join(lines, o.o_orderkey == lines.l_orderkey).join(c, o.o_custkey == c.c_custkey).join(
        n, c.c_nationkey == n.n_nationkey).select(
        "o_orderpriority", "n_regionkey", "lines", F.floor(F.col("qty") / 40).alias("beds"),
        (F.col("o_orderkey") % 9 + 1).cast("double").alias("w"),
        replicate_weights((F.col("o_orderkey") % 9 + 1), F.col("o_orderkey"), F.col("o_custkey"), _SHARE_REPS).alias("reps"))
    region, pri = F.col("n_regionkey"), F.col("o_orderpriority")
    groups = {"grp": {name.lower(): pri == f"{i}-{name}" for i, name in enumerate(_PRIORITIES, 1)},
              "geography_id": {"all": region.isNotNull(), "r0": region == 0, "r1": region == 1, "nowhere": region == 9}}
    parts = {"people": (typed.size_bucket(F.col("lines"), 1, 13), _PEOPLE), "bedrooms": (typed.size_bucket(F.col("beds"), 0, 6), _BEDS)}
    return cel.joint_shares(rows, groups, parts, "w", F.col("reps"), cel.Replicates(_SHARE_REPS), kind=med.WHOLE)


_SHARE_SQL = f"""
    ol as (select l_orderkey, count(*) as lines, sum(l_quantity) as qty from lineitem group by 1),
    srows as (
      select lower(substr(o_orderpriority, 3)) as grp,
             unnest(list_filter(['all', case when n_regionkey in (0, 1) then 'r' || n_regionkey end], lambda x: x is not null)) as geography_id,
             case when lines between 1 and 13 then case when lines < 4 then lines::varchar else '4+' end end as people,
             case when floor(qty / 40) between 0 and 6 then case when qty < 160 then floor(qty / 40)::int::varchar else '4+' end end as bedrooms,
             o_orderkey % 9 + 1 as w, o_orderkey as a, o_custkey as b
      from orders join ol on o_orderkey = l_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
    valid as (select * from srows where people is not null and bedrooms is not null),
    den as (select grp, geography_id, count(*) as group_n, sum(w) as d from valid group by all),
    mis as (select grp, geography_id, count(*) as missing_n, sum(w) as missing_weight from srows where people is null or bedrooms is null group by all),
    num as (select grp, geography_id, people, bedrooms, count(*) as cell_n, sum(w) as x from valid group by all),
    rn as (select grp, geography_id, people, bedrooms, r, sum({replicate_sql('w', 'a', 'b')}) as rw from valid, range(1, {_SHARE_REPS + 1}) t(r) group by all),
    rt as (select grp, geography_id, r, sum(rw) as t from rn group by all),
    var as (select grp, geography_id, people, bedrooms, 0.05 * sum((rw / t - x / d) * (rw / t - x / d)) as v
            from rn join rt using (grp, geography_id, r) join num using (grp, geography_id, people, bedrooms) join den using (grp, geography_id) group by all),
    shares as (
      select grp, geography_id, people, bedrooms, coalesce(cell_n, 0) as cell_n, coalesce(group_n, 0) as group_n,
             d is not null as available, case when d is not null then coalesce(x, 0) / d end as share,
             sqrt(v) as standard_error, case when v is not null then greatest(0, x / d - 1.96 * sqrt(v)) end as ci_lower,
             case when v is not null then least(1, x / d + 1.96 * sqrt(v)) end as ci_upper,
             d is not null and x is null as none_observed, coalesce(missing_n, 0) as missing_n, coalesce(missing_weight, 0)::double as missing_weight,
             case when d is null then 'unavailable' when x is null then 'none_observed'
                  when cell_n < 30 or sqrt(v) / (x / d) > 0.3 then 'use_with_caution' else 'reliable' end as reliability
      from (select * from (select unnest(['urgent','high','medium','not specified','low']) as grp), (select unnest(['all','r0','r1','nowhere']) as geography_id),
           (select unnest(['1','2','3','4+']) as people), (select unnest(['0','1','2','3','4+']) as bedrooms))
      left join den using (grp, geography_id) left join mis using (grp, geography_id)
      left join num using (grp, geography_id, people, bedrooms) left join var using (grp, geography_id, people, bedrooms))"""


@R.add("q_joint_share", f"""with {_SHARE_SQL}
    select * replace (round(share, 8) as share, round(standard_error, 8) as standard_error, round(ci_lower, 8) as ci_lower,
                      round(ci_upper, 8) as ci_upper) from shares""")
def _(spark, sf):
    s = share_frame(spark, sf).select(
        "grp", "geography_id", "people", "bedrooms", "cell_n", "group_n", "available", "share", "standard_error", "ci_lower",
        "ci_upper", "none_observed", "missing_n", "missing_weight", "reliability")
    return rounded(s, share=8, standard_error=8, ci_lower=8, ci_upper=8)


@R.add("q_cell_across_groups", f"""with {_SHARE_SQL}
    select grp, cell_n, group_n, round(share, 8) as share from shares where geography_id = 'all' and people = '2' and bedrooms = '1'""")
def _(spark, sf):
    return share_frame(spark, sf).where("geography_id = 'all' and people = '2' and bedrooms = '1'").select(
        "grp", "cell_n", "group_n", F.round("share", 8).alias("share"))


# ---- gates and changes -------------------------------------------------------------------------------

_EXPECTED = [("all", 51000.0), ("A", 51000.0), ("N", 9000.0), ("R", 51000.0), ("X", 1.0)]


@R.add("q_benchmark_gate", "with b as (" + median_sql(
    """select unnest(['all', l_returnflag]) as name, l_extendedprice as v, (round(l_quantity * (1 - l_discount), 4))::decimal(20,8) as w
       from lineitem""", "name") + """)
    select name, expected, round_even(m, 0) as computed, coalesce(abs(round_even(m, 0) - expected) <= 5000, false) as ok
    from (values ('all', 51000.0::double), ('A', 51000.0), ('N', 9000.0), ('R', 51000.0), ('X', 1.0)) e(name, expected) left join b using (name)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("w", F.round(F.col("l_quantity") * (1 - F.col("l_discount")), 4))
    got = cel.benchmark_medians(li, F.col("l_returnflag"), "l_extendedprice", "w")
    want = spark.createDataFrame(_EXPECTED, "name string, expected double")
    return checks.benchmark_gate(got, want, "name", 5000)


@R.add("q_reference_change", "with y as (" + median_sql(
    """select year(o_orderdate) as yr, n_regionkey as region, o_totalprice as v, 1 as w from orders join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey""", "yr, region") + """),
    a as (select region, round_even(m, 0) as v from y where yr = 1996), b as (select region, round_even(m, 0) as v from y where yr = 2000),
    d as (select l.region || '-' || r.region as comparison_id, l.v - r.v as ref, lb.v - rb.v as cur
          from a l join a r on r.region = (l.region + 1) % 5 join b lb on lb.region = l.region join b rb on rb.region = r.region)
    select comparison_id, ref as reference_difference, cur as current_difference,
           case when sign(ref) = sign(cur) then 'unchanged' when ref = 0 then 'emerged' when cur = 0 then 'neutralized' else 'reversed' end
             as direction_verdict,
           case when abs(cur) > abs(ref) then 'increased' when abs(cur) < abs(ref) then 'decreased' else 'unchanged' end as scale_verdict,
           cur - ref as difference_change, abs(cur) - abs(ref) as absolute_change, true as complete from d""")
def _(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.year("o_orderdate").alias("yr"), F.col("n_regionkey").alias("region"), "o_totalprice")
    m = med.median(rows.where("yr in (1996, 2000)"), ["yr", "region"], "o_totalprice").select(
        "yr", "region", F.bround("median", 0).alias("value"))
    old = m.where("yr = 1996")
    left = old.select(F.col("region").alias("left_region"), F.col("value").alias("left_ref"),
                      ((F.col("region") + 1) % 5).alias("right_region"))
    right = old.select(F.col("region").alias("right_region"), F.col("value").alias("right_ref"))
    ref = left.join(right, "right_region").withColumn("comparison_id", F.concat_ws("-", "left_region", "right_region"))
    return gaps.reference_change(ref, m.where("yr = 2000"), ["region"]).drop("reference_direction", "current_direction")


# ---- area fallback -----------------------------------------------------------------------------------

# fixed values of these queries: area names, codes and cells
_AREA_CODES = {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU", "MIDDLE EAST": "ME"}
_AREA_CELLS = {"AF": "africa", "AM": "america", "AS": "asia", "EU": "europe", "ME": "mideast"}


def fallback_subjects(spark, sf) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    name = F.when(F.col("c_custkey") % 10 == 0, F.concat_ws("/", "r_name", F.lit("ASIA"))).when(
        F.col("c_custkey") % 37 == 0, F.lit("ATLANTIS")).otherwise(F.col("r_name"))
    from parcelwise.functions.arrays import split_names
    codes = F.array_distinct(split_names(name, _AREA_CODES))
    return df.select("c_custkey", gaps.area_candidates(codes, _AREA_CELLS, ["AF", "AS", "EU", "ME"], "outer", "all").alias("candidates"))


def fallback_cells(spark, sf, segment: str) -> DataFrame:
    """Sum of balances per area; areas with an odd customer count are unavailable, one area has no cell."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    region = F.col("n_regionkey")
    rows = c.where(F.col("c_mktsegment") == segment).join(n, c.c_nationkey == n.n_nationkey)
    areas = cel.memberships({"africa": region == 0, "america": region == 1, "asia": region == 2, "europe": region == 3,
                             "outer": region != 1, "all": region.isNotNull()})
    sums = rows.select(F.explode(areas).alias("geography_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("b")).groupBy(
        "geography_id").agg(F.sum("b").cast("double").alias("value"), F.count("*").alias("n"))
    return sums.select("geography_id", (F.col("n") % 2 == 0).alias("available"), F.when(F.col("n") % 2 == 0, F.col("value")).alias("value"))


_FALL_SQL = """
    names as (select c_custkey, case when c_custkey % 10 = 0 and r_name <> 'ASIA' then [r_name, 'ASIA'] when c_custkey % 10 = 0 then ['ASIA']
                when c_custkey % 37 = 0 then [] else [r_name] end as parts
              from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    cand as (
      select c_custkey, 0 as pos, case parts[1] when 'AFRICA' then 'africa' when 'AMERICA' then 'america' when 'ASIA' then 'asia'
               when 'EUROPE' then 'europe' else 'mideast' end as geography_id from names where len(parts) = 1
      union all select c_custkey, 1, 'outer' from names where len(parts) > 0 and not list_contains(parts, 'AMERICA')
      union all select c_custkey, 2, 'all' from names),
    mem as (select c_mktsegment, c_acctbal::decimal(18,2) as b, unnest(list_filter([case n_regionkey when 0 then 'africa' when 1 then 'america'
              when 2 then 'asia' when 3 then 'europe' end, case when n_regionkey <> 1 then 'outer' end, 'all'], lambda x: x is not null)) as geography_id
            from customer join nation on c_nationkey = n_nationkey),
    fcells as (select c_mktsegment, geography_id, count(*) % 2 = 0 as available, case when count(*) % 2 = 0 then sum(b)::double end as value
               from mem group by all)"""


@R.add("q_fallback_area", f"""with {_FALL_SQL}, best as (
      select c_custkey, geography_id, available, value from cand join fcells using (geography_id) where c_mktsegment = 'BUILDING'
      qualify row_number() over (partition by c_custkey order by available desc, pos) = 1)
    select c_custkey, geography_id, available, value from customer left join best using (c_custkey)""")
def _(spark, sf):
    return gaps.fall_back(fallback_subjects(spark, sf), fallback_cells(spark, sf, "BUILDING"))


@R.add("q_fallback_pair", f"""with {_FALL_SQL}, pair as (
      select c_custkey, pos, geography_id, l.available as left_available, l.value as left_value, r.available as right_available, r.value as right_value
      from cand left join (select * from fcells where c_mktsegment = 'BUILDING') l using (geography_id)
                left join (select * from fcells where c_mktsegment = 'MACHINERY') r using (geography_id)
      where l.available is not null or r.available is not null
      qualify row_number() over (partition by c_custkey order by coalesce(l.available and r.available, false) desc, pos) = 1)
    select c_custkey, geography_id, left_available, left_value, right_available, right_value from customer left join pair using (c_custkey)""")
def _(spark, sf):
    return gaps.fall_back_pair(fallback_subjects(spark, sf), fallback_cells(spark, sf, "BUILDING"), fallback_cells(spark, sf, "MACHINERY"))


@R.add("q_preferred_gap", f"""with {_CELL_ROWS}, {_GAP_SQL}, cand as (
      select c_custkey, 0 as pos, 'r' || n_regionkey as geography_id from customer join nation on c_nationkey = n_nationkey
      union all select c_custkey, 1, 'outer' from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 0
      union all select c_custkey, 2, 'all' from customer),
    ranked as (
      select c_custkey, gap_id, kind, g.geography_id, difference,
        row_number() over (partition by c_custkey order by pos, case when kind = 'incumbency_within_regime' and left_population = 'kept' then 0
          when kind = 'incumbency_within_regime' and left_population = 'returned' then 1
          when kind = 'same_tenure_regulation' and left_cohort = 'recent' then 2 else 3 end, gap_id) as rn
      from cand join gaps g using (geography_id) where not illustrative and left_reliability = 'reliable' and right_reliability = 'reliable'
        and not (kind = 'incumbency_within_regime' and left_population not in ('kept', 'returned')))
    select c.c_custkey, gap_id, kind, geography_id, difference from customer c left join (select * from ranked where rn = 1) using (c_custkey)""")
def _(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    subjects = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.array_compact(F.array(
        region, F.when(F.col("n_regionkey") != 0, "outer"), F.lit("all"))).alias("candidates"))
    return gaps.preferred_gap(subjects, gap_frame(spark, sf), "kept", "returned", "recent")
