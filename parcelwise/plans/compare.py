"""Comparator joins, classes, selection, rankings and summaries.

Subjects are customers with their orders; areas are nations with the prices of their suppliers' lines. There
are three market sources: a benchmark per (area, bedroom count), an all-unit index and listings in some areas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import rules
from parcelwise.operators import checks, compare, joins
from parcelwise.operators import select as sel
from parcelwise.plans.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def tenant(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("last"), F.min("o_totalprice").alias("t_value"), F.count("*").alias("units"))
    k = F.col("o_custkey")
    return o.select(
        k.alias("subject_id"), F.concat(F.lit("t:"), k.cast("string")).alias("t_id"), F.trunc("last", "MM").alias("t_period"), "t_value",
        "units",
        F.when(k % 4 == 3, "bedroom_specific").when(k % 5 == 0, "studio_mix").otherwise("all_units").alias("t_scope"),
        F.when(k % 8 == 3, 2).when(k % 8 == 7, 3).alias("t_bedroom"),
        F.when(k % 3 == 0, "gross").when(k % 3 == 1, "net").alias("t_gross_net"),
        F.concat(F.lit("art-"), (k % 7).cast("string")).alias("t_artifact"),
        F.when(k % 10 == 1, "tenant pays electric").alias("t_utility"))


def area_id(c):
    return F.concat(F.lit("zcta:"), F.lpad(c.cast("string"), 5, "0"))


def assignments(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey % 17 <> 0").select(
        F.col("c_custkey").alias("subject_id"), area_id(F.col("c_nationkey")).alias("area_id"),
        F.col("c_nationkey").alias("nation"))


def market(spark, sf) -> DataFrame:
    """All three sources; prices are reduced per (nation, remainder of the line number) in one pass over the lines."""
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    price = F.col("l_extendedprice")
    base = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("s_nationkey", ((F.col("l_linenumber") - 1) % 5).alias("bed")).agg(
        F.sum(price.cast("decimal(18,2)")).alias("total"), F.count("*").alias("n"), F.max(price).alias("top"))
    n = F.col("s_nationkey")
    start = F.lit("2001-07-01").cast("date")

    def rows(df, value, prefix, kind, bedroom, period, scope, gross, basis):
        tail = F.concat(F.lit(":"), bedroom.cast("string")) if bedroom is not None else F.lit(":all_units")
        return df.select(
            area_id(n).alias("area_id"), n.alias("area_nation"), F.concat(F.lit(prefix), n.cast("string"), tail).alias("m_id"), period.alias("m_period"),
            value.alias("m_value"), F.lit(scope).alias("m_scope"),
            (bedroom if bedroom is not None else F.lit(None)).cast("int").alias("m_bedroom"), F.lit(gross).alias("m_gross_net"),
            F.lit(basis).alias("m_basis"), F.lit(kind).alias("m_artifact"), F.lit(2).alias("seq"))

    mean = F.col("total").cast("double") / F.col("n").cast("double")
    bench = rows(base, mean, "hud-safmr:", "art-hud", F.col("bed"), F.add_months(start, -2 * n),
                 "bedroom_specific", "gross", "regulatory_market_benchmark")
    whole = base.groupBy("s_nationkey").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("top").alias("top"))
    index = rows(whole, mean, "zori:", "art-zori", None, F.when(n % 2 == 0, start).otherwise(F.add_months(start, -n)), "all_units", "unknown", "index")
    asks = rows(whole.where("s_nationkey % 5 = 0"), F.col("top"), "renthop:", "art-rent", F.lit(1), start, "bedroom_specific", "gross", "asking")
    return bench.unionByName(index).unionByName(asks)


def pairs(spark, sf) -> DataFrame:
    t, a, m = tenant(spark, sf), assignments(spark, sf), market(spark, sf)
    # every second area has an earlier listing that the later one replaces
    m = m.unionByName(m.where("m_basis = 'index' and area_nation % 2 = 0").withColumn("m_value", F.lit(1.0)).withColumn("seq", F.lit(1)))
    out = compare.pair_by_area(t, a, m, {"regulatory_market_benchmark": 2, "index": None, "asking": 1})
    return out.withColumn("comparison_id", F.concat(F.col("subject_id").cast("string"), F.lit("__"), F.col("m_id")))


def comparisons(spark, sf) -> DataFrame:
    contains = F.col("area_nation") % 2 == 0
    extra = F.when(F.col("subject_id") % 6 == 0, F.array(F.lit("curated pair")))
    c = compare.compare_pairs(pairs(spark, sf), contains=contains, extra_reasons=extra)
    return c.withColumn("market_bedroom", F.col("m_bedroom")).withColumn("market_scope", F.col("m_scope"))


def best(spark, sf) -> DataFrame:
    return sel.best_per_subject(comparisons(spark, sf))


def subjects(spark, sf) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    units = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("units"))
    return c.join(units, c.c_custkey == units.o_custkey, "left").join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("subject_id"), F.col("c_name").alias("name"), "units", F.col("n_regionkey").alias("region"))


C = """
    tenant as (
      select o_custkey as subject_id, 't:' || o_custkey as t_id, date_trunc('month', max(o_orderdate))::date as t_period, min(o_totalprice) as t_value,
             count(*) as units, case when o_custkey % 4 = 3 then 'bedroom_specific' when o_custkey % 5 = 0 then 'studio_mix' else 'all_units' end as t_scope,
             case when o_custkey % 8 = 3 then 2 when o_custkey % 8 = 7 then 3 end as t_bedroom,
             case o_custkey % 3 when 0 then 'gross' when 1 then 'net' end as t_gross_net, 'art-' || (o_custkey % 7) as t_artifact
      from orders group by o_custkey),
    assign as (select c_custkey as subject_id, c_nationkey as nation, 'zcta:' || lpad(c_nationkey::varchar, 5, '0') as area_id from customer where c_custkey % 17 <> 0),
    mbase as (select s_nationkey as nation, (l_linenumber - 1) % 5 as bed, sum(l_extendedprice::decimal(18,2)) as total, count(*) as n, max(l_extendedprice) as top
              from lineitem join supplier on l_suppkey = s_suppkey group by all),
    mwhole as (select nation, sum(total) as total, sum(n) as n, max(top) as top from mbase group by 1),
    market as (
      select nation, 'hud-safmr:' || nation || ':' || bed as m_id, (date '2001-07-01' - to_months(2 * nation))::date as m_period,
             total::double / n::double as m_value, 'bedroom_specific' as m_scope, bed as m_bedroom, 'gross' as m_gross_net,
             'regulatory_market_benchmark' as m_basis, 'hud_safmr' as market_source, 'art-hud' as m_artifact from mbase
      union all select nation, 'zori:' || nation || ':all_units', (date '2001-07-01' - to_months(case when nation % 2 = 0 then 0 else nation end))::date,
             total::double / n::double, 'all_units', null, 'unknown', 'index', 'zori', 'art-zori' from mwhole
      union all select nation, 'renthop:' || nation || ':1', date '2001-07-01', top, 'bedroom_specific', 1, 'gross', 'asking', 'renthop', 'art-rent'
             from mwhole where nation % 5 = 0),
    pairs as (
      select t.*, a.area_id, m.*, t.subject_id || '__' || m.m_id as comparison_id,
             abs((year(t_period) - year(m_period)) * 12 + month(t_period) - month(m_period)) as months
      from tenant t join assign a using (subject_id) join market m using (nation)
      where (m_basis = 'regulatory_market_benchmark' and m_bedroom = 2) or m_basis in ('index', 'asking')),
    scored as (
      select *, case when months = 0 then 'same_month' when months <= 6 then 'near' when months <= 18 then 'representative_window'
                     when months <= 36 then 'context_only' else 'too_far' end as period_class,
        case when t_bedroom = m_bedroom then 'same_bedroom' when t_scope = 'all_units' and m_scope = 'all_units' then 'all_unit_vs_all_unit'
             when t_scope = 'all_units' then 'development_wide_vs_representative_bedroom' else 'incompatible' end as scope_kind,
        coalesce(t_gross_net = m_gross_net, true) or m_gross_net = 'unknown' as gross_net_ok,
        m_value - t_value as monthly_wedge, (m_value - t_value) * 12 as annual_wedge, 1 - t_value / m_value as pct_below from pairs),
    comps as (
      select *, case when period_class = 'too_far' then 'unavailable' when period_class = 'context_only' then 'context_only'
          when scope_kind in ('development_wide_vs_representative_bedroom', 'incompatible') or period_class = 'representative_window' then 'representative'
          when scope_kind = 'same_bedroom' and period_class = 'same_month' and gross_net_ok and m_basis = 'regulatory_market_benchmark' and nation % 2 = 0
            then 'exact' else 'strong' end as quality from scored),
    ranked as (select *, case quality when 'exact' then 0 when 'strong' then 1 when 'representative' then 2 when 'context_only' then 3 else 4 end as qr from comps),
    pool as (select * from ranked where qr <= 2),
    placed as (select *, row_number() over (partition by subject_id order by qr, -abs(monthly_wedge), comparison_id) as rn from pool),
    best as (select * from placed where rn = 1),
    subj as (select c_custkey as subject_id, c_name as name, u.units, n_regionkey as region from customer join nation on c_nationkey = n_nationkey
             left join (select o_custkey, count(*) as units from orders group by 1) u on u.o_custkey = c_custkey)"""

_W = "round(monthly_wedge, 4) as monthly_wedge, round(annual_wedge, 4) as annual_wedge, round(pct_below, 8) as pct_below"


def wedges(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("monthly_wedge", 4).alias("monthly_wedge"), F.round("annual_wedge", 4).alias("annual_wedge"),
                     F.round("pct_below", 8).alias("pct_below"))


@R.add("q_comparator_join", f"with {C} select subject_id, area_id, t_id, m_id, t_value, round(m_value, 6) as m_value, comparison_id from pairs")
def _(spark, sf):
    return pairs(spark, sf).select("subject_id", "area_id", "t_id", "m_id", "t_value", F.round("m_value", 6).alias("m_value"), "comparison_id")


@R.add("q_quality_class", f"with {C} select comparison_id, months, period_class, scope_kind, gross_net_ok, quality, market_source, {_W} from comps")
def _(spark, sf):
    return wedges(comparisons(spark, sf), "comparison_id", "months", "period_class", "scope_kind", "gross_net_ok", "quality", "market_source")


@R.add("q_quality_reasons", f"""with {C}, r as (select comparison_id, concat_ws(' | ',
        case scope_kind when 'same_bedroom' then 'same bedroom scope (' || t_bedroom || 'BR)'
          when 'all_unit_vs_all_unit' then 'all-unit actual vs all-unit market measure'
          when 'development_wide_vs_representative_bedroom' then 'tenant observation is development-wide | market observation is ' || m_bedroom || 'BR-specific'
          else 'unit scopes differ (tenant=' || t_scope || coalesce('/' || t_bedroom || 'BR', '') || ', market=' || m_scope || coalesce('/' || m_bedroom || 'BR', '') || ')' end,
        case when months > 0 then 'observation periods differ by ' || months || ' month(s)' end,
        case period_class when 'representative_window' then 'periods differ materially but remain useful for scale'
          when 'context_only' then 'periods differ by more than 18 months (orientation only)'
          when 'too_far' then 'periods differ by more than 36 months — no defensible non-historical comparison' end,
        case when period_class <> 'too_far' then concat_ws(' | ',
        case when t_gross_net is null then 'tenant gross/net definition is unknown' end,
        case when m_gross_net = 'unknown' then 'market gross/net definition is unknown' end,
        case when not gross_net_ok then 'gross/net mismatch (tenant=' || t_gross_net || ', market=' || m_gross_net || ')'
             when coalesce(t_gross_net, 'unknown') <> m_gross_net then
               'gross/net partially unknown (tenant=' || coalesce(t_gross_net, 'unknown') || ', market=' || m_gross_net || ') — not inferred' end,
        case when gross_net_ok and subject_id % 10 = 1 then 'tenant utility basis: tenant pays electric' end,
        case m_basis when 'asking' then 'market geography is a named neighborhood rather than the exact development footprint'
          when 'index' then 'market comparator is Zillow ZORI (typical observed market-rent index), not median asking rent and not bedroom-specific'
          else 'market comparator is HUD SAFMR (regulatory gross-rent benchmark), not median asking rent' end,
        case when m_basis <> 'asking' then 'market geography is ZIP/ZCTA ' || substr(area_id, 6) || ' rather than the exact development footprint' end) end,
        case when quality = 'strong' and not gross_net_ok then 'one mild gross/net definition mismatch is disclosed' end,
        case when subject_id % 6 = 0 then 'curated pair' end) as reasons from comps) select * from r""")
def _(spark, sf):
    return comparisons(spark, sf).select("comparison_id", F.array_join("reasons", " | ").alias("reasons"))


@R.add("q_rejected_pairs", f"""with {C}
    select comparison_id, case when t_value > 200000 then 'missing_value' when m_value > 50000 then 'market_not_positive' else 'tenant_negative' end as reason
    from pairs where t_value > 200000 or m_value > 50000 or subject_id % 9 = 0""")
def _(spark, sf):
    p = pairs(spark, sf)
    bad = p.withColumn("_t", F.col("t_value")).withColumn(
        "t_value", F.when(F.col("_t") <= 200000, F.when(F.col("subject_id") % 9 == 0, -1.0).otherwise(F.col("_t")))).withColumn(
        "m_value", F.when(F.col("m_value") > 50000, 0.0).otherwise(F.col("m_value")))
    return compare.rejected_pairs(bad).select("comparison_id", "reason")


@R.add("q_best_per_subject", f"with {C} select subject_id, comparison_id, quality, {_W} from best")
def _(spark, sf):
    return wedges(best(spark, sf), "subject_id", "comparison_id", "quality")


def _preferred_sql(hit: str, beds: str, drop: str) -> str:
    return f"""with {C}, f as (select *, {hit} as hit, {beds} as beds, market_source = 'zori' as units_only from pool),
    g as (select *, bool_or(hit) over (partition by subject_id) as any_hit from f),
    p as (select *, bool_or(beds) over (partition by subject_id) as any_beds, bool_and(units_only) over (partition by subject_id) as all_units
          from g where hit or not any_hit),
    b as (select * from p where beds or not any_beds qualify row_number() over (partition by subject_id order by qr, -abs(monthly_wedge), comparison_id) = 1)
    select subject_id, comparison_id, market_source from b where {drop}"""


@R.add("q_preferred_source", _preferred_sql("market_source = 'zori'", "true", "true"))
def _(spark, sf):
    return sel.preferred(comparisons(spark, sf), source="zori").select("subject_id", "comparison_id", "market_source")


@R.add("q_preferred_bedroom", _preferred_sql("true", "coalesce(m_bedroom = 1, false)", "any_beds or not all_units"))
def _(spark, sf):
    return sel.preferred(comparisons(spark, sf), bedroom=1).select("subject_id", "comparison_id", "market_source")


@R.add("q_preferred_strict", f"""with {C}
    select 'source' as ask, subject_id, comparison_id from pool where market_source = 'renthop'
      qualify row_number() over (partition by subject_id order by qr, -abs(monthly_wedge), comparison_id) = 1
    union all (select 'bedroom', subject_id, comparison_id from pool where market_source <> 'zori' and m_bedroom = 2
      qualify row_number() over (partition by subject_id order by qr, -abs(monthly_wedge), comparison_id) = 1)
    union all (with s as (select * from ranked where quality = 'strong' qualify row_number() over (partition by subject_id order by -abs(monthly_wedge), comparison_id) = 1)
      select 'strong', subject_id, comparison_id from s union all select 'strong', subject_id, comparison_id from best where subject_id not in (select subject_id from s))""")
def _(spark, sf):
    c = comparisons(spark, sf)
    parts = [("source", sel.strict(c, source="renthop")), ("bedroom", sel.strict(c, bedroom=2)), ("strong", sel.strict(c, classes=("strong",)))]
    out = [df.select(F.lit(n).alias("ask"), "subject_id", "comparison_id") for n, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@R.add("q_alternatives", f"with {C} select subject_id, rn - 1 as place, comparison_id from placed where rn between 2 and 9")
def _(spark, sf):
    return sel.alternatives(comparisons(spark, sf)).select("subject_id", "place", "comparison_id")


@R.add("q_ranked_list", f"with {C} select comparison_id, row_number() over (order by qr, -abs(monthly_wedge), comparison_id) as rank from ranked where qr <= 3")
def _(spark, sf):
    return joins.number_rows(sel.allowed(comparisons(spark, sf), context=True), sel.best_first()).select("comparison_id", "rank")


@R.add("q_ranking", f"""with {C}
    select b.subject_id, s.name, s.units, b.quality, round(pct_below, 8) as metric_value,
           row_number() over (order by qr, -abs(monthly_wedge), -pct_below, b.subject_id) as rank from best b join subj s using (subject_id)""")
def _(spark, sf):
    r = sel.ranking(best(spark, sf).drop("units"), subjects(spark, sf), "pct_below")
    return r.select("subject_id", "name", "units", "quality", F.round("metric_value", 8).alias("metric_value"), "rank")


def metrics(spark, sf) -> DataFrame:
    return sel.metric_rows(subjects(spark, sf), best(spark, sf), market(spark, sf), tenant(spark, sf))


_METRICS = C + """,
    metrics as (select s.*, comparison_id, quality, monthly_wedge, annual_wedge, pct_below, market_source, m_value as market_value, t.t_value as tenant_value,
                       coalesce(qr, -1) as class_ordinal, comparison_id is not null as has_comparison
                from subj s left join best using (subject_id) left join tenant t using (subject_id))"""


@R.add("q_metric_rows", f"""with {_METRICS}
    select subject_id, name, units, region, comparison_id, quality, market_source, round(market_value, 6) as market_value, tenant_value, class_ordinal,
           has_comparison, {_W} from metrics""")
def _(spark, sf):
    return wedges(metrics(spark, sf), "subject_id", "name", "units", "region", "comparison_id", "quality", "market_source",
                  F.round("market_value", 6).alias("market_value"), "tenant_value", "class_ordinal", "has_comparison")


@R.add("q_metric_channel", f"""with {_METRICS}
    select subject_id, round(pct_below, 8) as pct_below, round(monthly_wedge, 4) as monthly, round(market_value, 4) as market, tenant_value as actual,
           case when class_ordinal >= 0 then class_ordinal end::double as quality from metrics""")
def _(spark, sf):
    return metrics(spark, sf).select(
        "subject_id", F.round(rules.metric_value("pct-below"), 8).alias("pct_below"), F.round(rules.metric_value("monthly-wedge"), 4).alias("monthly"),
        F.round(rules.metric_value("market-rent"), 4).alias("market"), rules.metric_value("actual-rent").alias("actual"),
        rules.metric_value("quality").alias("quality"))


@R.add("q_feature_enrichment", f"""with {_METRICS}
    select p.feature, p.subject_id, coalesce(has_comparison, false) as has_comparison, coalesce(class_ordinal, -1) as class_ordinal, tenant_value,
           round(market_value, 6) as market_value, market_source, coalesce(p.subject_id % 4 = 0 and tenant_value is not null, false) as stale
    from (select s_suppkey as feature, s_suppkey * 7 as subject_id from supplier) p left join metrics using (subject_id)""")
def _(spark, sf):
    f = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("feature"), (F.col("s_suppkey") * 7).alias("subject_id"))
    # every fourth subject's value is from before the newest vintage
    m = metrics(spark, sf).withColumn("stale", (F.col("subject_id") % 4 == 0) & F.col("tenant_value").isNotNull())
    return sel.enrich(f, m).withColumn("market_value", F.round("market_value", 6))


@R.add("q_sorts", f"""with {_METRICS}, m as (select * from metrics where has_comparison)
    select * from (select 'monthly-wedge' as sort, subject_id from m order by monthly_wedge desc, subject_id limit 3)
    union all select * from (select 'pct-below', subject_id from m order by pct_below desc, subject_id limit 3)
    union all select * from (select 'units', subject_id from m order by coalesce(units, 0) desc, subject_id limit 3)
    union all select * from (select 'name', subject_id from m order by name, subject_id limit 3)""")
def _(spark, sf):
    m = metrics(spark, sf)
    out = [sel.top_rows(m, 3, s).select(F.lit(s).alias("sort"), "subject_id") for s in sel.SORTS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@R.add("q_top_per_area", f"""with {_METRICS}
    select region, subject_id, row_number() over (partition by region order by monthly_wedge desc, subject_id) as place from metrics where has_comparison
    qualify place <= 40""")
def _(spark, sf):
    m = metrics(spark, sf).where("has_comparison")
    return joins.top_per_key(m, ["region"], 40, F.desc("monthly_wedge"), F.col("subject_id"), name="place").select("region", "subject_id", "place")


def _summary_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    return f"""with {_METRICS}, r as (select *, case when units > 0 then units * 0.37 else 1 end::decimal(12,4) as u from metrics where monthly_wedge is not null),
    c as (select *, sum(u) over ({part}order by monthly_wedge) as cum, sum(u) over ({part.strip()}) as tot from r)
    select {keys}count(*) as n, round(median(monthly_wedge), 4) as unweighted_median,
           round(sum(monthly_wedge::decimal(20,6) * u)::double / sum(u)::double, 4) as weighted_mean,
           round(min(monthly_wedge) filter (where cum * 2 >= tot), 4) as weighted_median_proxy, round(sum(u)::double, 4) as total_units
    from c {'group by ' + by if by else ''}"""


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[F.round(c, 4).alias(c) for c in ("unweighted_median", "weighted_mean", "weighted_median_proxy", "total_units")])


def shared_units(spark, sf) -> DataFrame:
    """Metric rows whose unit counts are fractions."""
    return metrics(spark, sf).withColumn("units", F.col("units") * F.lit(0.37))


@R.add("q_summary", _summary_sql(""))
def _(spark, sf):
    return _summary(sel.summary(shared_units(spark, sf), "monthly_wedge"))


@R.add("q_summary_by_region", _summary_sql("region"))
def _(spark, sf):
    return _summary(sel.summary(shared_units(spark, sf), "monthly_wedge", ["region"]), "region")


@R.add("q_class_counts", f"""with {C}
    select q as quality, count(comparison_id) as n from (select unnest(['exact','strong','representative','context_only','unavailable']) as q)
    left join comps on quality = q group by 1""")
def _(spark, sf):
    return sel.class_counts(comparisons(spark, sf))


@R.add("q_comparison_index", f"""with {C}, cls as (select unnest(['exact','strong','representative','context_only','unavailable']) as q),
    r as (select b.subject_id, monthly_wedge, case when s.units > 0 then s.units else 1 end as u,
                 row_number() over (order by qr, -abs(monthly_wedge), -monthly_wedge, b.subject_id) as rank from best b left join subj s using (subject_id)),
    c as (select *, sum(u) over (order by monthly_wedge) as cum, sum(u) over () as tot from r)
    select 'count' as part, 'comparisons' as name, count(*)::double as value from comps union all select 'count', 'best', count(*) from best
    union all select 'comparison_class', q, count(comparison_id) from cls left join comps on quality = q group by all
    union all select 'best_class', q, count(comparison_id) from cls left join best on quality = q group by all
    union all select 'summary', 'n', count(*) from r union all select 'summary', 'total_units', sum(u) from r
    union all select 'summary', 'unweighted_median', round(median(monthly_wedge), 4) from r
    union all select 'summary', 'weighted_mean', round(sum(monthly_wedge::decimal(20,6) * u)::double / sum(u), 4) from r
    union all select 'summary', 'weighted_median_proxy', round(min(monthly_wedge) filter (where cum * 2 >= tot), 4) from c
    union all select 'ranking', subject_id::varchar, rank from r where rank <= 10""")
def _(spark, sf):
    c = comparisons(spark, sf)
    b = sel.best_per_subject(c)
    ranked_rows = sel.ranking(b.drop("units"), subjects(spark, sf))
    return sel.index(c, b, ranked_rows).withColumn("value", F.round("value", 4))


@R.add("q_ranking_guard", f"with {C} select comparison_id from ranked where qr <= 2 and not (subject_id % 3 = 0 or subject_id % 7 = 0)")
def _(spark, sf):
    c = comparisons(spark, sf).withColumn("observation_type", F.when(F.col("subject_id") % 3 == 0, "population_rent")).withColumn(
        "derived_type", F.when(F.col("subject_id") % 7 == 0, "population_rent_gap"))
    return sel.allowed(c).select("comparison_id")


@R.add("q_impossible_requests", f"""with {C}
    select market_source, m_bedroom, count(*) as n, count(*) filter (where m_scope = 'all_units' and m_bedroom is null) as impossible from comps group by all""")
def _(spark, sf):
    hit = rules.impossible_request(F.col("m_scope"), F.col("m_bedroom"), F.lit(2))
    return comparisons(spark, sf).groupBy("market_source", "m_bedroom").agg(F.count("*").alias("n"), F.count_if(hit).alias("impossible"))


@R.add("q_attach_market", f"""with {C}
    select comparison_id, case when subject_id % 2 = 0 then 'given' else market_source end as market_source,
           case when subject_id % 5 <> 0 then m_bedroom end as market_bedroom, case when subject_id % 5 <> 0 then m_scope end as market_scope,
           case when subject_id % 5 <> 0 then substr(area_id, 6) end as market_zcta from comps""")
def _(spark, sf):
    # every fifth comparison points to an observation that is not there
    c = comparisons(spark, sf).select("comparison_id", F.when(F.col("subject_id") % 2 == 0, "given").alias("market_source"),
                                      F.when(F.col("subject_id") % 5 == 0, "gone").otherwise(F.col("m_id")).alias("m_id"))
    return compare.attach_market(c, market(spark, sf)).select("comparison_id", "market_source", "market_bedroom", "market_scope", "market_zcta")


@R.add("q_lineage", f"""with {C}
    select comparison_id, t_value, round(m_value, 6) as m_value, c_name as name, area_id, 'sha-' || t_artifact as t_sha256,
           case when m_artifact = 'art-hud' then 'sha-art-hud' end as m_sha256, round(m_value - t_value, 4) as recomputed, subject_id % 8 <> 0 as matches,
           case m_basis when 'asking' then 'measured (listing median)' when 'index' then 'measured (observed-rent index)' else 'measured (regulatory benchmark)' end
             as market_measured from comps join customer on c_custkey = subject_id""")
def _(spark, sf):
    c = comparisons(spark, sf).withColumn("monthly_wedge", F.when(F.col("subject_id") % 8 == 0, F.col("monthly_wedge") + 1).otherwise(F.col("monthly_wedge")))
    arts = table(spark, sf, "region").select(F.explode(F.lit([f"art-{i}" for i in range(7)] + ["art-hud"])).alias("artifact_id")).distinct().select(
        "artifact_id", F.concat(F.lit("sha-"), "artifact_id").alias("sha256"))
    out = compare.lineage(c, tenant(spark, sf), market(spark, sf), subjects(spark, sf), assignments(spark, sf), arts)
    return out.select("comparison_id", "t_value", F.round("m_value", 6).alias("m_value"), "name", "area_id", "t_sha256", "m_sha256",
                      F.round("recomputed", 4).alias("recomputed"), "matches", "market_measured")


@R.add("q_resolve_pair", f"""with {C}
    select comparison_id, round(m_value, 6) as market_value, case when nation % 2 = 0 then 'observation' else 'package' end as market_from
    from comps where m_basis <> 'asking'
    union all select comparison_id, case when nation % 2 = 0 then m_value end, case when nation % 2 = 0 then 'observation' end from comps where m_basis = 'asking'""")
def _(spark, sf):
    m = market(spark, sf)
    package = m.where("m_basis <> 'asking'").select(
        rules.market_source(F.col("m_basis"), F.col("m_id"), F.col("m_artifact")).alias("market_source"), "area_id",
        F.coalesce("m_bedroom", F.lit(-1)).alias("p_bedroom"), F.col("m_value").alias("p_value"))
    out = compare.resolve_market(comparisons(spark, sf).drop("m_value"), m.where("area_nation % 2 = 0"), package)
    return out.select("comparison_id", F.round("market_value", 6).alias("market_value"), "market_from")


def _faulty(spark, sf) -> DataFrame:
    s = F.col("subject_id")
    return comparisons(spark, sf).select(
        "comparison_id", F.when(s % 11 == 0, "gone").otherwise(F.col("t_id")).alias("t_id"), "m_id",
        F.when(s % 12 == 0, F.col("monthly_wedge") + 1).otherwise(F.col("monthly_wedge")).alias("monthly_wedge"), "annual_wedge", "pct_below",
        F.when(s % 13 == 0, "").otherwise(F.col("quality")).alias("quality"), "reasons")


_FAULTS = """
    faults as (select comparison_id, 'references_resolve' as contract from comps where subject_id % 11 = 0
      union all select comparison_id, 'monthly_wedge_recomputes' from comps where subject_id % 12 = 0 and subject_id % 11 <> 0
      union all select comparison_id, 'quality_present' from comps where subject_id % 13 = 0)"""


@R.add("q_cross_contracts", f"with {C}, {_FAULTS} select * from faults")
def _(spark, sf):
    return checks.comparison_contracts(_faulty(spark, sf), tenant(spark, sf), market(spark, sf))


@R.add("q_acceptance", f"""with {C}, {_FAULTS}
    select (select count(*) from faults) + (select count(*) from customer where c_custkey % 17 = 0) as problems, false as accepted""")
def _(spark, sf):
    broken = checks.comparison_contracts(_faulty(spark, sf), tenant(spark, sf), market(spark, sf))
    want = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))
    missing = checks.completeness(want, assignments(spark, sf), ["subject_id"])
    return checks.acceptance({"contracts": broken, "assignments": missing})[0]
