"""Best comparison per subject, alternatives, rankings and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import rules
from parcelwise.operators import median as med
from parcelwise.operators.joins import first_per_key, number_rows, top_per_key


def best_first() -> list[Column]:
    """Class rank, then the larger absolute wedge, then the id."""
    return [rules.class_rank(F.col("quality")), -F.abs(F.coalesce("monthly_wedge", F.lit(0.0))),
            F.coalesce("comparison_id", F.lit(""))]


def rankable(comparisons: DataFrame) -> DataFrame:
    """Survey cells and their gaps never rank subjects."""
    out = comparisons
    if "observation_type" in out.columns:
        out = out.where(F.coalesce("observation_type", F.lit("")) != "population_rent")
    if "derived_type" in out.columns:
        out = out.where(F.coalesce("derived_type", F.lit("")) != "population_rent_gap")
    return out


def allowed(
    comparisons: DataFrame, classes: Sequence[str] = rules.DEFAULT_CLASSES, context: bool = False
) -> DataFrame:
    """Quality filter; context-only rows are opt-in."""
    names = [*classes, *(["context_only"] if context and "context_only" not in classes else [])]
    return rankable(comparisons).where(F.coalesce("quality", F.lit("unavailable")).isin(*names))


def ranked(comparisons: DataFrame, **kw) -> DataFrame:
    """The whole list best first (one range sort)."""
    return allowed(comparisons, **kw).orderBy(*best_first())


def best_per_subject(comparisons: DataFrame, **kw) -> DataFrame:
    pool = allowed(comparisons, **kw).where(F.coalesce(F.col("subject_id").cast("string"), F.lit("")) != "")
    return first_per_key(pool, ["subject_id"], *best_first())


def preferred(
    comparisons: DataFrame, source: str | None = None, bedroom: int | None = None, **kw
) -> DataFrame:
    """Best per subject with wishes: a source if the subject has it, a bedroom count if the rest has it.

    A wish is the first sort key, so no second pass over the group is needed. When no row answers the bedroom
    wish and only all-unit rows are left, the subject has no answer (for no source wish or the all-unit source).
    """
    pool = allowed(comparisons, **kw).where(F.coalesce(F.col("subject_id").cast("string"), F.lit("")) != "")
    cid = F.lower(F.coalesce("comparison_id", F.lit("")))
    hit = F.lit(False)
    if source:
        s = source.lower()
        hit = (F.lower(F.coalesce("market_source", F.lit(""))) == s) | cid.contains(s) | F.lower(
            F.coalesce("m_id", F.lit(""))).contains(s)
    beds = F.lit(False)
    if bedroom is not None:
        beds = F.coalesce(F.col("market_bedroom") == bedroom, F.lit(False)) | cid.contains(f"{bedroom}br")
    units_only = (F.coalesce("market_scope", F.lit("")) == "all_units") | (
        F.col("market_bedroom").isNull() & F.coalesce("comparison_id", F.lit("")).contains("all_units"))
    cols = [c for c in pool.columns if c != "subject_id"]
    flagged = pool.select("*", hit.alias("_hit"), beds.alias("_beds"), units_only.alias("_units"))
    order = F.struct((~F.col("_hit")).alias("a"), (~F.col("_beds")).alias("b"),
                     *[c.alias(f"k{i}") for i, c in enumerate(best_first())])
    best = flagged.groupBy("subject_id").agg(
        F.min_by(F.struct(*cols, "_hit", "_beds"), order).alias("_best"),
        F.bool_and(F.when(F.col("_hit"), F.col("_units"))).alias("_hit_units"),
        F.bool_and("_units").alias("_all_units"))
    if bedroom is not None and source in (None, "zori"):
        rest = F.when(F.col("_best")["_hit"], F.col("_hit_units")).otherwise(F.col("_all_units"))
        best = best.where(F.col("_best")["_beds"] | ~rest)
    return best.select("subject_id", *[F.col("_best")[c].alias(c) for c in cols])


def strict(comparisons: DataFrame, source: str | None = None, bedroom: int | None = None, **kw) -> DataFrame:
    """Best per subject where a wish that nothing answers gives no row at all.

    Without any wish a subject whose pool is empty falls back to its best row of the default filter.
    """
    own = F.coalesce(F.nullif("market_source", F.lit("")), rules.source_from_id(F.col("comparison_id")), F.lit("unknown"))
    pool = allowed(comparisons, **kw).where(F.coalesce(F.col("subject_id").cast("string"), F.lit("")) != "")
    if source:
        pool = pool.where(own == source)
    if bedroom is not None:
        if source == "zori":
            return pool.where("false")
        by_id = F.lower("comparison_id").contains(f"{bedroom}br")
        beds = F.when(F.col("market_bedroom").isNotNull(), F.col("market_bedroom") == bedroom).otherwise(by_id)
        pool = pool.where((own != "zori") & beds)
    chosen = first_per_key(pool, ["subject_id"], *best_first())
    if source or bedroom is not None:
        return chosen
    fallback = best_per_subject(comparisons)
    return chosen.unionByName(fallback.join(chosen.select("subject_id"), "subject_id", "left_anti"))


def alternatives(comparisons: DataFrame, limit: int = 8, **kw) -> DataFrame:
    """The next best rows after the best one, ``place`` 1 to ``limit``."""
    pool = allowed(comparisons, **kw).where(F.coalesce(F.col("subject_id").cast("string"), F.lit("")) != "")
    top = top_per_key(pool, ["subject_id"], limit + 1, *best_first(), name="place")
    return top.withColumn("place", F.col("place") - 1).where("place > 0")


def ranking(best: DataFrame, subjects: DataFrame, metric: str = "monthly_wedge") -> DataFrame:
    """Ranking rows with names and units, numbered from 1 over all subjects."""
    rows = best.join(subjects.select("subject_id", "name", "units"), "subject_id", "left").withColumn(
        "metric_value", F.col(metric))
    value = F.coalesce("metric_value", F.lit(0.0))
    order = [rules.class_rank(F.col("quality")), -F.abs(F.coalesce("monthly_wedge", F.lit(0.0))),
             value if metric == "tenant_value" else -value, F.col("subject_id")]
    return number_rows(rows, order)


SORTS = {
    "monthly-wedge": ("monthly_wedge", False), "pct-below": ("pct_below", False), "units": ("units", False),
    "name": ("name", True),
}


def sorted_rows(rows: DataFrame, sort: str = "monthly-wedge") -> DataFrame:
    """Metric rows with a comparison, in one of four orders; missing numbers count as zero."""
    column, up = SORTS[sort]
    key = F.col(column).asc() if up else F.coalesce(F.col(column).cast("double"), F.lit(0.0)).desc()
    return rows.where("comparison_id is not null").orderBy(key, "subject_id")


def top_rows(rows: DataFrame, n: int, sort: str = "monthly-wedge") -> DataFrame:
    return sorted_rows(rows, sort).limit(n)


def class_counts(comparisons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count per class with every class present."""
    counts = comparisons.groupBy(*by, F.coalesce("quality", F.lit("unavailable")).alias("quality")).agg(
        F.count("*").alias("n"))
    if by:
        groups = counts.select(*by).distinct().withColumn("quality", F.explode(F.lit(list(rules.CLASSES))))
        return groups.join(counts, [*by, "quality"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    classes = comparisons.sparkSession.range(1).select(F.explode(F.lit(list(rules.CLASSES))).alias("quality"))
    return classes.join(counts, "quality", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def unit_weight(c: Column) -> Column:
    """Unit count as weight; a missing or non-positive count weighs one."""
    return F.when(c > 0, c).otherwise(1)


def summary(rows: DataFrame, field: str, by: Sequence[str] = (), units: str = "units") -> DataFrame:
    """Count, plain median, unit-weighted mean and unit-weighted median proxy, by optional group.

    Unit counts may be fractions (four decimals count); one that is missing or not positive weighs one.

    Both medians take the bucketed path, so a single global group is not collected into one task.
    """
    keys = list(by) or ["_all"]
    base = rows if by else rows.withColumn("_all", F.lit(0))
    base = base.where(F.col(field).isNotNull()).select(
        *keys, F.col(field).cast("double").alias("_x"), unit_weight(F.col(units).cast("double")).cast("decimal(12,4)").alias("_u"))
    # weight number 0 is the unit count, number 1 counts every row once: both medians from one pass
    ready = med.weighted_rows(base, F.col("_x"), F.col("_u"), lambda i: F.lit(1.0), 1, med.EXACT)
    middle = med.medians(ready, keys).groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("_m"))).alias("unweighted_median"),
        F.max(F.when(F.col("_r") == 0, F.col("_first"))).alias("weighted_median_proxy"))
    exact = F.col("_x").cast("decimal(20,6)")
    means = base.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum(exact * F.col("_u")).cast("double"), F.sum("_u").cast("double")).alias("weighted_mean"),
        F.sum("_u").cast("double").alias("total_units"))
    if by:
        return means.join(middle, keys)
    both = middle.select(F.struct("unweighted_median", "weighted_median_proxy")).scalar()  # one row
    return means.drop("_all").withColumn("_both", both).select("*", "_both.*").drop("_both")


def index(comparisons: DataFrame, best: DataFrame, ranked_rows: DataFrame, field: str = "monthly_wedge") -> DataFrame:
    """The composed index as rows (part, name, value): how many comparisons and best rows there are, both by class, the
    summary of ``field`` over the ranked rows, and the first ten places of the ranking."""
    row = lambda part, name, value: (F.lit(part).alias("part"), name.alias("name"), value.cast("double").alias("value"))
    counts = comparisons.agg(F.count("*").alias("n")).select(*row("count", F.lit("comparisons"), F.col("n"))).unionByName(
        best.agg(F.count("*").alias("n")).select(*row("count", F.lit("best"), F.col("n"))))
    classes = class_counts(comparisons).select(*row("comparison_class", F.col("quality"), F.col("n"))).unionByName(
        class_counts(best).select(*row("best_class", F.col("quality"), F.col("n"))))
    s = summary(ranked_rows, field)
    stats = s.unpivot([], [F.col(c).cast("double").alias(c) for c in s.columns], "name", "value").select(*row("summary", F.col("name"), F.col("value")))
    top = ranked_rows.where("rank <= 10").select(*row("ranking", F.col("subject_id").cast("string"), F.col("rank")))
    return counts.unionByName(classes).unionByName(stats).unionByName(top)


def enrich(features: DataFrame, metrics: DataFrame) -> DataFrame:
    """Features (feature, subject_id) with their subject's class, values, market source and stale flag; features whose
    subject is unknown stay, without a comparison and not stale."""
    m = metrics.select("subject_id", "has_comparison", "class_ordinal", "tenant_value", "market_value", "market_source", "stale")
    no = F.lit(False)
    return features.join(m, "subject_id", "left").select(
        "feature", "subject_id", F.coalesce("has_comparison", no).alias("has_comparison"), F.coalesce("class_ordinal", F.lit(-1)).alias("class_ordinal"),
        "tenant_value", "market_value", "market_source", F.coalesce("stale", no).alias("stale"))


def metric_rows(subjects: DataFrame, best: DataFrame, market: DataFrame, tenant_first: DataFrame) -> DataFrame:
    """One row per subject: best comparison, its market value and the first tenant value; all subjects stay."""
    b = best.select("subject_id", "comparison_id", "quality", "monthly_wedge", "annual_wedge", "pct_below",
                    "market_source", "m_id")
    m = market.select("m_id", F.col("m_value").alias("market_value"))
    t = tenant_first.select("subject_id", F.col("t_value").alias("tenant_value"))
    out = subjects.join(b, "subject_id", "left").join(m, "m_id", "left").join(t, "subject_id", "left").drop("m_id")
    ordinal = F.when(F.col("quality").isNull(), -1).otherwise(rules.class_rank(F.col("quality"), -1))
    return out.withColumn("class_ordinal", ordinal).withColumn("has_comparison", F.col("comparison_id").isNotNull())
