"""Survey estimates over overlapping cells in one pass.

A row belongs to several cells (its own area and the whole city, a narrow and a wide population). Rows are
repeated per cell and summed by (cell, value) in the map task, so the shuffle carries sums and not raw rows.
Cells without any row stay in the output.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.arrays import when_list
from parcelwise.functions.typed import finite
from parcelwise.operators import median as med


@dataclass(frozen=True)
class Quality:
    """Fixed default thresholds; they add cautions and never hide a value."""

    small_sample: int = 30
    reliable_cv: float = 0.15
    high_cv: float = 0.30


@dataclass(frozen=True)
class Replicates:
    count: int
    multiplier: float = 0.05
    critical: float = 1.96


@dataclass(frozen=True)
class Label:
    """A dimension without overlap: the column holds the member's id."""

    column: Column
    ids: tuple[str, ...]

    def __iter__(self):
        return iter(self.ids)


Members = Mapping[str, Column] | Label


def memberships(members: Members) -> Column:
    """Ids of the members whose condition holds, as a list."""
    if isinstance(members, Label):
        return F.filter(F.array(members.column), lambda x: x.isin(*members.ids))
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(k)) for k, cond in members.items()]))


def marks(members: Members) -> tuple[Column, Callable[[Column], Column]]:
    """Membership as one bit per member, and how to list the ids again; more than a number's bits stay a list.

    A number is cheaper to make and to group by in each row than a list; the lists are for the few groups.
    """
    ids = list(members)
    if len(ids) > 62:
        return memberships(members), lambda made: made
    conditions = [members.column == k for k in ids] if isinstance(members, Label) else list(members.values())
    bits = F.lit(0).cast("bigint")
    for i, cond in enumerate(conditions):
        bits = bits.bitwiseOR(F.when(cond, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits, lambda made: F.array_compact(F.array(*[F.when(made.bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(ids)]))


def cohort(year: Column, low: int | None = None, high: int | None = None) -> Column:
    """Year range with open ends; a missing year matches no bounded or open range."""
    cond = year.isNotNull()
    if low is not None:
        cond = cond & (year >= low)
    if high is not None:
        cond = cond & (year <= high)
    return cond


def skeleton(df: DataFrame, dims: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every combination of the given categories, one row each, by exploding short literal lists."""
    out = df.sparkSession.range(1).select(F.lit(None).alias("_"))
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.lit(list(values))))
    return out.drop("_")


# The sentences of the caveats.
def cell_caveats(n: Column, cv: Column, q: Quality) -> Column:
    return when_list(
        (n < q.small_sample, F.concat(F.lit("Small sample: "), n.cast("string"), F.lit(" rent responses."))),
        (cv.isNull(), "Uncertainty could not be estimated"),
        (cv > q.high_cv, "High sampling uncertainty."),
        ((cv > q.reliable_cv) & (cv <= q.high_cv), "Higher sampling uncertainty."),
    )


def cell_estimates(
    rows: DataFrame, dims: Mapping[str, Members], value: str, weight: str, replicates: Column | med.Weights | None = None,
    reps: Replicates | None = None, quality: Quality = Quality(), kind: str = med.EXACT,
) -> DataFrame:
    """Weighted median estimate of every cell of the crossed dimensions.

    ``dims`` maps a dimension name to its members, each a condition on ``rows``. A row is eligible for a cell
    when it is a member in every dimension. Counts, weighted sizes, value, uncertainty, caveats and
    reliability follow the availability rules: an invalid full-sample weight makes the cell unavailable, no
    usable value makes it unavailable, and neither is ever zero-filled or imputed.
    """
    names = list(dims)
    w, v = finite(F.col(weight)), finite(F.col(value))
    usable = (v > 0) & (w > 0)
    bits = {d: marks(m) for d, m in dims.items()}
    lists = {d: listed(F.col(d)) for d, (_, listed) in bits.items()}
    # rows of no cell end where the lists are taken apart: a filter here would work out all conditions twice
    tagged = rows.select("*", *[mark.alias(d) for d, (mark, _) in bits.items()], F.when(usable, v).alias("_v"), w.alias("_full"))
    # rows keep their marks of cells until they are reduced to buckets of values
    usable_rows = tagged.where("_v is not null")
    counts = tagged.groupBy(*names, F.col("_v").isNotNull().alias("_u")).agg(
        F.count("*").alias("_n"),
        F.count_if(~F.coalesce(F.col("_full") > 0, F.lit(False))).alias("_bad_w"),
        F.sum(med.usable_weight(F.col("_full"), kind)).alias("_sw"),
    )
    for d, groups in lists.items():
        counts = counts.withColumn(d, F.explode(groups))
    ready = med.weighted_rows(
        usable_rows, F.col("_v"), F.col("_full"), replicates, reps.count if reps else 0, kind, explode=lists)
    totals = counts.groupBy(*names).agg(
        F.sum("_n").alias("eligible_n"), F.sum(F.when(F.col("_u"), F.col("_n")).otherwise(0)).alias("usable_n"),
        F.sum("_bad_w").alias("invalid_weight_n"), F.sum("_sw").cast("double").alias("eligible_weight"),
        F.sum(F.when(F.col("_u"), F.col("_sw")).otherwise(0)).cast("double").alias("usable_weight"),
    )
    if reps:
        est = med.uncertainty(ready, names, reps.count, reps.multiplier, reps.critical)
    else:
        est = med.medians(ready, names).select(*names, F.col("_m").alias("point"))
        est = est.select(*names, "point", F.lit(0).alias("replicates_used"),
                         *[F.lit(None).cast("double").alias(c) for c in med.UNCERTAINTY])
    cells = skeleton(rows, {d: list(m) for d, m in dims.items()})
    out = cells.join(totals, names, "left").join(est, names, "left")
    for c in ("eligible_n", "usable_n", "invalid_weight_n"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in ("eligible_weight", "usable_weight"):
        out = out.withColumn(c, F.bround(F.coalesce(c, F.lit(0.0)), 0))
    return _finish(out, names, quality, bool(reps))


def _finish(out: DataFrame, names: list[str], q: Quality, with_reps: bool) -> DataFrame:
    available = out["point"].isNotNull() & (out["invalid_weight_n"] == 0)
    out = out.withColumn("available", available)
    for c in med.UNCERTAINTY:
        out = out.withColumn(c, F.when(F.col("available"), F.col(c)))
    caveats = F.when(F.col("available"), cell_caveats(F.col("usable_n"), F.col("cv"), q)).otherwise(
        F.array().cast("array<string>"))
    no_uncertainty = "invalid_replicate_weights_or_variance" if with_reps else "replicate_weights_unavailable"
    return out.withColumn("caveats", caveats).select(
        *names, "eligible_n", "usable_n", "invalid_weight_n", "eligible_weight", "usable_weight",
        F.when(F.col("available"), F.bround("point", 0)).alias("value"),
        F.when(F.col("available"), F.coalesce("replicates_used", F.lit(0))).otherwise(0).alias("replicates_used"),
        *[F.bround(c, 6 if c == "cv" else 4).alias(c) for c in med.UNCERTAINTY],
        "caveats",
        F.when(F.col("available") & F.col("cv").isNull(), no_uncertainty).alias("uncertainty_reason"),
        F.when(~F.col("available"), "unavailable").when(F.size("caveats") > 0, "use_with_caution")
        .otherwise("reliable").alias("reliability"),
        "available",
        F.when(F.col("invalid_weight_n") > 0, "invalid_full_sample_weights")
        .when(F.col("point").isNull(), "no_usable_rent_observations").alias("unavailable_reason"),
    )


def joint_shares(
    rows: DataFrame, groups: Mapping[str, Members], parts: Mapping[str, tuple[Column, Sequence[str]]], weight: str,
    replicates: Column, reps: Replicates, quality: Quality = Quality(), kind: str = med.EXACT,
) -> DataFrame:
    """Weighted joint share of every combination of ``parts`` inside every group cell.

    ``parts`` maps a name to (category column, its categories). The denominator is the weight of the rows of
    the group with all categories known; rows with a missing category and rows with an invalid weight are
    counted apart. Replicate shares use the replicate's own denominator.
    """
    gs, ps = list(groups), list(parts)
    w = finite(F.col(weight))
    tagged = rows.select(
        *[memberships(m).alias(g) for g, m in groups.items()], *[c.alias(p) for p, (c, _) in parts.items()],
        F.coalesce(w > 0, F.lit(False)).alias("_ok"), med.usable_weight(F.col(weight), kind).alias("_sw"),
        replicates.cast("array<double>").alias("_a"),
    )
    for g in gs:
        tagged = tagged.where(F.size(g) > 0)
    known = F.lit(True)
    for p in ps:
        known = known & F.col(p).isNotNull()
    tagged = tagged.withColumn("_valid", F.col("_ok") & known)
    bad = F.when(F.col("_valid"), (F.size("_a") != reps.count) | F.exists(
        "_a", lambda x: F.coalesce(finite(x) < 0, F.lit(True))))
    keys = [*gs, *ps]
    # rows to (membership lists, categories): few rows, then repeated per cell
    sizes = tagged.withColumn("_bad", bad).groupBy(*keys, "_ok", "_valid").agg(
        F.count("*").alias("_n"), F.sum("_sw").alias("_sw"), F.count_if("_bad").alias("_bad"))
    rep_rows = tagged.where("_valid").select(*keys, F.posexplode("_a").alias("_i", "_x")).groupBy(*keys, "_i").agg(
        F.sum(med.usable_weight(F.col("_x"), kind)).alias("_rw"))
    for g in gs:
        sizes, rep_rows = sizes.withColumn(g, F.explode(g)), rep_rows.withColumn(g, F.explode(g))
    denominators = sizes.groupBy(*gs).agg(
        F.sum(F.when(F.col("_valid"), F.col("_n")).otherwise(0)).alias("group_n"),
        F.sum(F.when(F.col("_valid"), F.col("_sw"))).cast("double").alias("_den"),
        F.sum(F.when(F.col("_ok") & ~F.col("_valid"), F.col("_n")).otherwise(0)).alias("missing_n"),
        F.coalesce(F.sum(F.when(F.col("_ok") & ~F.col("_valid"), F.col("_sw"))).cast("double"), F.lit(0.0))
        .alias("missing_weight"),
        F.sum(F.when(~F.col("_ok"), F.col("_n")).otherwise(0)).alias("invalid_weight_n"),
        F.sum("_bad").alias("_bad"),
    )
    cells = sizes.where("_valid").groupBy(*keys).agg(F.sum("_n").alias("cell_n"), F.sum("_sw").cast("double").alias("_num"))
    rep_cells = rep_rows.groupBy(*keys, "_i").agg(F.sum("_rw").cast("double").alias("_rw"))
    rep_totals = rep_cells.groupBy(*gs, "_i").agg(F.sum("_rw").alias("_rt"))
    ratios = rep_cells.join(rep_totals, [*gs, "_i"]).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", F.try_divide("_rw", "_rt").alias("_q")))),
                    lambda x: x["_q"]).alias("_ratios"))  # one entry per replicate
    empty = rep_totals.groupBy(*gs).agg(F.min("_rt").alias("_min_total"), F.count("*").alias("_n_totals"))
    out = (
        skeleton(rows, {**{g: list(m) for g, m in groups.items()}, **{p: cats for p, (_, cats) in parts.items()}})
        .join(denominators, gs, "left").join(cells, keys, "left").join(ratios, keys, "left").join(empty, gs, "left")
    )
    for c in ("group_n", "missing_n", "invalid_weight_n", "cell_n"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in ("_num", "_den", "missing_weight"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    reason = F.when(F.col("invalid_weight_n") > 0, "invalid_full_sample_weights").when(
        F.col("_den") <= 0, "no_valid_denominator")
    out = out.withColumn("unavailable_reason", reason).withColumn("available", F.col("unavailable_reason").isNull())
    out = out.withColumn("share", F.when(F.col("available"), F.try_divide("_num", "_den")))
    out = out.withColumn("none_observed", F.col("available") & (F.col("cell_n") == 0))
    reps_ok = (F.col("_bad") == 0) & (F.col("_n_totals") == reps.count) & (F.col("_min_total") > 0)
    variance = F.when(
        F.col("available") & (F.col("cell_n") > 0) & reps_ok,
        med.sdr_variance(F.col("share"), F.col("_ratios"), reps.multiplier))
    out = out.withColumn("standard_error", F.sqrt(variance))
    margin = F.lit(float(reps.critical)) * F.col("standard_error")
    out = out.withColumn("ci_lower", F.when(
        margin.isNotNull(), F.greatest(F.lit(0.0), F.col("share") - margin)))
    out = out.withColumn("ci_upper", F.when(margin.isNotNull(), F.least(F.lit(1.0), F.col("share") + margin)))
    out = out.withColumn("cv", F.when(F.col("share") > 0, F.try_divide("standard_error", "share")))
    observed = F.col("available") & ~F.col("none_observed")
    caveats = when_list(
        (F.col("none_observed"), "None observed in this sample; not evidence of population absence."),
        (observed & (F.col("cell_n") < quality.small_sample),
         F.concat(F.lit("Small cell: "), F.col("cell_n").cast("string"), F.lit(" household responses."))),
        (observed & F.col("standard_error").isNull(), "Uncertainty could not be estimated"),
        (observed & (F.col("cv") > quality.high_cv), "High sampling uncertainty."),
    )
    return out.withColumn("caveats", caveats).select(
        *keys, "cell_n", "group_n", "available", "share",
        F.when(F.col("available"), F.col("_num")).alias("weighted"),
        F.when(F.col("available"), F.col("_den")).alias("group_weighted"),
        "standard_error", "ci_lower", "ci_upper", "cv", "none_observed", "missing_n", "missing_weight",
        "invalid_weight_n", "caveats",
        F.when(F.col("none_observed"), "none_observed_not_population_absence")
        .when(observed & F.col("standard_error").isNull(), "invalid_or_unavailable_replicate_uncertainty")
        .alias("uncertainty_reason"),
        "unavailable_reason",
        F.when(~F.col("available"), "unavailable").when(F.col("none_observed"), "none_observed")
        .when(F.size("caveats") > 0, "use_with_caution").otherwise("reliable").alias("reliability"),
    )


def benchmark_medians(
    rows: DataFrame, category: Column, value: str, weight: str, everyone: str = "all", kind: str = med.EXACT
) -> DataFrame:
    """Rounded weighted median per category and for everyone, from one scan."""
    usable = rows.where((finite(F.col(value)) > 0) & (finite(F.col(weight)) > 0))
    tagged = usable.select(
        F.array_compact(F.array(F.lit(everyone), category)).alias("name"), F.col(value), F.col(weight))
    ready = med.weighted_rows(tagged, finite(F.col(value)), F.col(weight), kind=kind, explode=["name"])
    return med.medians(ready, ["name"]).select("name", F.bround("_m", 0).alias("computed"))


def observations(cells: DataFrame, names: Sequence[str], vintage: str, source_id: str) -> DataFrame:
    """Cell estimates as observation rows with their fixed descriptive columns."""
    return cells.select(
        F.concat_ws(":", F.lit(source_id), F.lit(vintage), *[F.col(n) for n in names]).alias("observation_id"),
        *names, F.lit(source_id).alias("source_id"), F.lit(vintage).alias("survey_vintage"),
        F.lit("population_rent").alias("observation_type"), F.lit("occupied").alias("occupancy_state"),
        F.lit("monthly_gross_rent").alias("measure"), F.lit("actual_paid").alias("measure_basis"),
        F.lit("gross").alias("gross_or_net"), F.lit("weighted_median").alias("statistic"),
        F.lit("USD").alias("currency"), F.lit("monthly").alias("cadence"), "value",
        F.col("usable_n").alias("sample_size"), F.col("usable_weight").alias("weighted_population"),
        "replicates_used", *med.UNCERTAINTY, "caveats", "reliability", "available", "unavailable_reason",
        F.lit("descriptive_only").alias("inference_class"), F.lit(False).alias("imputed"),
    )
