"""Differences between survey cells, reference changes, and area fallback."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import rules
from parcelwise.functions.arrays import keyed_lists
from parcelwise.operators.joins import first_per_key

# Fields that must agree before two cells may be subtracted.
COMPATIBLE = (
    "source_id", "occupancy_state", "geography_id", "geography_type", "geography_name", "survey_vintage",
    "measure", "measure_basis", "gross_or_net", "statistic", "currency", "cadence",
)

# Kinds of difference (within one population, across populations, across both).
WITHIN, ACROSS, CROSSED = "incumbency_within_regime", "same_tenure_regulation", "illustrative_cross_regime"


def gap_rules(populations: Sequence[str], pair: tuple[str, str], cohorts: tuple[str, str]) -> list[tuple]:
    """Rule rows (kind, left population, left cohort, right population, right cohort)."""
    new, old = cohorts
    out = [(WITHIN, p, new, p, old) for p in populations]
    out += [(ACROSS, pair[0], c, pair[1], c) for c in cohorts]
    out.append((CROSSED, pair[1], new, pair[0], old))
    return out


def mismatches(fields: Sequence[str], left: str = "l", right: str = "r") -> Column:
    """Names of the fields in which two sides differ."""
    return F.array_compact(F.array(*[
        F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields]))


def gap_pairs(cells: DataFrame, rows: Sequence[tuple], fields: Sequence[str] = COMPATIBLE) -> DataFrame:
    """Cells joined into pairs by rule; pairs with an unavailable side are left out.

    ``cells``: geography_id, population, cohort, observation_id, value, available, reliability, caveats and the
    compatibility fields. ``mismatched`` lists fields that differ: such pairs carry no difference.
    """
    # the rules of a cell travel with it as a short literal list, so the only join is cell to cell
    as_array = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(lp).alias("lp"), F.lit(lc).alias("lc"),
                 F.lit(rp).alias("rp"), F.lit(rc).alias("rc")) for k, lp, lc, rp, rc in rows])
    mine = F.filter(as_array, lambda r: (r["lp"] == F.col("population")) & (r["lc"] == F.col("cohort")))
    good = cells.where("available and value is not null")
    left = good.select(F.struct("*").alias("l"), F.explode(mine).alias("rule"))
    right = good.select(F.struct("*").alias("r"))
    pairs = left.join(right, (F.col("l.geography_id") == F.col("r.geography_id"))
                      & (F.col("rule.rp") == F.col("r.population")) & (F.col("rule.rc") == F.col("r.cohort")))
    present = [f for f in fields if f in cells.columns]
    bad = mismatches(present)
    diff = F.when(F.size("mismatched") == 0, F.col("l.value") - F.col("r.value"))
    return pairs.withColumn("mismatched", bad).withColumn("difference", diff).select(
        F.concat_ws(":", F.col("l.geography_id"), "rule.kind", "rule.lp", "rule.lc", F.lit("minus"), "rule.rp", "rule.rc")
        .alias("gap_id"),
        F.col("rule.kind").alias("kind"), F.col("l.geography_id").alias("geography_id"),
        F.col("rule.lp").alias("left_population"), F.col("rule.lc").alias("left_cohort"),
        F.col("rule.rp").alias("right_population"), F.col("rule.rc").alias("right_cohort"),
        F.col("l.observation_id").alias("left_id"), F.col("r.observation_id").alias("right_id"),
        F.col("r.observation_id").alias("denominator_id"),
        "difference", F.bround(F.try_divide(F.col("difference") * 100, F.col("r.value")), 6).alias("percent"),
        rules.sign_label(F.col("difference")).alias("direction"),
        (F.col("rule.kind") == CROSSED).alias("illustrative"), F.lit(False).alias("causal_claim_allowed"),
        F.col("l.reliability").alias("left_reliability"), F.col("r.reliability").alias("right_reliability"),
        keyed_lists((F.col("l.observation_id"), F.col("l.caveats")), (F.col("r.observation_id"), F.col("r.caveats")))
        .alias("component_caveats"),
        "mismatched",
    )


def reference_change(
    reference: DataFrame, cells: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Reference differences beside the current ones, with direction and scale verdicts.

    ``reference``: comparison_id, left_<key>, right_<key>, left_ref, right_ref. A pair without both current
    cells keeps null results and ``complete`` false, which a gate can turn into a failure.
    """
    def side(name: str) -> DataFrame:
        return cells.where("value is not null").select(
            *[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("value").alias(f"{name}_now"))

    out = reference.join(side("left"), [f"left_{k}" for k in keys], "left").join(
        side("right"), [f"right_{k}" for k in keys], "left")
    ref, now = F.col("left_ref") - F.col("right_ref"), F.col("left_now") - F.col("right_now")
    known = now.isNotNull()
    return out.select(
        "comparison_id", ref.alias("reference_difference"), now.alias("current_difference"),
        rules.sign_label(ref).alias("reference_direction"), rules.sign_label(now).alias("current_direction"),
        F.when(known, rules.direction_change(ref, now)).alias("direction_verdict"),
        F.when(known, rules.scale_change(ref, now)).alias("scale_verdict"),
        (now - ref).alias("difference_change"), (F.abs(now) - F.abs(ref)).alias("absolute_change"),
        known.alias("complete"),
    )


def area_candidates(code: Column, areas: Mapping[str, str], grouped: Sequence[str], group_id: str, everywhere: str) -> Column:
    """Areas to try for a subject: its own, its group when all its codes are in the group, everywhere.

    ``code`` is the list of area codes of the subject; more than one code has no own area.
    """
    lookup = F.create_map(*[F.lit(x) for kv in areas.items() for x in kv])
    own = F.when(F.size(code) == 1, F.try_element_at(lookup, F.get(code, 0)))
    in_group = (F.size(code) > 0) & F.forall(code, lambda c: c.isin(*grouped))
    return F.array_distinct(F.array_compact(F.array(own, F.when(in_group, F.lit(group_id)), F.lit(everywhere))))


def fall_back(subjects: DataFrame, cells: DataFrame, candidates: str = "candidates") -> DataFrame:
    """First candidate area whose cell is available, else the first candidate that has a cell at all.

    ``cells``: geography_id, available, value and anything else to carry, one row per area. A subject has a
    handful of candidates, so the ordering happens in tiny groups.
    """
    ids = [c for c in subjects.columns if c != candidates]
    tried = subjects.select(*ids, F.posexplode(candidates).alias("_pos", "geography_id"))
    hit = tried.join(cells, "geography_id")
    ok = F.coalesce(F.col("available") & F.col("value").isNotNull(), F.lit(False))
    best = first_per_key(hit, ids[:1], ok.desc(), F.col("_pos")).drop("_pos")
    extra = [c for c in best.columns if c not in ids]
    return subjects.drop(candidates).join(best.select(ids[0], *extra), ids[0], "left")


def fall_back_pair(subjects: DataFrame, left: DataFrame, right: DataFrame, candidates: str = "candidates") -> DataFrame:
    """First candidate area where both cells are available, else the first where either exists."""
    ids = [c for c in subjects.columns if c != candidates]
    tried = subjects.select(*ids, F.posexplode(candidates).alias("_pos", "geography_id"))
    a = left.select("geography_id", F.col("available").alias("left_available"), F.col("value").alias("left_value"))
    b = right.select("geography_id", F.col("available").alias("right_available"), F.col("value").alias("right_value"))
    hit = tried.join(a, "geography_id", "left").join(b, "geography_id", "left").where(
        "left_available is not null or right_available is not null")
    both = F.coalesce(F.col("left_available") & F.col("left_value").isNotNull() & F.col("right_available")
                      & F.col("right_value").isNotNull(), F.lit(False))
    best = first_per_key(hit, ids[:1], both.desc(), F.col("_pos")).drop("_pos")
    extra = [c for c in best.columns if c not in ids]
    return subjects.drop(candidates).join(best.select(ids[0], *extra), ids[0], "left")


def preferred_gap(subjects: DataFrame, gaps: DataFrame, market: str, regulated: str, recent: str,
                  candidates: str = "candidates") -> DataFrame:
    """The gap to show for a subject: nearest area first, then rule priority; both sides reliable."""
    priority = (
        F.when((F.col("kind") == WITHIN) & (F.col("left_population") == market), 0)
        .when((F.col("kind") == WITHIN) & (F.col("left_population") == regulated), 1)
        .when((F.col("kind") == ACROSS) & (F.col("left_cohort") == recent), 2)
        .when(F.col("kind") == ACROSS, 3)
    )
    good = gaps.where(
        ~F.col("illustrative") & (F.col("left_reliability") == "reliable") & (F.col("right_reliability") == "reliable")
    ).withColumn("_p", priority).where("_p is not null")
    ids = [c for c in subjects.columns if c != candidates]
    tried = subjects.select(*ids, F.posexplode(candidates).alias("_pos", "geography_id"))
    best = first_per_key(tried.join(good, "geography_id"), ids[:1], F.col("_pos"), F.col("_p"), F.col("gap_id"))
    return subjects.drop(candidates).join(
        best.select(ids[0], "gap_id", "kind", "geography_id", "difference"), ids[0], "left")


def group_difference(cells: DataFrame, base: str, other: str) -> DataFrame:
    """Per area the base group's value minus another group's; null when either is unavailable."""
    value = F.when(F.col("available"), F.col("value"))
    return cells.groupBy("geography_id").agg(
        (F.max(F.when(F.col("population") == base, value)) - F.max(F.when(F.col("population") == other, value)))
        .alias("difference"))
