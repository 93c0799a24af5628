"""Subjects against area benchmarks: pair, compute the wedge, grade how comparable the pair is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import rules, typed
from parcelwise.functions.arrays import add_reasons
from parcelwise.operators.joins import first_per_key

# Columns of a subject observation: subject_id, t_id, t_period, t_value, t_scope, t_bedroom, t_gross_net
# Columns of a market observation:  area_id, m_id, m_period, m_value, m_scope, m_bedroom, m_gross_net,
#                                   m_basis, m_artifact, seq (later rows replace earlier ones)


def observation_rows(wide: DataFrame, area: str, bedrooms: dict[int, str], value: str = "m_value") -> DataFrame:
    """Area table with one column per bedroom count to one row per (area, bedroom), missing values left out."""
    ids = [c for c in wide.columns if c not in bedrooms.values()]
    long = wide.unpivot(ids, [F.col(c) for c in bedrooms.values()], "_b", value)
    number = F.create_map(*[x for b, c in bedrooms.items() for x in (F.lit(c), F.lit(b))])
    return long.where(f"{value} is not null").withColumn("m_bedroom", number[F.col("_b")]).drop("_b")


def pair_by_area(
    subject_obs: DataFrame, assignments: DataFrame, market: DataFrame, wanted: Mapping[str, int | None]
) -> DataFrame:
    """Subject -> its assigned area -> the area's market observations, one for each measure basis that is wanted.

    ``wanted`` maps a basis to the bedroom count to take, None for all units. All bases come from one join.
    """
    hit = F.lit(False)
    for basis, bedroom in wanted.items():
        units = (F.col("m_scope") == "all_units") & F.col("m_bedroom").isNull() if bedroom is None else F.col("m_bedroom") == bedroom
        hit = hit | ((F.col("m_basis") == basis) & units)
    chosen = first_per_key(market.where(hit), ["area_id", "m_basis"], F.desc("seq")).drop("seq")
    return subject_obs.join(assignments.select("subject_id", "area_id"), "subject_id").join(chosen, "area_id")


def compare_pairs(
    pairs: DataFrame, *, contains: Column | None = None, extra_reasons: Column | None = None,
    basis_texts: dict[str, str] = rules.BASIS_TEXTS, limits: rules.PeriodLimits = rules.PeriodLimits(),
) -> DataFrame:
    """Comparison columns for each pair; pairs with an invalid value are left out (see ``rejected_pairs``).

    Pairs too far apart in time are not examined further: their reasons end with the period. A column ``t_utility``,
    where there is one, names the tenant's utility basis.
    """
    months = typed.months_apart(F.col("t_period"), F.col("m_period"))
    scope = ("t_scope", "t_bedroom", "m_scope", "m_bedroom")
    good = pairs.where(rules.wedge_inputs_ok(F.col("t_value"), F.col("m_value"))).select(
        "*", months.alias("months"),
        rules.scope_kind(*map(F.col, scope)).alias("scope_kind"),
        rules.gross_net_ok(F.col("t_gross_net"), F.col("m_gross_net")).alias("gross_net_ok"),
        *[c.alias(n) for n, c in rules.wedge(F.col("t_value"), F.col("m_value")).items()],
    )
    good = good.withColumn("period_class", rules.period_class(F.col("months"), limits))
    utility = F.col("t_utility") if "t_utility" in pairs.columns else None
    none = F.array().cast("array<string>")
    further = F.concat(
        rules.gross_net_reasons(F.col("t_gross_net"), F.col("m_gross_net"), utility),
        rules.basis_reasons(F.col("m_basis"), F.col("area_id"), basis_texts))
    reasons = F.concat(
        rules.scope_reasons(*map(F.col, scope)), rules.period_reasons(F.col("months"), limits),
        F.when(F.col("period_class") == "too_far", none).otherwise(further))
    good = good.withColumn("quality", rules.quality_class(
        F.col("period_class"), F.col("scope_kind"), F.col("gross_net_ok"), F.col("m_basis"),
        contains if contains is not None else F.lit(None).cast("boolean")))
    mild = (F.col("quality") == "strong") & ~F.col("gross_net_ok")
    reasons = F.concat(reasons, F.when(mild, F.array(F.lit("one mild gross/net definition mismatch is disclosed")))
                       .otherwise(none))
    if extra_reasons is not None:
        reasons = add_reasons(reasons, extra_reasons)
    source = rules.market_source(F.col("m_basis"), F.col("m_id"), F.col("m_artifact"))
    return good.withColumn("reasons", reasons).withColumn("market_source", source)


def rejected_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose market value is not positive or whose tenant value is negative or missing."""
    reason = (
        F.when(F.col("t_value").isNull() | F.col("m_value").isNull(), "missing_value")
        .when(F.col("m_value") <= 0, "market_not_positive").otherwise("tenant_negative")
    )
    return pairs.where(~rules.wedge_inputs_ok(F.col("t_value"), F.col("m_value"))).withColumn("reason", reason)


def attach_market(comparisons: DataFrame, market: DataFrame) -> DataFrame:
    """Source, bedroom, scope and area code from the market observation, only where they are missing.

    Comparisons whose observation is absent get their source from the comparison id.
    """
    m = market.select(
        F.col("m_id"), F.col("m_bedroom").alias("_b"), F.col("m_scope").alias("_s"),
        F.when(F.startswith("area_id", F.lit("zcta:")), F.split("area_id", ":")[1]).alias("_z"),
        rules.market_source(F.col("m_basis"), F.col("m_id"), F.col("m_artifact")).alias("_src"))
    out = comparisons.join(m, "m_id", "left")
    fill = {"market_source": F.coalesce("_src", rules.source_from_id(F.col("comparison_id"))),
            "market_bedroom": F.col("_b"), "market_scope": F.col("_s"), "market_zcta": F.col("_z")}
    for name, c in fill.items():
        out = out.withColumn(name, F.coalesce(name, c) if name in comparisons.columns else c)
    return out.drop("_b", "_s", "_z", "_src")


def lineage(
    comparisons: DataFrame, tenant: DataFrame, market: DataFrame, subjects: DataFrame, assignments: DataFrame,
    artifacts: DataFrame,
) -> DataFrame:
    """Both observations, artifacts, subject and assignment of every comparison, and the wedge recomputed."""
    t = tenant.select("t_id", "t_value", "t_artifact")
    m = market.select("m_id", "m_value", "m_basis", "m_artifact")
    arts = artifacts.select(F.col("artifact_id"), F.col("sha256"))
    out = (
        comparisons.select("comparison_id", "subject_id", "t_id", "m_id", "quality", "monthly_wedge")
        .join(t, "t_id", "left").join(m, "m_id", "left")
        .join(subjects.select("subject_id", "name"), "subject_id", "left")
        .join(assignments.select("subject_id", "area_id"), "subject_id", "left")
        .join(arts.select(F.col("artifact_id").alias("t_artifact"), F.col("sha256").alias("t_sha256")), "t_artifact", "left")
        .join(arts.select(F.col("artifact_id").alias("m_artifact"), F.col("sha256").alias("m_sha256")), "m_artifact", "left")
    )
    again = F.when((F.col("t_value") > 0) & (F.col("m_value") > 0), F.col("m_value") - F.col("t_value"))
    return out.select(
        "*", again.alias("recomputed"),
        F.coalesce(F.abs(F.coalesce("monthly_wedge", F.lit(0.0)) - again) < 0.01, F.lit(False)).alias("matches"),
        rules.measured_label(F.col("m_value").isNotNull(), F.col("m_basis")).alias("market_measured"),
    )


def resolve_market(comparisons: DataFrame, market: DataFrame, package: DataFrame) -> DataFrame:
    """Market value of each comparison from its observation, else rebuilt from the compact area package.

    ``package`` is unique on (market_source, area_id, bedroom key) with ``p_value``.
    """
    m = market.select("m_id", F.col("m_value").alias("_m"))
    p = package.select("market_source", "area_id", F.col("p_bedroom").alias("_bk"), "p_value")
    key = F.when(F.col("market_source") == "zori", -1).otherwise(F.coalesce("market_bedroom", F.lit(2)))
    out = comparisons.join(m, "m_id", "left").withColumn("_bk", key).join(p, ["market_source", "area_id", "_bk"], "left")
    value = F.coalesce("_m", "p_value")
    how = F.when(F.col("_m").isNotNull(), "observation").when(F.col("p_value").isNotNull(), "package")
    return out.withColumn("market_value", value).withColumn("market_from", how).drop("_m", "_bk", "p_value")
