"""Contracts and gates. A check never stops a job by itself: it yields rows ``check, ok, detail``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateFailed(ValueError):
    """A gate the caller chose to enforce found failing rows."""


def enforce(checks: DataFrame, sample: int = 20) -> None:
    """Raise with the number of failing rows and the first few of them; the only place where a check becomes an
    exception. The failing rows themselves stay in ``checks`` for whoever writes them out."""
    bad = checks.where("not ok")
    failed = bad.limit(sample).collect()
    if failed:
        told = "; ".join(f"{r['check']}: {r['detail']}" for r in failed)
        raise GateFailed(f"{bad.count()} failed: {told}")


def columns_present(df: DataFrame, table: str, required: Sequence[str]) -> Column:
    """Missing required columns as a text list (known from the schema alone)."""
    return F.lit(",".join(c for c in required if c not in df.columns))


def schema_gate(df: DataFrame, table: str, required: Sequence[str], low: int, high: int) -> DataFrame:
    """Required columns and row-count band of one table."""
    missing = columns_present(df, table, required)
    n = df.agg(F.count("*").alias("n"))
    return n.select(
        F.lit(table).alias("table"), missing.alias("missing"), "n",
        ((missing == "") & F.col("n").between(low, high)).alias("ok"))


def duplicate_or_blank(df: DataFrame, key: str) -> DataFrame:
    """Keys that are blank or occur more than once."""
    blank = F.col("key").isNull() | (F.col("key").cast("string") == "")
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | blank)


def strict_join(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One-to-one inner join that takes only ``fields`` from the right, and the table of what breaks the rule.

    Blank keys are problems, not keys: they are joined with nothing and don't count as unmatched.
    """
    filled = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    problems = (
        duplicate_or_blank(left, key).select(F.col("key").cast("string"), F.lit("left_duplicate_or_blank").alias("problem"))
        .unionByName(duplicate_or_blank(right, key).select(
            F.col("key").cast("string"), F.lit("right_duplicate_or_blank").alias("problem")))
        .unionByName(left.where(filled).select(key).distinct().join(right.select(key), key, "left_anti").select(
            F.col(key).cast("string").alias("key"), F.lit("left_unmatched").alias("problem")))
    )
    return left.where(filled).join(right.where(filled).select(key, *fields), key), problems


def completeness(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that are not there."""
    return expected.join(actual.select(*keys), list(keys), "left_anti")


def benchmark_gate(computed: DataFrame, expected: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Computed values against expected ones; a missing value fails."""
    out = expected.join(computed, key, "left")
    return out.withColumn("ok", F.coalesce(F.abs(F.col("computed") - F.col("expected")) <= tolerance, F.lit(False)))


def violations(df: DataFrame, key: str, contracts: Mapping[str, Column]) -> DataFrame:
    """One row per broken contract; a contract that evaluates to null is broken."""
    tests = F.array(*[F.struct(F.lit(n).alias("contract"), F.coalesce(c, F.lit(False)).alias("ok"))
                      for n, c in contracts.items()])
    return df.select(F.col(key), F.inline(tests)).where("not ok").drop("ok")


def cell_contracts(artifacts: str | None = None) -> dict[str, Column]:
    """Record rules of a survey observation; ``artifacts`` names the list of what it was made from, if there is one."""
    unique = {"artifacts_are_unique": unique_list(F.col(artifacts))} if artifacts else {}
    available, value, reason = F.col("available"), F.col("value"), F.col("unavailable_reason")
    has_all = F.lit(True)
    for c in ("variance", "standard_error", "margin_of_error", "ci_lower", "ci_upper", "cv"):
        has_all = has_all & F.col(c).isNotNull()
    return {
        "available_has_value": ~available | value.isNotNull(),
        "available_has_no_reason": ~available | reason.isNull(),
        "unavailable_has_no_value": available | value.isNull(),
        "unavailable_has_reason": available | F.coalesce(reason != "", F.lit(False)),
        "reliability_agrees": available == (F.col("reliability") != "unavailable"),
        "uncertainty_complete": ~(available & (F.col("replicates_used") > 0)) | has_all,
        **unique,
    }


def gap_contracts() -> dict[str, Column]:
    """Record rules of a difference between two cells."""
    d = F.col("difference")
    sign = F.when(d > 0, "positive").when(d < 0, "negative").when(d == 0, "zero")
    return {
        "two_different_sides": F.col("left_id") != F.col("right_id"),
        "denominator_is_right_side": F.col("denominator_id") == F.col("right_id"),
        "direction_is_sign": F.col("direction") == sign,
        "only_crossed_is_illustrative": F.col("illustrative") == (F.col("kind") == "illustrative_cross_regime"),
        "no_causal_claim": ~F.col("causal_claim_allowed"),
    }


def relation_breaks(df: DataFrame, total: Column, parts: Sequence[Column], tolerance: float, *others: Column) -> DataFrame:
    """Rows whose parts do not add up to the total within the tolerance, or that break one of the other rules.

    A missing part or total breaks the relation.
    """
    rest = parts[0]
    for p in parts[1:]:
        rest = rest + p
    ok = F.coalesce(F.abs(total - rest) <= tolerance, F.lit(False))
    for o in others:
        ok = ok & F.coalesce(o, F.lit(False))
    return df.where(~ok)


def unique_list(c: Column) -> Column:
    """All entries of a list differ."""
    return F.size(F.array_distinct(c)) == F.size(c)


def comparison_contracts(comparisons: DataFrame, tenant: DataFrame, market: DataFrame) -> DataFrame:
    """References resolve, the wedge recomputes, the class is present and exact needs equal scope."""
    t = tenant.select("t_id", F.col("t_value").alias("_tv"), F.col("t_scope").alias("_ts"))
    m = market.select("m_id", F.col("m_value").alias("_mv"), F.col("m_scope").alias("_ms"))
    out = comparisons.join(t, "t_id", "left").join(m, "m_id", "left")
    found = F.col("_tv").isNotNull() & F.col("_mv").isNotNull()
    diff = F.col("_mv") - F.col("_tv")
    return violations(out, "comparison_id", {
        "references_resolve": found,
        "monthly_wedge_recomputes": ~found | (F.abs(F.col("monthly_wedge") - diff) <= 0.01),
        "annual_wedge_recomputes": ~found | (F.abs(F.col("annual_wedge") - diff * 12) <= 0.01),
        "pct_below_recomputes": ~found | (
            F.abs(F.col("pct_below") - (1 - F.try_divide(F.col("_tv"), F.col("_mv")))) <= 1e-9),
        "exact_needs_equal_scope": (F.coalesce("quality", F.lit("")) != "exact") | F.col("_ts").eqNullSafe(F.col("_ms")),
        "quality_present": F.coalesce("quality", F.lit("")) != "",
        "reasons_are_a_list": F.col("reasons").isNotNull(),
    })


def load_state(df: DataFrame, contracts: Mapping[str, Column]) -> DataFrame:
    """One row: the whole set is ready only when every row meets every contract."""
    ok = F.lit(True)
    for c in contracts.values():
        ok = ok & F.coalesce(c, F.lit(False))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(~ok).alias("broken"),
        F.when(F.coalesce(F.bool_and(ok), F.lit(True)), "ready").otherwise("error").alias("status"))


def acceptance(checks: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Verdict over several problem tables (each row a problem) and all messages.

    Messages keep their source name; the verdict is one row.
    """
    parts = []
    for name, df in checks.items():
        text = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
        parts.append(df.select(F.lit(name).alias("check"), text.alias("message")))
    messages = parts[0]
    for p in parts[1:]:
        messages = messages.unionByName(p)
    verdict = messages.agg(F.count("*").alias("problems")).withColumn("accepted", F.col("problems") == 0)
    return verdict, messages
