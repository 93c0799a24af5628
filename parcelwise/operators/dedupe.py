"""De-duplication and resolution between overlapping sources.

Winners come from aggregates that combine before the shuffle, and losers are labelled by a join that splits
frequent keys, so a key that holds a large part of the rows does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.arrays import add_reasons
from parcelwise.operators.ingest import distributions
from parcelwise.operators.joins import first_per_key, join_per_key


def first_wins(df: DataFrame, key: str, order: str, same: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """First row per key, and every later row with its reason and the kept values.

    A later row is ``identical`` when all ``same`` columns agree with the kept row, else ``conflict``.
    """
    keeper = df.groupBy(key).agg(F.min_by(F.struct(order, *same), order).alias("_k"))
    kept = first_per_key(df, [key], F.col(order))
    joined = join_per_key(df, keeper, [key], "inner").where(F.col(order) != F.col("_k")[order])
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col("_k")[c])
    dropped = joined.select(
        key, order, *same, F.when(agree, "identical").otherwise("conflict").alias("reason"),
        *[F.col("_k")[c].alias(f"kept_{c}") for c in (order, *same)],
    )
    return kept, dropped


def prefer_section(df: DataFrame, key: str, order: str, value: str, section: str, primary: str) -> DataFrame:
    """Every row with ``outcome``: kept, superseded, identical or conflict, and the value it lost against.

    The first primary row of a key is kept, else the first row. A first row that is not primary is superseded
    by it. Rows before the first primary row are compared with the first row, later rows with the kept one.
    """
    is_primary = F.col(section) == primary
    heads = df.groupBy(key).agg(
        F.min(order).alias("_f"), F.min_by(F.struct(F.col(value).alias("v")), order)["v"].alias("_fv"),
        F.min(F.when(is_primary, F.col(order))).alias("_b"),
        F.min_by(F.struct(F.col(value).alias("v")), F.when(is_primary, F.col(order)))["v"].alias("_bv"),
    )
    o = F.col(order)
    early = F.col("_b").isNull() | (o < F.col("_b"))
    rival = F.when(early, F.col("_fv")).otherwise(F.col("_bv"))
    outcome = (
        F.when(o == F.coalesce("_b", "_f"), "kept")
        .when(o == F.col("_f"), "superseded")
        .when(F.col(value).eqNullSafe(rival), "identical")
        .otherwise("conflict")
    )
    out = join_per_key(df, heads, [key], "inner").withColumn("outcome", outcome)
    against = F.when(F.col("outcome") == "superseded", F.col("_bv")).when(F.col("outcome") != "kept", rival)
    return out.withColumn("kept_value", against).drop("_f", "_fv", "_b", "_bv")


def confidence_ok(c: Column) -> Column:
    return F.lower(F.when(F.coalesce(c, F.lit("")) == "", "high").otherwise(c)).isin("high", "medium")


def pool_sources(older: DataFrame, newer: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Candidates of both sources; the newer source only with good confidence, rows without subject left out."""
    a = older.where(F.col(subject).isNotNull()).withColumn("pool", F.lit(0))
    b = newer.where(F.col(subject).isNotNull() & confidence_ok(F.col("confidence"))).withColumn("pool", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True)


def newest(
    pooled: DataFrame, vintage: str | None, subject: str = "subject_id", period: str = "period",
    value: str = "value", oid: str = "observation_id", seq: str = "seq",
) -> DataFrame:
    """Per subject the newest observation; on the same date the newer source, then the earlier row.

    ``stale``: the winner is from the older source although the newer source's ``vintage`` is later.
    """
    # ordering inside the struct puts a missing date last
    rank = F.struct(F.col(period), F.col("pool"), -F.col(seq))
    best = pooled.groupBy(subject).agg(
        F.max_by(F.struct(oid, period, value, "pool", seq), rank).alias("w"), F.count("*").alias("candidates"))
    newer = F.lit(vintage).cast("date")
    stale = F.coalesce((F.col("w")["pool"] == 0) & (F.col("w")[period] < newer), F.lit(False))
    return best.select(
        subject, F.col("w")[oid].alias(oid), F.col("w")[period].alias(period), F.col("w")[value].alias(value),
        F.when(F.col("w")["pool"] == 1, "newer").otherwise("older").alias("source"), stale.alias("stale"), "candidates",
    )


def history(pooled: DataFrame, winners: DataFrame, subject: str = "subject_id", oid: str = "observation_id") -> DataFrame:
    """All candidates that did not win, one row each, with the id that won."""
    won = winners.select(subject, F.col(oid).alias("selected_id"))
    return join_per_key(pooled, won, [subject], "inner").where(~F.col(oid).eqNullSafe(F.col("selected_id")))


def vintage_report(winners: DataFrame, older: DataFrame, newer: DataFrame, subject: str = "subject_id", period: str = "period") -> DataFrame:
    """Rows (part, value, n): the counts of the resolution, the newer rows rejected for their confidence, and how often
    each source and each period is current."""
    counts = winners.agg(
        F.count("*").alias("current"), F.count_if(F.col("source") == "newer").alias("advanced"),
        F.count_if(F.col("source") == "older").alias("retained"), F.count_if("stale").alias("stale"),
    ).unpivot([], ["current", "advanced", "retained", "stale"], "value", "n").select(F.lit("count").alias("part"), "value", "n")
    rejected = newer.agg(F.count_if(F.col(subject).isNotNull() & ~confidence_ok(F.col("confidence"))).alias("n"))
    candidates = older.agg(F.count_if(F.col(subject).isNotNull()).alias("n"))
    spread = distributions(winners, ["source", period]).select(F.col("field").alias("part"), "value", "n")
    return counts.unionByName(rejected.select(F.lit("count").alias("part"), F.lit("rejected").alias("value"), "n")).unionByName(
        candidates.select(F.lit("count").alias("part"), F.lit("older_candidates").alias("value"), "n")).unionByName(spread)


def merge_attributes(
    first: DataFrame, second: DataFrame, key: str, fields: Sequence[str], second_won: Column
) -> DataFrame:
    """Full outer merge of two subject tables, each field from the winner and else from the other side."""
    b = second.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    out = first.join(b, key, "full_outer")
    merged = [F.when(second_won, F.coalesce(f"_b_{f}", f)).otherwise(F.coalesce(f, f"_b_{f}")).alias(f) for f in fields]
    rest = [c for c in first.columns if c != key and c not in fields]
    return out.select(key, *rest, *merged)


def assign_names(df: DataFrame, names: DataFrame, key: str, placeholder: str) -> DataFrame:
    """Name from the crosswalk, else a placeholder from the key, and which of the two it was."""
    right = names.where(F.coalesce("name", F.lit("")) != "").select(key, F.col("name").alias("_n"))
    return df.join(right, key, "left").select(
        *[c for c in df.columns if c not in ("name", "name_source")],
        F.coalesce("_n", F.concat(F.lit(placeholder), F.col(key).cast("string"))).alias("name"),
        F.when(F.col("_n").isNotNull(), "crosswalk").otherwise("placeholder").alias("name_source"),
    )


def overlay_transitions(df: DataFrame, transitions: DataFrame, key: str, field: str) -> DataFrame:
    """Dated change of ``field``: the original stays in ``source_<field>``, aliases are merged.

    ``transitions`` is unique on ``key`` with ``new_<field>``, ``new_aliases`` and ``effective``. Applying it
    twice changes nothing more.
    """
    src = f"source_{field}"
    if src not in df.columns:
        df = df.withColumn(src, F.lit(None).cast("string"))
    if "aliases" not in df.columns:
        df = df.withColumn("aliases", F.array().cast("array<string>"))
    hit = F.col("effective").isNotNull()
    out = df.join(transitions, key, "left")
    return out.select(
        *[c for c in df.columns if c not in (field, src, "aliases", "transition_date")],
        F.when(hit, F.coalesce(src, field)).otherwise(F.col(src)).alias(src),
        F.when(hit, F.col(f"new_{field}")).otherwise(F.col(field)).alias(field),
        F.when(hit, add_reasons(F.col("new_aliases"), F.col("aliases"))).otherwise(F.col("aliases")).alias("aliases"),
        F.col("effective").alias("transition_date"),
    )


def mark_observations(observations: DataFrame, transitions: DataFrame, key: str) -> DataFrame:
    """Observations of changed subjects say that they were measured before the change was verified."""
    hit = transitions.select(key, F.lit("retained_source_not_verified_current").alias("evidence_status"))
    return observations.join(hit, key, "left")


def union_first(sources: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Union by id; the earliest source wins, inside a source the smallest ``order``. Rows without an id are left out."""
    parts = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.where(F.col(key).isNotNull())
    return first_per_key(out, [key], F.col("_src"), F.col(order)).drop("_src")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Review rows: keys that occur more than once (all their rows stay in the data)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def current_and_previous(
    winners: DataFrame, pooled: DataFrame, subject: str = "subject_id", period: str = "period", value: str = "value",
    oid: str = "observation_id", seq: str = "seq",
) -> DataFrame:
    """Current value beside the newest older-source value; the current one again while it is still that one."""
    older = pooled.where("pool = 0").join(winners.select(F.col(oid)), oid, "left_anti")
    rank = F.struct(F.col(period), -F.col(seq))
    previous = older.groupBy(subject).agg(
        F.max_by(F.struct(F.col(value).alias("v"), F.col(period).alias("p")), rank).alias("_o"))
    still = F.col("source") == "older"
    return winners.join(previous, subject, "left").select(
        subject, F.col(value).alias("current_value"), F.col(period).alias("current_period"),
        F.coalesce(F.col("_o")["v"], F.when(still, F.col(value))).alias("previous_value"),
        F.coalesce(F.col("_o")["p"], F.when(still, F.col(period))).alias("previous_period"),
    )
