"""Comparing table snapshots: pairs, numbers, classes, fields, inventories, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Smallest change that counts, and the decimals of a reported change.
TOLERANCE, DECIMALS = 0.005, 4


def pair_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs that were added or removed; both tables have the same columns and repeats do not count."""
    return (
        new.subtract(old).withColumn("change", F.lit("added"))
        .unionByName(old.subtract(new).withColumn("change", F.lit("removed")))
    )


def _presence(old: Column, new: Column) -> Column:
    return F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "removed")


def number_changes(old: DataFrame, new: DataFrame, key: str, value: str, limit: int | None = None) -> DataFrame:
    """Added, removed and updated values by key; a list limit is a report option and is off by default."""
    o, n = F.col("old"), F.col("new")
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full_outer")
    kind = F.coalesce(_presence(o, n), F.when(F.abs(o - n) > TOLERANCE, "updated"))
    out = both.withColumn("change", kind).where("change is not null").withColumn(
        "delta", F.when(F.col("change") == "updated", F.bround(n - o, DECIMALS)))
    return out.orderBy(key).limit(limit) if limit else out


def comparison_changes(old: DataFrame, new: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """As ``number_changes``, and a changed class counts as an update too."""
    a = old.select(key, F.col(value).alias("old_value"), F.col(label).alias("old_label"), F.lit(True).alias("_o"))
    b = new.select(key, F.col(value).alias("new_value"), F.col(label).alias("new_label"), F.lit(True).alias("_n"))
    moved = F.coalesce(F.abs(F.col("old_value") - F.col("new_value")) > TOLERANCE, F.lit(False))
    relabelled = ~F.col("old_label").eqNullSafe(F.col("new_label"))
    kind = F.coalesce(_presence(F.col("_o"), F.col("_n")), F.when(moved | relabelled, "updated"))
    return a.join(b, key, "full_outer").withColumn("change", kind).where("change is not null").withColumn(
        "delta", F.when((F.col("change") == "updated") & moved, F.bround(F.col("new_value") - F.col("old_value"), DECIMALS))
    ).drop("_o", "_n")


def field_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Field by field difference of two one-row tables."""
    def long(df: DataFrame, name: str) -> DataFrame:
        text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        return text.unpivot([], list(df.columns), "field", name)

    both = long(old, "old").join(long(new, "new"), "field", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def inventory_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Checksum changes between two inventories (path, sha256, byte_length)."""
    a = old.select("path", F.col("sha256").alias("old_sha256"))
    b = new.select("path", F.col("sha256").alias("new_sha256"))
    o, n = F.col("old_sha256"), F.col("new_sha256")
    kind = F.coalesce(_presence(o, n), F.when(o != n, "updated"))
    return a.join(b, "path", "full_outer").withColumn("change", kind).where("change is not null")


# Status files that may change after a snapshot is taken.
SKIPPED = ("status.json", "manifest.json", "latest.json", "_headers", "cache-control.json", "security-headers.json")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def verify_inventory(manifest: DataFrame, actual: DataFrame, skip: Sequence[str] = ("manifest.json",)) -> DataFrame:
    """One row per problem: missing, checksum mismatch, length mismatch, untracked."""
    m = manifest.select("path", F.col("sha256").alias("m_sha"), F.col("byte_length").alias("m_len"), F.lit(True).alias("_m"))
    a = actual.select("path", F.col("sha256").alias("a_sha"), F.col("byte_length").alias("a_len"), F.lit(True).alias("_a"))
    both = m.join(a, "path", "full_outer").where(~base_name(F.col("path")).isin(*skip))
    listed, there = F.col("_m").isNotNull(), F.col("_a").isNotNull()
    problems = F.array_compact(F.array(
        F.when(listed & ~there, "missing"),
        F.when(listed & there & (F.col("m_sha") != F.col("a_sha")), "checksum mismatch"),
        F.when(listed & there & (F.col("m_len") != F.col("a_len")), "byte_length mismatch"),
        F.when(~listed & there & ~base_name(F.col("path")).isin(*SKIPPED), "untracked"),
    ))
    return both.select("path", F.explode(problems).alias("problem"))


def row_ids(df: DataFrame, columns: Sequence[str], name: str = "row_id") -> DataFrame:
    """Content id per row over the named columns in name order; equal content gives an equal id."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def line_hash(*parts: Column) -> Column:
    """Hash of one inventory line: parts joined by a separator that cannot occur in them."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# a sha-256 in hex is cut into four numbers of 16 hex digits each
_LANES = 4


def digest(df: DataFrame, *parts: Column) -> DataFrame:
    """One digest for a whole table that does not depend on row order or partitioning.

    Every line is hashed; the four 64-bit parts of the hashes are added up exactly and the sums are hashed.
    Sums combine before the shuffle, so any number of rows, equal rows included, goes through one small
    aggregate and no task holds a list.
    """
    lanes = df.select(line_hash(*parts).alias("_h")).select(*[
        F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").alias(f"_l{i}") for i in range(_LANES)])
    sums = lanes.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"_l{i}"), F.lit(0)).cast("string").alias(f"_l{i}")
                                              for i in range(_LANES)])
    text = F.concat_ws("-", F.col("n").cast("string"), *[F.col(f"_l{i}") for i in range(_LANES)])
    return sums.select("n", F.sha2(text, 256).alias("digest"))


def inventory_digest(inventory: DataFrame) -> DataFrame:
    """Digest of (path, sha256, byte_length), status files left out."""
    kept = inventory.where(~base_name(F.col("path")).isin(*SKIPPED))
    return digest(kept, F.col("path"), F.col("sha256"), F.col("byte_length"))


def snapshot_id(built_at: Column, digest_hex: Column) -> Column:
    """Time stamp in UTC and the first seven hex digits of the digest."""
    return F.concat(F.date_format(built_at, "yyyy-MM-dd'T'HHmmss'Z'"), F.lit("-"), F.substring(digest_hex, 1, 7))


def tagged_union(layers: dict[str, DataFrame], column: str = "layer") -> DataFrame:
    """Review rows of several layers in one table, each tagged with its layer."""
    parts = [df.withColumn(column, F.lit(name)) for name, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
