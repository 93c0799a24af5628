"""Joins that keep their shape when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parcelwise.session import ensure_checkpoint_dir


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows per key to one row per key, whatever a key holds.

    Every row gets a sub-key from a hash of its columns, as many as there are shuffle partitions. The existing
    (key, sub-key) pairs get the key's one partner row, at most one pair per partition for the most frequent key, and
    the rows are joined to those. So no key's rows meet in one task, without counting or listing keys. Rows without a
    key match nothing; they are spread too.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    pairs = salted.select(*keys, "_salt").distinct().join(per_key, list(keys))
    return salted.join(pairs, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key. Spark keeps only one row per key and map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their number; cut to ``n`` per map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in a total order without a one-task window.

    Spark sorts by range; the sorted rows are saved once, so that the positions cannot move if a task is
    run again, and the row counts of the sorted parts give each part its first number.
    """
    ensure_checkpoint_dir(df.sparkSession)
    pos = F.monotonically_increasing_id()
    saved = df.orderBy(*order).withColumn("_pos", pos).checkpoint(eager=True)
    part = F.shiftright("_pos", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted part, so this window is as small as the number of shuffle partitions
    parts = saved.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    in_part = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        saved.withColumn("_part", part).join(F.broadcast(parts), "_part")
        .withColumn(name, (F.col("_before") + in_part + 1).cast("bigint"))
        .drop("_part", "_pos", "_n", "_before")
    )


# ---- fixed-shape joins -------------------------------------------------------------------------------


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side once, with ``status`` matched / left_only / right_only."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_l") & F.col("_r"), "matched").when(F.col("_l"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def crosswalk(features: DataFrame, attributes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Crosswalk attributes first, the feature's own as fallback, and which of the two was used.

    Both sides have ``key`` and ``fields``; ``attributes`` is unique on ``key``.
    """
    right = attributes.select(key, *[F.col(f).alias(f"_x_{f}") for f in fields], F.lit(True).alias("_x"))
    out = features.join(right, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.nullif(F.col(f"_x_{f}"), F.lit("")), F.nullif(F.col(f), F.lit(""))))
    how = F.when(F.col("_x"), "crosswalk").otherwise("feature")
    return out.withColumn("join_method", how).drop("_x", *[f"_x_{f}" for f in fields])


def keep_areas(areas: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Left join that keeps areas without a value and flags them."""
    return areas.join(values, key, "left").withColumn("missing", F.col(value).isNull())
