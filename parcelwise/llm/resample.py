"""Operator 11: importance resampling towards a target text set, ranked by a distributed radix sort.

Weights. Features are runs of words, hashed to ``BUCKETS`` buckets. Tasks count their buckets in an array, the counts of all
documents and of all target texts are summed per bucket, and the gains of the buckets (an array of fixed size) go to the
tasks that score whole texts. Scores are weight plus Gumbel noise from a hash of the id, so the highest are a draw without
replacement by weight.

Ranks. The composite key (score falling, id rising) is cut into digits of ``DIGIT`` bits and sorted from the last digit to
the first. Each pass is a stable counting sort over blocks of ``ROWS`` positions: blocks count their digits, prefix sums
over (digit, block) give the first destination of each digit in each block, and a row's destination is that plus the
number of equal digits before it in its block. Rows move to block destination // ROWS, so every block of the next pass is
equally full whatever the keys are. Passes are saved in the shared folder: a lost executor repeats one pass at most.
Digits in which all keys agree are skipped (the number of passes follows the range of ids and scores).

Rows without an id are left out, in counts and results. A null text has no words. Repeated ids get a rank each; equal keys
stand in the order of the saved rows, which is fixed once written. An empty table gives no rows, an empty target counts
as no features.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
LEAST = 20
PERCENT = 10
ROWS = 8192
DIGIT = 10
#: Longer pieces are hashed one by one, shorter ones side by side.
SIDE_BY_SIDE = 48


def crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = crc_table()


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each piece data[start:end], continued from ``state`` (the CRC so far) where given."""
    crc = (np.zeros(len(starts), np.uint32) if state is None else state.astype(np.uint32)) ^ np.uint32(0xFFFFFFFF)
    length = ends - starts
    for i in np.flatnonzero(length > SIDE_BY_SIDE):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]], int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.where(length > SIDE_BY_SIDE, 0, length)
    order = np.argsort(-short, kind="stable")
    left = np.searchsorted(-short[order], -np.arange(1, SIDE_BY_SIDE + 1), side="right")
    run, at = crc[order], starts[order]
    for p, n in enumerate(left):
        if not n:
            break
        byte = data[at[:n] + p]
        run[:n] = CRC[(run[:n] ^ byte) & np.uint32(255)] ^ (run[:n] >> np.uint32(8))
    crc[order] = run
    return crc ^ np.uint32(0xFFFFFFFF)


def features(data: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of each run of 1 to ``longest`` words, and the number of words of each row."""
    low = sh.LOWER[data]
    starts, ends, row = sh.words(low, at, sh.LETTERLIKE)
    crc = crc_of(low, starts, ends)
    found, rows, space = [crc], [row], np.array([32], np.uint8)
    for n in range(2, longest + 1):
        same = row[n - 1 :] == row[: len(row) - n + 1]
        k = np.flatnonzero(same)
        before = np.zeros(len(row), np.uint32)
        before[rows_at(found[-1], n, row)] = found[-1]
        joint = crc_of(space, np.zeros(len(k), np.int64), np.ones(len(k), np.int64), before[k])
        found.append(crc_of(low, starts[k + n - 1], ends[k + n - 1], joint))
        rows.append(row[k])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows), np.bincount(row, minlength=len(at) - 1)


def rows_at(values: np.ndarray, n: int, row: np.ndarray) -> np.ndarray:
    """First word of each of the runs of n - 1 words, in order."""
    if n == 2:
        return np.arange(len(row))
    return np.flatnonzero(row[n - 2 :] == row[: len(row) - n + 2])[: len(values)]


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts lie in each bucket. A task sends its filled buckets, Spark sums them."""
    sh.ship(texts.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = sh.packed(batch.column(0))
            for i, j in sh.pieces(at):
                hashed, _, _ = features(data[at[i] : at[j]], at[i : j + 1] - at[i], longest)
                total += np.bincount(hashed % buckets, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets, s, t = len(source), int(source.sum()), int(target.sum())
    one = lambda a, b: math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets))))
    return np.array([one(a, b) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str], longest: int) -> DataFrame:
    """``keep`` and n_features, n_words__, weight (the floored mean gain of all features)."""

    def start():
        def make(data, at):
            hashed, row, words = features(data, at, longest)
            n = np.bincount(row, minlength=len(at) - 1)
            order = np.argsort(row, kind="stable")
            sums = np.zeros(len(row) + 1, np.int64)
            np.cumsum(gain[hashed[order] % len(gain)], out=sums[1:])
            edge = np.concatenate([[0], np.cumsum(n)])
            mean = (sums[edge[1:]] - sums[edge[:-1]]) // np.maximum(n, 1)
            return [pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(mean)]

        return make

    return sh.annotate(docs, keep, "n_features long, n_words__ long, weight long", start)


def noise(seed: int):
    """Gumbel noise in thousandths, from the first 32 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


# ---- radix sort --------------------------------------------------------------------------------------


def digits(name: str, low: int, high: int) -> list[Column]:
    """The digits of a key column that can differ, last first. Keys count up from their least; a range of 63 bits or more,
    where that could overflow, is taken as it is with the sign bit turned."""
    width = (high - low).bit_length()
    value = f"({name} - ({low}L))" if width < 63 else f"({name} ^ shiftleft(1L, 63))"
    return [F.expr(f"cast(shiftrightunsigned({value}, {shift}) & {(1 << DIGIT) - 1}L as int)") for shift in range(0, width, DIGIT)]


def placed(rows: DataFrame, digit: Column, label: str) -> DataFrame:
    """One stable counting-sort pass: ``block__`` and ``at__`` (position in the block) are those of the next order."""
    rows = rows.withColumn("digit__", digit)
    counts = rows.groupBy("digit__", "block__").agg(F.count("*").alias("n__"))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("first__", F.coalesce(F.sum("n__").over(upto.partitionBy("digit__").orderBy("block__")), F.lit(0)))
    # one row per digit value, 2 ** DIGIT at most
    totals = counts.groupBy("digit__").agg(F.sum("n__").alias("all__"))
    base = totals.select("digit__", F.coalesce(F.sum("all__").over(upto.partitionBy(F.lit(0)).orderBy("digit__")), F.lit(0)).alias("base__"))
    offsets = inside.join(F.broadcast(base), "digit__").select(F.col("block__").alias("of__"), F.col("digit__").alias("value__"), (F.col("first__") + F.col("base__")).alias("to__"))

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at__")
        digit = left.column("digit__").to_numpy()
        first = np.zeros(1 << DIGIT, np.int64)
        first[right.column("value__").to_numpy()] = right.column("to__").to_numpy()
        order = np.argsort(digit, kind="stable")
        seen = np.bincount(digit, minlength=1 << DIGIT)
        rank = np.arange(len(digit)) - np.repeat(np.cumsum(seen) - seen, seen)
        to = np.empty(len(digit), np.int64)
        to[order] = first[digit[order]] + rank
        names = [c for c in left.column_names if c != "digit__"]
        new = {"block__": pa.array(to // ROWS), "at__": pa.array(to % ROWS)}
        return pa.table([new[c] if c in new else left.column(c) for c in names], names=names)

    schema = rows.drop("digit__").schema
    return sh.save(rows.groupBy("block__").cogroup(offsets.groupBy("of__")).applyInArrow(go, schema), label)


def radix_ranks(rows: DataFrame, first: str, second: str) -> DataFrame:
    """``rank`` from 1 of every row by two long columns, both rising, by least-significant-digit radix sort."""
    spans = rows.agg(F.min(first), F.max(first), F.min(second), F.max(second)).first()
    if spans[0] is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    part = F.monotonically_increasing_id()
    # The order of the saved rows; blocks of it hold ROWS rows at most.
    rows = rows.withColumns({"key_a__": F.col(first), "key_b__": F.col(second), "at__": part})
    rows = sh.save(rows, "radix-rows").withColumn("block__", F.floor(F.col("at__") / ROWS).cast("long")).withColumn("at__", F.pmod("at__", F.lit(ROWS)))
    # at least one pass: it also packs the blocks
    passes = digits("key_b__", spans[2], spans[3]) + digits("key_a__", spans[0], spans[1]) or [F.lit(0)]
    for i, digit in enumerate(passes):
        rows = placed(rows, digit, f"radix-{i}")
    return rows.withColumn("rank", F.col("block__") * ROWS + F.col("at__") + 1).drop("block__", "at__", "key_a__", "key_b__")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
             least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document with an id."""
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = sh.save(weigh(docs, gain, ["doc_id"], longest).withColumn("score", F.col("weight") + noise(seed)), "resample-scored")
    able = F.col("n_words__") >= least
    quota = scored.agg(F.floor(F.count_if(able) * percent / 100)).first()[0] or 0
    ranked = radix_ranks(scored.where(able).withColumn("falling__", -F.col("score")), "falling__", "doc_id")
    drawn = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    rest = scored.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
