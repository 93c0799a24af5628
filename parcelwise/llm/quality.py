"""Operator 9: quality scores from document statistics.

Random Fourier features stand in for a Gaussian kernel over standardised statistics. Each task sums the normal
equations of its labelled rows; the sums are added in two steps and solved once for the ridge weights. Scores of the
labelled rows are made monotone probabilities by isotonic calibration on a histogram.

All labelled rows are used: what leaves a task has one fixed size. Texts are read once, to statistics; labels are
joined to those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

FEATURES = 192
RIDGE = 1.0
WIDTH = 4.0
BINS = 2000
CALIBRATION_SHARE = 5
STATISTICS = 18


def kinds(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


CLASSES = np.stack([
    kinds(range(65, 91)), kinds(range(97, 123)), kinds(range(48, 58)), kinds(range(128, 256)), kinds(b"\n"), kinds(b"!"), kinds(b"|"),
    kinds(b"#$%&*~^=_<>{}[]\\/@+"), kinds(b".?"), kinds(b",;:"),
]).astype(np.int64)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    n = len(at) - 1
    size = np.diff(at)
    row_of = np.repeat(np.arange(n), size)
    counts = np.bincount(row_of * 256 + data, minlength=n * 256).reshape(n, 256) @ CLASSES.T
    starts, ends, row = sh.words(data, at, ~sh.SPACE)
    words = np.bincount(row, minlength=n)
    hashes = sh.word_hashes(sh.LOWER[data], starts, ends)
    order = np.lexsort([hashes, row])
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    length = ends - starts
    per_word = [np.bincount(row, w, minlength=n) / np.maximum(words, 1) for w in (
        length.astype(float), np.minimum(length, 40.0) ** 2 / 40, again.astype(float), (length > 16).astype(float), (length == 1).astype(float))]
    distinct = np.bincount(row[order][fresh], minlength=n) / np.maximum(words, 1)
    shares = np.sqrt(counts / np.maximum(size, 1)[:, None])
    return np.column_stack([np.log1p(size), np.log1p(words), distinct, *per_word, shares]).astype(np.float32)


def vectors(rows: np.ndarray) -> pa.Array:
    cuts = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(cuts, pa.array(rows.ravel(), pa.float32()))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and stats__, the statistics of each whole text."""
    return sh.annotate(docs, keep, "stats__ array<float>", lambda: lambda data, at: [vectors(statistics(data, at))])


def basis(seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(STATISTICS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    w, b = basis()
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b) * np.sqrt(2 / FEATURES)
    return np.concatenate([z, np.ones((len(x), 1))], 1)


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), STATISTICS)


def equations(mean: np.ndarray, scale: np.ndarray):
    def run(batches):
        size = FEATURES + 1
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = fourier(matrix(batch.column("stats__")), mean, scale)
            left += z.T @ z
            right += z.T @ batch.column("label").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([left.ravel(), right]).tobytes()], pa.binary())], ["sums"])

    return run


def added(table: pa.Table) -> pa.Table:
    return pa.table({"sums": pa.array([sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist()).tobytes()], pa.binary())})


def isotonic(values: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled neighbours: value and rising probability of each block."""
    blocks: list[list[float]] = []
    for v, w, p in zip(values, weight, positive, strict=True):
        blocks.append([v * w, w, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(measured: DataFrame, labels: DataFrame, label: str) -> dict:
    """The model from measured documents and labels (doc_id, ``label`` 0 or 1); other labels and missing ids don't count.

    Labels of fewer than two classes give a model whose score is their mean (0.5 without any).
    """
    spark = measured.sparkSession
    ours = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("labelled__"), F.col(label).cast("double").alias("label"))
    rows = sh.save(measured.select("doc_id", "stats__").join(ours, F.col("doc_id") == F.col("labelled__")).select(
        "stats__", "label", (F.pmod(F.xxhash64("labelled__"), F.lit(CALIBRATION_SHARE)) == 0).alias("calibrate")), "quality")
    told = rows.agg(F.count("*"), F.avg("label"), *[g(F.col("stats__")[i]) for i in range(STATISTICS) for g in (F.avg, F.stddev_pop)]).first()
    if not told[0] or told[1] in (0.0, 1.0):
        return {"constant": told[1] if told[0] else 0.5}
    mean, scale = np.array(told[2::2]), np.maximum(np.array(told[3::2]), 1e-3)
    parts = rows.filter("not calibrate").select("stats__", "label").mapInArrow(equations(mean, scale), "sums binary")
    few = max(1, int(spark.sparkContext.defaultParallelism))
    sums = parts.withColumn("to", F.pmod(F.xxhash64("sums"), F.lit(few))).groupBy("to").applyInArrow(lambda t: added(t.select(["sums"])), "sums binary")
    total = sum(np.frombuffer(r[0], float) for r in sums.collect())
    size = FEATURES + 1
    left = total[: size * size].reshape(size, size)
    model = {"mean": mean, "scale": scale, "weights": np.linalg.solve(left + RIDGE * np.eye(size), total[size * size :])}
    scored = rows.filter("calibrate").select("stats__", "label").mapInArrow(raw_scores(model), "score double, label double")
    hist = scored.groupBy(F.round(F.col("score") * BINS).alias("bin")).agg(F.avg("score"), F.count("*"), F.sum("label")).orderBy("bin").collect()
    if hist:
        model["steps"] = isotonic(*(np.array([r[i] for r in hist], float) for i in (1, 2, 3)))
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    raw = np.clip(fourier(x, model["mean"], model["scale"]) @ model["weights"], -1.0, 2.0)
    return raw if "steps" not in model else np.interp(raw, *model["steps"])


def raw_scores(model: dict):
    model = {k: v for k, v in model.items() if k != "steps"}

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(predict(model, matrix(batch.column("stats__")))), batch.column("label")], ["score", "label"])

    return run


def score(measured: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns of the measured documents and score__ (0 to 1, higher: label 1 likelier)."""
    source = measured.select(*[f"`{c}`" for c in keep], "stats__")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("stats__").schema), "score__ double"])

    def run(batches):
        for batch in batches:
            made = np.clip(predict(model, matrix(batch.column("stats__"))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], names=[*keep, "score__"])

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from labels.quality of the other folds.

    An empty text or a null one is scored by its statistics, all zero. Rows without an id are scored and count as not
    held out; repeated documents get a row each.
    """
    fold = sh.remainder("doc_id", folds)
    measured = sh.save(measure(docs, ["doc_id"]), "statistics")
    model = fit(measured.filter(fold != held), labels.filter(fold != held), "quality")
    scored = score(measured, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col("score__").alias("score"), (F.col("score__") >= 0.5).cast("int").alias("predicted"))
