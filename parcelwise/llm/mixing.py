"""Operator 6: mixes sources, languages and topics to target token shares by iterative proportional fitting.

Documents are summed to cells (source, language, topic) with map-side sums; the table of cells goes to the driver. The
token weights of the cells are scaled to the target share of each source, then of each language, then of each topic, in
turns, until no scale moves. They are then blown up to a token budget. A cell that would need more tokens than it has is
kept whole, and the rest is raked again to what is left of the targets, until no cell is short; a rare cell so never
decides about the others. The weight of a cell per token it has is the probability of its documents. A document is drawn
when a hash of it falls under its probability, so the draw is the same on every run and executor.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.9
TURNS = 10_000
CLOSE = 1e-6
#: Without a budget: cells kept whole may hold this share of all tokens.
WHOLE = 0.002
SEED = 6
MISSING = "(none)"
MARKS = np.zeros(256, bool)
MARKS[[*range(48, 58), *b"|#$%&*<>{}[]=/_"]] = True


def measure(data: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Tokens (words between blanks) and topic, the kind of text: short, marks (many digits and signs), long or prose."""
    n = len(at) - 1
    _, _, row = sh.words(data, at, ~sh.SPACE)
    words = np.bincount(row, minlength=n)
    sums = np.concatenate([[0], np.cumsum(MARKS[data])])
    share = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
    topic = np.where(words < 50, "short", np.where(share >= 0.03, "marks", np.where(words >= 1000, "long", "prose")))
    return [pa.array(words.astype(np.int64)), pa.array(topic.tolist(), pa.string())]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, source__ and lang__ (missing ones named), tokens__, topic__ and draw__, a number from 0 to 1."""
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    named = docs.withColumns({**{f"{c}__": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in ("source", "lang")}, "draw__": draw})
    return sh.annotate(named, [*keep, "source__", "lang__", "draw__"], "tokens__ long, topic__ string", lambda: measure)


def tempered(sums: np.ndarray) -> np.ndarray:
    """Default target of a dimension: its token sums to the power TEMPER, which lifts the small ones."""
    return np.where(sums > 0, np.maximum(sums, 1.0) ** TEMPER, 0.0)


def scaled(weight: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Weights in the proportions of the given ones whose sums over each dimension are the wanted ones.

    Targets that contradict each other are met as far as turns bring them nearer, the topics exactly.
    """
    before = np.inf
    for turn in range(TURNS):
        moved = 0.0
        for code, want in zip(codes, wanted, strict=True):
            now = np.bincount(code, weight, minlength=len(want))
            scale = np.divide(want, now, out=np.zeros(len(want)), where=now > 0)[code]
            moved = max(moved, np.abs(scale - 1)[weight > 0].max(initial=0.0))
            weight = weight * scale
        if moved < CLOSE:
            break
        if turn % 200 == 199:
            if moved > 0.99 * before:
                break
            before = moved
    return weight


def rates(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], budget: float | None) -> np.ndarray:
    """Probability of each cell: ``budget`` is the share of all tokens to keep, at most what cells with a target have.

    Without a budget it is the largest for which the cells that the first raking finds short hold at most WHOLE of the
    tokens. What cells kept whole can't give goes to the other values of the dimension, in proportion.
    """
    weight = scaled(tokens.astype(float), codes, shares)
    ratio = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    reach = tokens[ratio > 0].sum()
    if not reach:
        return np.where(tokens > 0, 0.0, 1.0)
    if budget is None:
        order = np.argsort(-ratio, kind="stable")
        first = order[min(np.searchsorted(np.cumsum(tokens[order]), WHOLE * tokens.sum(), side="right"), len(order) - 1)]
        size = min(reach, 1 / ratio[first]) if ratio[first] > 0 else reach
    else:
        size = min(reach, budget * tokens.sum())
    left, weight = [s * size for s in shares], weight * size
    free = ratio > 0
    while (over := free & (weight > tokens * (1 + 1e-6))).any():
        free &= ~over
        rest = size - tokens[(ratio > 0) & ~free].sum()
        if rest <= 0 or not free.any():
            break
        for d, code in enumerate(codes):
            n = len(left[d])
            now = np.where(np.bincount(code, free, minlength=n) > 0, np.maximum(0.0, left[d] - np.bincount(code, tokens * over, minlength=n)), 0.0)
            left[d] = now * (rest / (now.sum() or 1.0))
        weight = scaled(np.where(free, tokens, 0.0), codes, left)
    kept = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    return np.where(tokens > 0, np.where(free, np.minimum(1.0, kept), np.where(ratio > 0, 1.0, 0.0)), 1.0)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, lang, topic, tokens, probability) of each cell, and (dimension, value, target, share, kept): the target share and
    the expected share of each value among the tokens drawn, and the part of its own tokens that is kept.

    A target is (value, share); shares are scaled to one over the values that have tokens, values without a target
    get none, and values without tokens can't be met. Cells without tokens have probability 1.
    """
    spark, table = cells.sparkSession, cells.select(*DIMENSIONS, "tokens").orderBy(*DIMENSIONS).toArrow()
    tokens = table.column("tokens").to_numpy().astype(np.int64)
    values, codes, shares = [], [], []
    for d in DIMENSIONS:
        coded = table.column(d).combine_chunks().dictionary_encode()
        values.append(coded.dictionary.to_pylist())
        codes.append(coded.indices.to_numpy().astype(np.int64))
        sums = np.bincount(codes[-1], tokens, minlength=len(values[-1]))
        given = (targets or {}).get(d)
        if given is None:
            share = tempered(sums)
        else:
            asked = {r[0]: float(r[1] or 0) for r in given.select("value", "share").collect()}
            share = np.where(sums > 0, np.array([asked.get(v, 0.0) for v in values[-1]]), 0.0)
        shares.append(share / (share.sum() or 1.0))
    p = rates(tokens, codes, shares, budget)
    total = (p * tokens).sum()
    told = []
    for d, names, code, share in zip(DIMENSIONS, values, codes, shares, strict=True):
        got, there = np.bincount(code, p * tokens, minlength=len(names)), np.bincount(code, tokens, minlength=len(names))
        told += [(d, v, float(t), float(g / (total or 1.0)), float(g / n) if n else 1.0) for v, t, g, n in zip(names, share, got, there, strict=True)]
    if max((abs(t - s) for _, _, t, s, _ in told), default=0.0) > 0.01:
        logging.getLogger(__name__).warning("mixing: a target share is missed by more than 0.01; rake() has the shares reached")
    odds = pa.table({**{d: table.column(d) for d in DIMENSIONS}, "tokens": pa.array(tokens), "probability": pa.array(p)})
    frame = spark.createDataFrame(odds) if len(tokens) else cells.selectExpr(*DIMENSIONS, "tokens", "cast(1 as double) probability")
    return frame, spark.createDataFrame(told, "dimension string, value string, target double, share double, kept double")


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[F.col(f"{d}__").alias(d) for d in DIMENSIONS]).agg(F.sum("tokens__").alias("tokens"))


def report(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> DataFrame:
    """(dimension, value, target, share, kept): how far a draw meets its targets."""
    return rake(cells_of(measured(docs, [])), targets, budget)[1]


def probabilities(docs: DataFrame, keep: list[str], targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> DataFrame:
    """``keep`` columns of every document with source__, lang__, topic__, tokens__, probability__ and draw__."""
    rows = measured(docs, keep)
    raked, _ = rake(cells_of(rows), targets, budget)
    odds = sh.save(raked.select(*[F.col(d).alias(f"of_{d}__") for d in DIMENSIONS], F.col("probability").alias("probability__")), "odds")
    same = (F.col("source__") == F.col("of_source__")) & (F.col("lang__") == F.col("of_lang__")) & (F.col("topic__") == F.col("of_topic__"))
    return rows.join(odds, same).drop(*[f"of_{d}__" for d in DIMENSIONS])


def drawn(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, sampled) of every document.

    A missing source or language is the value "(none)"; texts without words weigh nothing and share the probability of
    their cell (1 where the whole cell has no words). Repeated rows are drawn alike.
    """
    p = probabilities(docs, ["doc_id"], targets, budget)
    return p.select("doc_id", F.col("source__").alias("source"), F.col("lang__").alias("lang"), F.col("topic__").alias("topic"), F.col("tokens__").alias("n_tokens"),
                    F.col("probability__").alias("probability"), (F.col("draw__") < F.col("probability__")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> DataFrame:
    """The drawn documents, all columns, with the probability each was drawn by (mix_probability)."""
    p = probabilities(docs, docs.columns, targets, budget).filter("draw__ < probability__")
    return p.select(*[f"`{c}`" for c in docs.columns if c != "mix_probability"], F.col("probability__").alias("mix_probability"))
