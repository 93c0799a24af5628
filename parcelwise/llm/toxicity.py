"""Operator 8: toxicity of each text from a bidirectional gated recurrent network with attention pooling.

A word is the sum of an embedding of the word and of embeddings of its first letters (the character input, hashed).
Two recurrent nets read each window of words in both directions, attention pools their states, and a logistic unit
scores the window. Windows overlap by half. A text is positive if any of its windows is, which is how the net learns
from labels of whole texts (noisy-or); a text's score is a logistic function of its largest window score and of how many
of its windows score high, fitted on labelled texts that the net has not seen. The net is trained in numpy on the driver
from a bounded sample (``PER_CLASS`` labelled documents of each class); all texts are then scored whole in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh
from parcelwise.llm.language import Adam

LENGTH = 32
STRIDE = 16
SIZE = 8
SLOTS = 1 << 13
PREFIXES = (3, 4, 5)
PER_CLASS = 600
SAMPLE_WORDS = 1200
EPOCHS = (5, 40)
STEPS = 400
HELD_SHARE = 4
BATCH_DOCS = 16
MIN_DOCS = 3
SHRINK = np.float32(0.999)
ROUND = 8192


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Embedding rows of each word: one for the word, one for each length of its first letters (slot 0 is padding)."""
    ids = [sh.word_hashes(data, starts, ends)]
    h = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    with np.errstate(over="ignore"):
        for i in range(max(PREFIXES)):
            h = np.where(starts + i < ends, (h ^ sh.BYTE_KEYS[padded[starts + i]]) * sh.POWER, h)
            if i + 1 in PREFIXES:
                ids.append(sh.mixed(h))
    return np.stack([(x % np.uint64(SLOTS - 1)).astype(np.int32) + 1 + k * SLOTS for k, x in enumerate(ids)], 1)


def read(data: np.ndarray, at: np.ndarray):
    data = sh.LOWER[data]
    starts, ends, row = sh.words(data, at, sh.LETTERLIKE)
    return word_ids(data, starts, ends), row


def window_starts(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of the overlapping windows that cover each text."""
    size = np.bincount(row, minlength=n)
    first = np.cumsum(size) - size
    count = np.where(size > 0, np.maximum(-(-(size - STRIDE) // STRIDE), 1), 0)
    of = np.repeat(np.arange(n), count)
    k = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return first[of] + k, np.minimum(size[of] - k, LENGTH), of


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fresh(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(size=(SLOTS * (1 + len(PREFIXES)), SIZE)) * 0.1, "att": rng.normal(size=(2 * SIZE, SIZE)) * 0.3,
         "att_v": rng.normal(size=SIZE) * 0.3, "out": rng.normal(size=2 * SIZE) * 0.3, "bias": np.array([-4.0])}
    for d in "fb":
        p |= {f"w{d}": rng.normal(size=(SIZE, 3 * SIZE)) * 0.4, f"u{d}": rng.normal(size=(SIZE, 3 * SIZE)) * 0.3, f"c{d}": np.zeros(3 * SIZE)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def recur(gx: np.ndarray, u: np.ndarray, keep: bool):
    """States of a gated recurrent net over gx[time, window]; with ``keep`` also what the way back needs."""
    h = np.zeros((gx.shape[1], SIZE), np.float32)
    states, cache = [], []
    for g in gx:
        gh = h @ u
        zr = sigmoid(g[:, : 2 * SIZE] + gh[:, : 2 * SIZE])
        z, r = zr[:, :SIZE], zr[:, SIZE:]
        new = np.tanh(g[:, 2 * SIZE :] + r * gh[:, 2 * SIZE :])
        if keep:
            cache.append((h, z, r, new, gh[:, 2 * SIZE :]))
        h = new + z * (h - new)
        states.append(h)
    return np.stack(states), cache


def recur_back(dstates: np.ndarray, cache: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    du, dgx, carry = np.zeros_like(u), np.empty((len(cache), dstates.shape[1], 3 * SIZE), np.float32), 0
    for t in range(len(cache) - 1, -1, -1):
        h, z, r, new, ghn = cache[t]
        dh = dstates[t] + carry
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dn * ghn * r * (1 - r)
        dgx[t] = np.concatenate([dz, dr, dn], 1)
        dgh = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dgh
        carry = dh * z + dgh @ u.T
    return dgx, du


def pool(p: dict, states: np.ndarray, there: np.ndarray):
    """Attention over time: pooled states and what the way back needs."""
    a = np.tanh(states @ p["att"])
    s = np.where(there, a @ p["att_v"], -1e9)
    w = np.exp(s - s.max(0))
    w /= w.sum(0)
    return (w[:, :, None] * states).sum(0), a, w


def place(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(LENGTH)[:, None]
    there = t < size
    return np.where(there, start + np.minimum(t, size - 1), 0), there


def train(ids: np.ndarray, row: np.ndarray, y: np.ndarray, seed: int = 8) -> dict:
    p, rng = fresh(seed), np.random.default_rng(seed)
    adam, n = Adam(p, 0.01), len(y)
    size = np.bincount(row, minlength=n)
    first = np.cumsum(size) - size
    docs = np.flatnonzero(size)
    known = np.stack([np.bincount(np.unique(ids[:, k].astype(np.int64) * n + row) // n, minlength=len(p["embed"])) for k in range(ids.shape[1])]).sum(0) >= MIN_DOCS
    p["embed"] *= known[:, None]
    for _ in range(int(np.clip(STEPS * BATCH_DOCS / max(len(docs), 1), *EPOCHS))):
        order = rng.permutation(docs)
        for b in range(0, len(order), BATCH_DOCS):
            part = order[b : b + BATCH_DOCS]
            start = np.concatenate([np.arange(first[i], first[i] + size[i], LENGTH) for i in part])
            of = np.repeat(np.arange(len(part)), -(-size[part] // LENGTH))
            left = np.minimum(first[part][of] + size[part][of] - start, LENGTH)
            at, there = place(ids, start, left)
            slots = ids[at]
            x = p["embed"][slots].sum(2) * there[:, :, None]
            f, cache_f = recur(x @ p["wf"] + p["cf"], p["uf"], True)
            g, cache_b = recur((x @ p["wb"] + p["cb"])[::-1], p["ub"], True)
            states = np.concatenate([f, g[::-1]], 2)
            pooled, a, w = pool(p, states, there)
            q = sigmoid(pooled @ p["out"] + p["bias"])
            none = np.exp(np.bincount(of, np.log1p(-np.minimum(q, 1 - 1e-6)), minlength=len(part)))
            label = y[part]
            d = np.where(label[of] == 1, -(none / np.maximum(1 - none, 1e-6))[of] * q, q) / len(part)
            d = d.astype(np.float32)
            grads = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
            dpool = d[:, None] * p["out"]
            dw = (states * dpool).sum(2)
            ds = w * (dw - (w * dw).sum(0))
            da = ds[:, :, None] * p["att_v"] * (1 - a * a)
            grads["att_v"] = (a * ds[:, :, None]).sum((0, 1))
            grads["att"] = np.tensordot(states, da, ((0, 1), (0, 1)))
            dstates = w[:, :, None] * dpool + da @ p["att"].T
            dx = 0
            for k, cache, ds_, xs in (("f", cache_f, dstates[:, :, :SIZE], x), ("b", cache_b, dstates[::-1, :, SIZE:], x[::-1])):
                dg, grads[f"u{k}"] = recur_back(ds_, cache, p[f"u{k}"])
                grads[f"w{k}"] = np.tensordot(xs, dg, ((0, 1), (0, 1)))
                grads[f"c{k}"] = dg.sum((0, 1))
                back = dg @ p[f"w{k}"].T
                dx = dx + (back if k == "f" else back[::-1])
            flat, many = dx[there], slots[there]
            grads["embed"] = np.zeros_like(p["embed"])
            for k in range(many.shape[1]):
                for c in range(SIZE):
                    grads["embed"][k * SLOTS : (k + 1) * SLOTS, c] = np.bincount(many[:, k] - k * SLOTS, flat[:, c], minlength=SLOTS)
            grads["embed"] *= known[:, None]
            adam.step(grads)
            p["embed"] *= SHRINK
    return p


def window_scores(p: dict, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = p["embed"][ids[:, 0]]
    for k in range(1, ids.shape[1]):
        x = x + p["embed"][ids[:, k]]
    both = [np.concatenate([x @ p[f"w{d}"], np.zeros((1, 3 * SIZE), np.float32)]) for d in "fb"]
    out = []
    for i in range(0, len(start), ROUND):
        at, there = place(ids, start[i : i + ROUND], size[i : i + ROUND])
        at = np.where(there, at, len(ids))
        f, _ = recur(both[0][at] + p["cf"], p["uf"], False)
        g, _ = recur(both[1][at[::-1]] + p["cb"], p["ub"], False)
        pooled, _, _ = pool(p, np.concatenate([f, g[::-1]], 2), there)
        out.append(sigmoid(pooled @ p["out"] + p["bias"]))
    return np.concatenate(out) if out else np.zeros(0)


def summary(q: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """What the score of a text is made of: largest window score, sum and mean of the window scores."""
    best = np.zeros(n)
    np.maximum.at(best, of, q)
    total, count = np.bincount(of, q, minlength=n), np.bincount(of, minlength=n)
    logit = lambda x: np.log((x + 1e-4) / (1 - x + 1e-4))
    return np.stack([logit(best), np.log(total + 1e-2), logit(total / np.maximum(count, 1)), np.ones(n)], 1)


def fit_summary(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge; label 1 counts as ``share`` of all, as among all labels."""
    w = np.zeros(x.shape[1])
    each = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    for _ in range(25):
        q = sigmoid(np.clip(x @ w, -30, 30))
        h = (x * (each * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (each * (y - q)) - 0.05 * w)
    return w


def learn(data: np.ndarray, at: np.ndarray, y: np.ndarray, share: float) -> dict:
    ids, row = read(data, at)
    held = np.arange(len(y)) % HELD_SHARE == 0
    if min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 1:
        held = np.zeros(len(y), bool)
    take = ~held[row]
    net = train(ids[take], (np.cumsum(~held) - 1)[row[take]], y[~held])
    start, size, of = window_starts(row, len(y))
    x = summary(window_scores(net, ids, start, size), of, len(y))
    return net | {"weights": fit_summary(*((x[held], y[held]) if held.any() else (x, y)), share)}


def scorer(model: dict):
    def start():
        def make(data, at):
            n = len(at) - 1
            score = np.zeros(n)
            if "constant" in model:
                score[:] = model["constant"]
            else:
                ids, row = read(data, at)
                first, size, of = window_starts(row, n)
                score = sigmoid(np.clip(summary(window_scores(model, ids, first, size), of, n) @ model["weights"], -30, 30))
                score[np.bincount(of, minlength=n) == 0] = 0
            return [pa.array(score)]

        return make

    return start


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The net from at most ``per_class`` documents of each class, drawn by a hash of the id at twice that rate; of a drawn text, a
    stretch of about SAMPLE_WORDS words. Labels of fewer than two classes give their mean (0 without any)."""
    ours = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled__"), F.col("toxic").cast("int").alias("toxic__"))
    counts = {r[0]: r[1] for r in ours.groupBy("toxic__").count().collect()}
    if len(counts) < 2:
        return {"constant": float(next(iter(counts), 0))}
    share = F.when(F.col("toxic__") == 1, min(1.0, 2.0 * per_class / counts[1])).otherwise(min(1.0, 2.0 * per_class / counts[0]))
    drawn = ours.filter(F.pmod(F.xxhash64("labelled__", F.lit("tox")), F.lit(1 << 30)) <= share * (1 << 30))
    room = F.greatest(F.length("text") - 8 * SAMPLE_WORDS, F.lit(0)) + 1
    cut = F.substring("text", F.pmod(F.xxhash64("doc_id"), room).cast("int") + 1, F.lit(8 * SAMPLE_WORDS))
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled__")).select("doc_id", cut.alias("text"), "toxic__")
    got = found.toArrow().sort_by([("toxic__", "ascending"), ("doc_id", "ascending")])
    y = got.column("toxic__").to_numpy()
    keep = np.flatnonzero(np.arange(len(y)) - np.searchsorted(y, y) < per_class)
    got, y = got.take(pa.array(keep)), y[keep]
    if len(np.unique(y)) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    data, at = sh.packed(got.column("text"))
    return learn(data, at, y, counts[1] / (counts[0] + counts[1]))


def add_scores(docs: DataFrame, labels: DataFrame, keep: list[str], folds: int = 5, held: int = 0) -> DataFrame:
    """``keep`` columns of all documents and score__: the probability of label 1.

    A null text and one without words have score 0.0. Rows without an id are scored, not learnt from; labels other than
    0 and 1 don't count; of several labels of one document each counts.
    """
    fold = sh.remainder("doc_id", folds)
    model = fit(docs.filter(fold != held), labels.filter(fold != held))
    return sh.annotate(docs, keep, "score__ double", scorer(model))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from labels.toxic of the other folds."""
    scored = add_scores(docs, labels, ["doc_id"], folds, held)
    return scored.select("doc_id", F.coalesce(sh.remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"),
                         F.col("score__").alias("score"), (F.col("score__") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score stays under one half."""
    return add_scores(docs, labels, docs.columns).filter(F.col("score__") < 0.5).select(*[f"`{c}`" for c in docs.columns])
