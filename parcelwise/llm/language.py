"""Operator 10: language of each text from a byte convolutional network.

Bytes are embedded, filters of several widths run over windows of a fixed length, each filter keeps its largest value,
and a softmax reads those. The net is trained in numpy on the driver from a bounded sample of labelled windows
(``PER_LANGUAGE`` documents of each language); texts are then scored whole, window after window, in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh
from parcelwise.operators.joins import top_per_key

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBEDDED = 8
PER_LANGUAGE = 300
WINDOWS_EACH = 3
EPOCHS = 12
BATCH = 64
ROUND = 1024
UNKNOWN = "und"


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of bytes, class numbers and languages of a bounded sample: the rows with the least hash of the id in each
    language (ties: whichever). One scan for all languages; every task keeps ``per_language`` rows of each before the shuffle.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    cuts = [F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(i)), room).cast("int") + 1, F.lit(WINDOW)) for i in range(WINDOWS_EACH)]
    drawn = top_per_key(rows.select("lang", F.xxhash64("doc_id", F.lit("lang")).alias("draw"), F.array(*cuts).alias("cuts")), ["lang"], per_language, F.asc("draw"))
    found = sorted((r.lang, r.draw, r.cuts) for r in drawn.collect())
    langs = sorted({lang for lang, _, _ in found})
    number = {lang: k for k, lang in enumerate(langs)}
    x = [np.frombuffer(text.encode()[:WINDOW].ljust(WINDOW, b"\0"), np.uint8) for _, _, texts in found for text in texts]
    y = [number[lang] for lang, _, texts in found for _ in texts]
    return (np.stack(x) if x else np.zeros((0, WINDOW), np.uint8)), np.array(y, int), langs


class Adam:
    def __init__(self, params: dict, rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 10) -> dict:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(size=(256, EMBEDDED)) * 0.3, "out": rng.normal(size=(FILTERS * len(WIDTHS), classes)) * 0.1, "bias": np.zeros(classes)}
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(size=(w, EMBEDDED, FILTERS)) / np.sqrt(w * EMBEDDED)
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    adam = Adam(p, 0.01)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            xb, yb = x[order[a : a + BATCH]], y[order[a : a + BATCH]]
            n = len(xb)
            e = p["embed"][xb]
            best, arg = [], []
            for w in WIDTHS:
                at = sum(e[:, o : WINDOW - w + 1 + o] @ p[f"f{w}"][o] for o in range(w))
                k = at.argmax(1)
                arg.append(k)
                best.append(np.take_along_axis(at, k[:, None], 1)[:, 0] + p[f"b{w}"])
            z = np.maximum(np.concatenate(best, 1), 0)
            logits = z @ p["out"] + p["bias"]
            q = np.exp(logits - logits.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), yb] -= 1
            q /= n
            g = {"out": z.T @ q, "bias": q.sum(0), "embed": np.zeros_like(p["embed"])}
            dz = (q @ p["out"].T) * (z > 0)
            for i, w in enumerate(WIDTHS):
                d = dz[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"b{w}"] = d.sum(0)
                gf = np.zeros_like(p[f"f{w}"])
                for o in range(w):
                    byte = np.take_along_axis(xb, arg[i] + o, 1)
                    gf[o] = np.einsum("bfe,bf->ef", p["embed"][byte], d)
                    np.add.at(g["embed"], byte, d[:, :, None] * p[f"f{w}"][o].T[None])
                g[f"f{w}"] = gf
            adam.step(g)
    return p


def tables(p: dict) -> list[list[np.ndarray]]:
    """For each width and place in the filter: byte -> what it adds to each filter."""
    return [[np.ascontiguousarray(p["embed"] @ p[f"f{w}"][o]) for o in range(w)] for w in WIDTHS]


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of each class for windows of bytes."""
    p, out = model["net"], []
    for a in range(0, len(x), ROUND):
        xb = x[a : a + ROUND]
        best = []
        for w, places in zip(WIDTHS, model["tables"], strict=True):
            at = np.take(places[0], xb[:, : WINDOW - w + 1], axis=0)
            for o in range(1, w):
                at += np.take(places[o], xb[:, o : WINDOW - w + 1 + o], axis=0)
            best.append(at.max(1) + p[f"b{w}"])
        logits = np.maximum(np.concatenate(best, 1), 0) @ p["out"] + p["bias"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        out.append(q / q.sum(1, keepdims=True))
    return np.concatenate(out) if out else np.zeros((0, len(model["langs"])), np.float32)


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that together cover each text (the last one ends with it; short texts are filled up), and their rows."""
    size = np.diff(at)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = at[row] + np.minimum(k * WINDOW, np.maximum(size[row] - WINDOW, 0))
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start]
    short = size[row] < WINDOW
    x[short] = np.where(np.arange(WINDOW) < size[row[short]][:, None], x[short], np.uint8(0))
    return x, row


ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    found = sums[at[1:]] > sums[at[:-1]]
    for i in np.flatnonzero(~found & (np.diff(at) > 0)):
        found[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predictor(model: dict | None):
    def start():
        def make(data, at):
            n = len(at) - 1
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None and n:
                x, row = windows(data, at)
                q = scores(model, x)
                total = np.stack([np.bincount(row, q[:, k], minlength=n) for k in range(q.shape[1])], 1) / np.maximum(np.bincount(row, minlength=n), 1)[:, None]
                ok = has_letter(data, at)
                lang[ok] = np.array(model["langs"], object)[total[ok].argmax(1)]
                score[ok] = np.clip(total[ok].max(1), 0, 1)
            return [pa.array(lang, pa.string()), pa.array(score)]

        return make

    return start


def fit(docs: DataFrame) -> dict | None:
    """The trained net; None without labelled text."""
    x, y, langs = sample(docs)
    if not len(x):
        return None
    net = train(x, y, len(langs))
    return {"net": net, "tables": tables(net), "langs": langs}


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learnt from text and lang of the other folds.

    The prediction is the language with the largest mean probability over all windows of the text, the score that
    mean; a text that is null or has no letter is ``und`` with 0.0, and so is every text where no labels were learnt.
    Rows without an id are predicted, not learnt from.
    """
    fold = sh.remainder("doc_id", folds)
    model = fit(docs.filter(fold != held).select("doc_id", "text", "lang"))
    return sh.annotate(docs, ["doc_id"], "lang_pred string, score double", predictor(model)).select(
        "doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
