"""Operator 5: personal data by fixed patterns and by a linear-chain conditional random field.

The patterns give the base spans. The field labels tokens (pieces between blanks) with the kinds of personal data
from features of their shape and of their neighbours; it is trained in numpy by gradient steps on a small labelled
table and adds spans that no pattern overlaps. A token without a digit and without "@" can only be outside, so the chain
falls apart into runs of the other tokens, which are decoded by Viterbi in batches of one length; that is the decoding
of the whole text, not a cut.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

KINDS = ("email", "ip", "card", "phone")
SPANS = "spans__ array<struct<kind:string,start:long,end:long,base:boolean>>"
#: Fixed patterns of the base spans, in parts that are each matched in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
CALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the matches that pass their checks, kind by kind, leftmost and without overlap."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((start, stop, "ip"))
            start = stop + 1
    for m in GROUPED.finditer(text):
        if len(m[0]) >= 14:
            digits = "".join(DIGITS.findall(m[0]))
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    for m in CALLED.finditer(text):
        if 10 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


LABELS = ("O", *KINDS)
SLOTS = 1 << 12
TRIM = re.compile(r"^[^\w+(@]+|[^\w)]+$")

#: The small labelled table: contexts, and written forms of each kind and of what is none of them.
CONTEXTS = ("call {} today", "write to {} now", "the {} is", "{}", "see {}, then", "my {} and", "from {} .", "no {} here", "Tel: {}", "at ({})", "of {} in the")
FORMS = {
    "email": ("a.b@c.org", "info@site.example", "x_y@mail.co.uk", "<joe@host.net>", "mailto:ann@post.de", "k.l@m.example.com"),
    "ip": ("10.0.0.1", "192.168.10.254", "8.8.4.4:53", "172.16.0.9/24"),
    "card": ("4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "3400 0000 0000 009", "6011 0009 9013 9424"),
    "phone": ("+1 (212) 555-0147", "(212) 555-0147", "212-555-0147", "+44 20 7946 0958", "+49 30 901820", "(030) 901-8204"),
    "O": ("1999", "3.", "4.0.", "2.0", "12:30", "2024-05-17", "17/05/2024", "$1,200.50", "3.14", "100%", "v1.2.3", "AKIA4V4CCVJY3MVY", "password=a9f3c1", "12345",
          "1,000,000", "10-12", "e36f61096dd9d67e69e7", "\"0641917ea4e9\"", "2nd", "B52", "1 2 3 4", "§12", "978-3-16-148410-0", "007", "20 30 40", "@home", "a@b", "12", "5 000", "no.5"),
}


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """Token lists with their labels."""
    rows = []
    for kind, forms in FORMS.items():
        for i, form in enumerate(forms):
            for shift in (0, 1, 2, 3):
                digit = lambda m, s=shift: str((int(m[0]) + s) % 10)
                written = DIGITS.sub(digit, form) if shift else form
                for context in CONTEXTS[(i + shift) % 2 :: 2]:
                    before, after = context.split("{}")
                    inner = (before.split(" ")[-1] + written + after.split(" ")[0]).split()
                    left, right = before.split(" ")[:-1], after.split(" ")[1:]
                    tokens = [x for x in (*left, *inner, *right) if x]
                    n = sum(bool(x) for x in left)
                    rows.append((tokens, ["O"] * n + [kind] * len(inner) + ["O"] * (len(tokens) - n - len(inner))))
    return rows


def open_token(token: str) -> bool:
    return "@" in token or any("0" <= c <= "9" for c in token)


def shape(token: str) -> str:
    """Digits as 9 with their counts, letters as a, the rest as it is."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", token[:40], re.DOTALL):
        c = m[0][0]
        out.append(f"9{min(len(m[0]), 9)}" if "0" <= c <= "9" else "a" if c.isalpha() else c)
    return "".join(out)


def features(before: str, token: str, after: str) -> list[int]:
    core = TRIM.sub("", token) or token
    n = len(DIGITS.findall(token))
    names = ("bias", "s=" + shape(core), "raw=" + shape(token), f"n={min(n, 20)}", f"share={10 * n // max(len(core), 1)}", f"dots={min(core.count('.'), 4)}",
             f"dash={min(core.count('-'), 4)}", "plus=" + token[:1], f"at={'@' in core}", f"mail={bool(re.search('[^@]@[^@]+[.][^@]', core))}", f"letters={any(c.isalpha() for c in core)}",
             "b=" + shape(before), "a=" + shape(after), f"open={open_token(before)}{open_token(after)}")
    return [zlib.crc32(x.encode()) % SLOTS for x in names]


def runs_of(tokens: list[str]) -> list[tuple[int, int]]:
    """[start, end) of each run of tokens that may be personal data."""
    out, start = [], None
    for i, token in enumerate([*tokens, ""]):
        if open_token(token):
            start = i if start is None else start
        elif start is not None:
            out.append((start, i))
            start = None
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@functools.cache
def field() -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights, trained on the labelled table by full gradient steps."""
    by_length: dict[int, list] = {}
    for tokens, labels in labelled_table():
        padded = ["", *tokens, ""]
        for i, j in runs_of(tokens):
            f = [features(padded[t], padded[t + 1], padded[t + 2]) for t in range(i, j)]
            by_length.setdefault(j - i, []).append((f, [LABELS.index(x) for x in labels[i:j]]))
    batches = [(np.array([f for f, _ in rows]), np.array([y for _, y in rows])) for rows in by_length.values()]
    k = len(LABELS)
    emit, move = np.zeros((SLOTS, k)), np.zeros((k, k))
    total = sum(len(f) for f, _ in batches)
    speed = [np.zeros_like(emit), np.zeros_like(move)]
    for _ in range(200):
        g_emit, g_move = 1e-4 * emit * total, 1e-4 * move * total
        for f, y in batches:
            n, length = y.shape
            e = emit[f].sum(2)
            alpha, beta = [move[0] + e[:, 0]], [np.broadcast_to(move[:, 0], (n, k))]
            for t in range(1, length):
                alpha.append(e[:, t] + log_sum(alpha[-1][:, :, None] + move, 1))
                beta.append(log_sum(move + (e[:, length - t] + beta[-1])[:, None, :], 2))
            beta = beta[::-1]
            z = log_sum(alpha[-1] + move[:, 0], 1)
            for t in range(length):
                d = np.exp(alpha[t] + beta[t] - z[:, None])
                if t == 0:
                    g_move[0] += d.sum(0)
                    np.add.at(g_move[0], y[:, 0], -1)
                else:
                    pair = np.exp(alpha[t - 1][:, :, None] + move + (e[:, t] + beta[t])[:, None, :] - z[:, None, None])
                    g_move += pair.sum(0)
                    np.add.at(g_move, (y[:, t - 1], y[:, t]), -1)
                if t == length - 1:
                    g_move[:, 0] += d.sum(0)
                    np.add.at(g_move[:, 0], y[:, t], -1)
                d[np.arange(n), y[:, t]] -= 1
                np.add.at(g_emit, f[:, t].ravel(), np.repeat(d, f.shape[2], axis=0))
        for w, g, s in ((emit, g_emit, speed[0]), (move, g_move, speed[1])):
            s *= 0.9
            s += g / total
            w -= 0.3 * s
    return emit, move


def decode(model: tuple[np.ndarray, np.ndarray], sequences: list[list[list[int]]]) -> list[list[int]]:
    """Best labels of each run (outside before and after it), batched by length."""
    emit, move = model
    out: list[list[int]] = [[]] * len(sequences)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        by_length.setdefault(len(s), []).append(i)
    for length, rows in by_length.items():
        for a in range(0, len(rows), max(1, 200_000 // length)):
            part = rows[a : a + max(1, 200_000 // length)]
            e = emit[np.array([sequences[i] for i in part])].sum(2)
            best, back = move[0] + e[:, 0], []
            for t in range(1, length):
                step = best[:, :, None] + move
                back.append(step.argmax(1))
                best = step.max(1) + e[:, t]
            path = [(best + move[:, 0]).argmax(1)]
            for b in reversed(back):
                path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
            for i, labels in zip(part, np.stack(path[::-1], 1).tolist(), strict=True):
                out[i] = labels
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether a labelled run can be what it is labelled as at all."""
    n = len(DIGITS.findall(text))
    if kind == "email":
        return bool(re.search(r"[^@\s]@[^@\s]+\.[^@\s]", text))
    if kind == "ip":
        return bool(re.fullmatch(r"\D*\d{1,3}(\.\d{1,3}){3}([:/]\d+)?\D*", text))
    return 13 <= n <= 19 and luhn("".join(DIGITS.findall(text))) if kind == "card" else 9 <= n <= 15 and not any(c.isalpha() for c in text)


def finder():
    model = field()

    def make(data, at):
        n = len(at) - 1
        texts = [data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(n)]
        begin = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        whole = "\n".join(texts)
        base = base_spans(whole)
        starts, ends, row = sh.words(data, at, ~sh.SPACE)
        marks = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data == 0x40) | ((data >= 0x30) & (data <= 0x39)), out=marks[1:])
        may = np.flatnonzero(marks[ends] > marks[starts])
        codes = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=codes[1:])
        token = lambda i, r: data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") if 0 <= i < len(row) and row[i] == r else ""
        new = np.ones(len(may), bool)
        new[1:] = (may[1:] != may[:-1] + 1) | (row[may][1:] != row[may][:-1])
        cuts = np.append(np.flatnonzero(new), len(may))
        sequences = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            r = row[may[i]]
            t = [token(k, r) for k in range(may[i] - 1, may[j - 1] + 2)]
            sequences.append([features(*t[k : k + 3]) for k in range(j - i)])
        taken = np.zeros(len(whole) + 1, np.int8)
        for s, e, _ in base:
            taken[s] += 1
            taken[e] -= 1
        taken = np.concatenate([[0], np.cumsum(np.cumsum(taken) > 0)])
        added = []
        for i, labels in zip(cuts[:-1], decode(model, sequences), strict=True):
            t = 0
            while t < len(labels):
                u = t + 1
                while u < len(labels) and labels[u] == labels[t]:
                    u += 1
                if labels[t]:
                    first, last, r = may[i + t], may[i + u - 1], row[may[i]]
                    shift = begin[r] - codes[at[r]]
                    s, e = int(codes[starts[first]] + shift), int(codes[ends[last]] + shift)
                    raw = whole[s:e]
                    left = len(raw) - len(raw.lstrip("\"'<[{,;:."))
                    core = raw.strip("\"'<>[]{},;:.!?|#$%&*")
                    s, e = s + left if core else s, s + left + len(core)
                    if core and plausible(LABELS[labels[t]], core) and taken[e] == taken[s]:
                        added.append((s, e, LABELS[labels[t]]))
                t = u
        spans = [(s, KINDS.index(k), e, True) for s, e, k in base] + [(s, KINDS.index(k), e, False) for s, e, k in added]
        spans.sort()
        where = np.searchsorted(begin, [s[0] for s in spans], side="right") - 1 if spans else np.zeros(0, int)
        counts = np.append(0, np.cumsum(np.bincount(where, minlength=n)[:n]))
        made = pa.StructArray.from_arrays(
            [pa.array([KINDS[s[1]] for s in spans], pa.string()), pa.array([s[0] - begin[w] for s, w in zip(spans, where, strict=True)], pa.int64()),
             pa.array([s[2] - begin[w] for s, w in zip(spans, where, strict=True)], pa.int64()), pa.array([s[3] for s in spans], pa.bool_())],
            ["kind", "start", "end", "base"],
        )
        return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), made)]

    return make


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of each document and spans__: kind, start and end in code points, found by a pattern or not.

    Spans stand in the order of start and kind; added spans never overlap base ones. Null and empty texts have none.
    Rows without an id and repeated rows are searched like all others.
    """
    return sh.annotate(docs, keep, SPANS, finder)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans__", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told("spans__").alias("spans"))


def mask(found: DataFrame, columns: list[str]) -> DataFrame:
    """The documents, all columns, with each span of personal data in the text replaced by its kind in brackets.

    Where base spans of two kinds overlap, the one that starts first (of two, the first kind) is replaced and the rest
    of the other is cut with it.
    """
    piece = lambda a, s: F.struct(F.concat(a["text"], F.when(s["start"] >= a["at"], F.concat(F.substring("text", a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))).alias("text"),
                                  F.greatest(a["at"], s["end"]).alias("at"))
    done = F.aggregate("spans__", F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")), piece, lambda a: F.concat(a["text"], F.substring("text", a["at"].cast("int") + 1, F.length("text"))))
    masked = F.when(F.size("spans__") > 0, done).otherwise(F.col("text"))
    return found.select(*[masked.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])
