"""Operator 13: fill-in-the-middle transformation with cuts found in Fenwick trees over text blocks.

A text is cut into units (a word with the white space before it, or the white space at the end). Each text is laid out in
blocks of ``BLOCK`` bytes; two Fenwick trees hold the number of units that end in a block and of code points that start in
it. A cut after k units is found by binary lifting: from the highest power of two down, a step is taken if the units below
stay under k, and the code points below are added up on the way. The cut lies in the block after the last step, and only
that block is looked at for the end of the unit. All texts and both cuts of a batch descend together in arrays, and the
trees of a batch lie one behind another, so the cost is linear in the bytes read. Nothing is shuffled; a task holds one
batch of texts, or one longer text.

A null or empty text has no unit and stays plain; so does a row without an id, which has nothing to draw its cuts from, and
a text that holds a marker. Repeated rows are cut alike; there are no ties. Extra columns are left out unless asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

BLOCK = 256
SEED = 42
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and so many of those have the suffix first.
RATE = 50
SPM = 80


def unit_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte whether a unit ends with it: a word's last byte, or the last byte of a text."""
    inside = ~sh.SPACE[data]
    ends = np.zeros(data.size, bool)
    ends[:-1] = inside[:-1] & ~inside[1:]
    last = at[1:][at[1:] > at[:-1]] - 1
    first = at[:-1][at[1:] > at[:-1]]
    ends[first[first > 0] - 1] = True
    ends[last] = True
    return ends


def fenwick(values: np.ndarray, begin: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """One Fenwick tree per text, one behind another: entry i (from 1) of a text sums the last lowbit(i) blocks up to i."""
    sums = np.zeros(values.size + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    i = np.arange(values.size) - np.repeat(begin, blocks) + 1
    here = np.arange(1, values.size + 1)
    return sums[here] - sums[here - (i & -i)]


def descend(units: np.ndarray, points: np.ndarray, begin: np.ndarray, blocks: np.ndarray, wanted: np.ndarray):
    """Blocks wholly before the ``wanted``-th unit of each text, and the units and code points in them."""
    skipped, left, before = np.zeros_like(wanted), wanted.copy(), np.zeros_like(wanted)
    for bit in range(int(blocks.max(initial=1)).bit_length() - 1, -1, -1):
        step = skipped + (1 << bit)
        at = np.minimum(begin + step - 1, max(units.size - 1, 0))
        go = (step <= blocks) & (units[at] < left)
        skipped = np.where(go, step, skipped)
        left -= np.where(go, units[at], 0)
        before += np.where(go, points[at], 0)
    return skipped, left, before


class Cutter:
    """The texts of a batch with their trees; ``cut(row, k)`` gives byte and code-point positions after k units."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.at, length = at, np.diff(at)
        self.ends, self.starts = unit_ends(data, at), (data & 0xC0) != 0x80
        self.blocks = -(-length // BLOCK)
        self.begin = np.cumsum(self.blocks) - self.blocks
        row = np.repeat(np.arange(len(length)), self.blocks)
        edge = at[:-1][row] + (np.arange(row.size) - self.begin[row]) * BLOCK
        total = lambda on: np.add.reduceat(on.astype(np.int64), edge) if edge.size else np.zeros(0, np.int64)
        units, points = total(self.ends), total(self.starts)
        self.n = np.bincount(row, units, len(length)).astype(np.int64)
        self.units, self.points = fenwick(units, self.begin, self.blocks), fenwick(points, self.begin, self.blocks)

    def cut(self, row: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        byte, point = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        real = np.flatnonzero(k > 0)
        row, k = row[real], k[real].astype(np.int64)
        skipped, left, before = descend(self.units, self.points, self.begin[row], self.blocks[row], k)
        head = self.at[row] + skipped * BLOCK
        seen = head[:, None] + np.arange(BLOCK)
        inside = seen < self.at[row + 1][:, None]
        seen = np.minimum(seen, max(self.ends.size - 1, 0))
        where = np.argmax(np.cumsum(self.ends[seen] & inside, axis=1) == left[:, None], axis=1) if len(row) else left
        byte[real] = head + where + 1 - self.at[row]
        point[real] = before + (self.starts[seen] & (np.arange(BLOCK) <= where[:, None])).sum(1)
        return byte, point


def draws(seed: int) -> list[Column]:
    """The first four 32-bit numbers of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}__") for i in range(4)]


def rearranged(text: pa.Array, spm: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """Marked parts of each text, cut at the given bytes."""
    raw = text.cast(pa.large_binary())
    out = []
    for value, suffix_first, a, b in zip(raw, spm, low, high):
        t = value.as_py()
        p, m, s = (MARKS[0].encode(), t[:a]), (MARKS[2].encode(), t[a:b]), (MARKS[1].encode(), t[b:])
        out.append(b"".join(x for part in ((s, p, m) if suffix_first else (p, s, m)) for x in part))
    return pa.array(out, pa.binary())


def transform(docs: DataFrame, keep: list[str], seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``keep`` columns and n, form, prefix_chars, middle_chars and output of every row."""
    sh.ship(docs.sparkSession)
    extra = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in keep if c not in extra]
    source = docs.select(*[f"`{c}`" for c in keep], *draws(seed), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text__"))
    kept = docs.select(*[f"`{c}`" for c in keep]).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n long, form string, prefix_chars long, middle_chars long, output string"])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.num_columns - 1)
        data, at = sh.packed(text)
        cutter = Cutter(data, at)
        h = [batch.column(batch.num_columns - 5 + i) for i in range(4)]
        marked = pc.or_(pc.or_(*[pc.match_substring(text, m) for m in MARKS[:2]]), pc.match_substring(text, MARKS[2])).to_numpy(zero_copy_only=False)
        known = pc.is_valid(h[0]).to_numpy(zero_copy_only=False)
        h = [x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in h]
        plain = ~known | marked | (cutter.n == 0) | (h[2] % 100 >= rate)
        row = np.flatnonzero(~plain)
        ks = np.sort(np.stack([h[0][row], h[1][row]]) % (cutter.n[row] + 1), axis=0)
        (low, first), (high, second) = cutter.cut(row, ks[0]), cutter.cut(row, ks[1])
        suffix_first = h[3] % 100 < spm
        made = rearranged(text.take(pa.array(row)), suffix_first[row], low, high)
        place = np.zeros(len(plain), np.int64)
        place[row] = np.arange(len(row))
        picked = made.take(pa.array(place, mask=plain)).cast(pa.string())
        numbers = [pa.array(x[place] if len(row) else place, mask=plain) for x in (first, second - first)]
        form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(keep)], pa.array(cutter.n), pa.array(form.tolist(), pa.string()), *numbers, pc.coalesce(picked, text.cast(pa.string()))],
            names=[*keep, *extra])

    def run(batches):
        for batch in batches:
            _, at = sh.packed(batch.column(batch.num_columns - 1))
            for i, j in sh.pieces(at):
                yield one(batch.slice(i, j - i))

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of an output. No marker stands in a part, and none can arise where a part meets a marker."""
    parts = F.split(output, f"<[{''.join(m[1] for m in MARKS)}]>", -1)
    at = lambda i: F.get(parts, i)
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
