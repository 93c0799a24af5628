"""Operator 1: removes every byte covered by a 50-byte string that also starts in a document with a smaller id.

Prefix-free parsing over a cluster. A rolling hash of ``TRIGGER`` bytes sets the triggers: the smallest hash among
the trigger positions of a 50-byte string is its trigger, so each string owns exactly one, equal strings own equal
ones, and triggers cut every document into phrases of at most ``SPAN`` fresh bytes.

1. Each chunk of documents sends the distinct triggers it has, dealt by hash, and how many different surroundings each
   has there. A trigger that stands in one document only can't start a repeat; the rest, the dictionary of repeated
   triggers, goes back as one bit each, and a second one for hot triggers.
2. Each chunk cuts the phrases on both sides of its repeated triggers and sends each distinct pair once, with the
   smallest document that has it. All pairs with one trigger meet in one group, but for hot triggers: those with more
   than ``HOT`` pairs and more than two a chunk. Their phrases are taken apart into the single 50-byte strings before
   they are sent, and the sub-key of a string is its hash, so that only strings that can be equal meet.
3. There, a suffix array of the dictionary (phrases before a trigger, read backwards from it) and one of the parse
   (what follows the trigger) are made with their common-prefix lengths. A 50-byte string that starts l bytes before
   its trigger is a class of the first (agreeing in l bytes) with a class of the second (agreeing in the rest): the two
   orders combine to the order of all strings without their being spelled out. The smallest document of each class is
   its first home; the strings of all others are hits.
4. Hits return to the chunks, which cut the bytes out.

So copies of a text, and a passage in ever different surroundings too, cost a group at most about two entries a chunk
and trigger; only repeats inside the one document that is the smallest of its chunk come on top. Buckets are
``BUCKET_CHUNKS`` times as large as chunks, so that a chunk sends fewer, larger pieces. Documents are dealt once and that
exchange is reused by all passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

LENGTH = 50
TRIGGER = 24
SPAN = LENGTH - TRIGGER + 1
SIDE = SPAN - 1
SLICE = 1 << 17
HOT = 4096
BUCKET_CHUNKS = 4
#: Low bits of a sent trigger: the number of its surroundings in the chunk as a power of two, and the bit for two documents.
LEVELS = 4
STEPS = sh.splitmix(5, 3) | np.uint64(1)
PLACES = sh.splitmix(LENGTH, 6) | np.uint64(1)
PARTS = "bucket int, chunk int, data binary"


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the TRIGGER bytes from each position, built up from halves."""
    with np.errstate(over="ignore"):
        h = sh.BYTE_KEYS[data]
        h = h[:-1] * STEPS[0] + h[1:]
        h = h[:-2] * STEPS[1] + h[2:]
        h8 = h[:-4] * STEPS[2] + h[4:]
        h = h8[:-8] * STEPS[3] + h8[8:]
        return sh.mixed(h[:-8] * STEPS[4] + h8[16:])


def slide(a: np.ndarray, fn) -> np.ndarray:
    """fn over each run of SPAN neighbours."""
    width = 1
    while width * 2 <= SPAN:
        a = fn(a[:-width], a[width:])
        width *= 2
    rest = SPAN - width
    return fn(a[:-rest], a[rest:]) if rest else a


def triggers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, first, last, hash): each trigger with the first and last start of the strings it owns.

    A trigger at the border of two slices may come twice, each time with other strings.
    """
    found = []
    size = np.diff(at)
    fits = size >= LENGTH
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, at[:-1][fits], 1)
    np.add.at(change, at[1:][fits] - LENGTH + 1, -1)
    valid = np.cumsum(change[:-1], dtype=np.int8) > 0
    for a in range(0, len(data) - LENGTH + 1, SLICE):
        b = min(a + SLICE, len(data) - LENGTH + 1)
        starts = np.flatnonzero(valid[a:b])
        if not starts.size:
            continue
        h = rolling(data[a : b + LENGTH - 1])
        low = slide(h, np.minimum)
        most = slide(np.concatenate([np.zeros(SIDE, np.uint64), low, np.zeros(SIDE, np.uint64)]), np.maximum)
        chosen = h == most
        at_chosen = np.flatnonzero(chosen)
        hashes = h[at_chosen]
        k = (np.cumsum(chosen) - chosen)[starts]
        wanted = low[starts]
        off = np.flatnonzero(hashes[k] != wanted)
        while off.size:
            k[off] += 1
            off = off[hashes[k[off]] != wanted[off]]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (starts[1:] != starts[:-1] + 1)
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(k)) - 1
        found.append((at_chosen[k[i]] + a, starts[i] + a, starts[j] + a, hashes[k[i]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def dictionary(hashes: np.ndarray, docs: np.ndarray, buckets: int):
    """Distinct triggers in the order of (bucket, hash): hash, bucket, in two documents or more, index of each input."""
    uniq, inverse = np.unique(hashes, return_inverse=True)
    low, high = np.full(len(uniq), np.iinfo(np.int64).max), np.full(len(uniq), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, docs)
    np.maximum.at(high, inverse, docs)
    bucket = (uniq >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return uniq[order], bucket[order].astype(np.int32), (low != high)[order], back[inverse]


def surroundings(data: np.ndarray, first: np.ndarray, last: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Number of each trigger's different stretches of owned bytes, told apart by sums of byte keys; only the split of hot
    triggers rests on it."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(sh.BYTE_KEYS[data], out=sums[1:])
    around = sums[last + LENGTH] - sums[first]
    order = np.lexsort((around, which))
    around, which = around[order], which[order]
    new = np.append(True, (around[1:] != around[:-1]) | (which[1:] != which[:-1]))
    return np.bincount(which[new], minlength=n)


def cuts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start, and the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int), len(keys))


def empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


def parts(bucket: np.ndarray, chunk: int, data: pa.Array) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array(np.full(len(bucket), chunk), pa.int32()), "data": data})


def send_triggers(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        table = sh.ordered(table)
        data, at = sh.packed(table.column("text"))
        pos, first, last, hashes = triggers(data, at)
        if not len(pos):
            return empty(PARTS)
        docs = sh.ids_of(table)[np.searchsorted(at, pos, side="right") - 1]
        uniq, bucket, twice, which = dictionary(hashes, docs, buckets)
        cuts = cuts_of(bucket)
        level = np.ceil(np.log2(surroundings(data, first, last, which, len(uniq)))).clip(0, (1 << LEVELS) - 1).astype(np.uint64)
        low = np.uint64(LEVELS + 1)
        marked = (uniq >> low << low) | level << np.uint64(1) | twice.astype(np.uint64)
        return parts(bucket[cuts[:-1]], chunk, sh.blobs(marked, cuts))

    return run


def repeated(most: int):
    """One bit for each trigger sent: does it stand in two documents or more? Where any is hot, one more bit for each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        data, at = sh.packed(table.column("data"))
        marked = data.view(np.uint64)
        value = marked >> np.uint64(LEVELS + 1)
        order = np.argsort(value)
        cuts = cuts_of(value[order])
        chunks = np.diff(cuts)
        many = (chunks > 1) | (np.maximum.reduceat((marked & np.uint64(1))[order], cuts[:-1]) > 0)
        pairs = np.add.reduceat((1 << (marked >> np.uint64(1) & np.uint64((1 << LEVELS) - 1)).astype(np.int64))[order], cuts[:-1])
        live, hot = np.empty(len(value), bool), np.empty(len(value), bool)
        live[order] = np.repeat(many, chunks)
        hot[order] = np.repeat((pairs > most) & (pairs > 2 * chunks), chunks)
        bits = []
        for i, j in zip(at[:-1] // 8, at[1:] // 8, strict=True):
            bits.append(np.packbits(live[i:j]).tobytes() + (np.packbits(hot[i:j]).tobytes() if hot[i:j].any() else b""))
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "data": pa.array(bits, pa.binary())})

    return run


#: A phrase pair: where it stands in its chunk, first and last string start before the trigger, document, bytes around it.
PAIR = np.dtype([("pos", "<i8"), ("far", "u1"), ("near", "u1"), ("doc", "<i8"), ("around", "u1", (SIDE + LENGTH,))])
CODEC = pa.Codec("zstd", compression_level=1)
COLUMN = np.arange(SIDE + LENGTH)


def inside(far: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which of the bytes around a trigger belong to strings that it owns."""
    return (COLUMN >= (SIDE - far.astype(int))[:, None]) & (COLUMN < (SIDE + LENGTH - near.astype(int))[:, None])


def pack(rows: np.ndarray) -> bytes:
    """Pairs field by field, only the bytes inside, compressed; the plain size and the count come first."""
    plain = b"".join([np.diff(rows["pos"], prepend=0).tobytes(), np.diff(rows["doc"], prepend=0).tobytes(), rows["far"].tobytes(), rows["near"].tobytes(),
                      rows["around"][inside(rows["far"], rows["near"])].tobytes()])
    return np.array([len(plain), len(rows)], "<i4").tobytes() + CODEC.compress(plain, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    size, n = np.frombuffer(blob, "<i4", 2).tolist()
    plain = CODEC.decompress(blob[8:], size, asbytes=True)
    rows = np.zeros(n, PAIR)
    rows["pos"], rows["doc"] = (np.cumsum(np.frombuffer(plain, "<i8", n, at)) for at in (0, 8 * n))
    rows["far"], rows["near"] = np.frombuffer(plain, "u1", n, 16 * n), np.frombuffer(plain, "u1", n, 17 * n)
    rows["around"][inside(rows["far"], rows["near"])] = np.frombuffer(plain, "u1", offset=18 * n)
    return rows


def intervals(starts: np.ndarray) -> np.ndarray:
    """Byte ranges covered by the strings at these starts, as (from, to) pairs."""
    starts = np.unique(starts)
    if not starts.size:
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + 1)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + LENGTH], 1)


def single_strings(data: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """The strings that start from first to last: index of the pair, start, and the bucket that their bytes name."""
    spread = last - first + 1
    pair = np.repeat(np.arange(len(first)), spread)
    start = first[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(spread) - spread, spread)
    windows = sliding_window_view(data, LENGTH)
    to = np.empty(len(start), np.int32)
    with np.errstate(over="ignore"):
        for a in range(0, len(start), SLICE // 2):
            keys = sh.BYTE_KEYS[windows[start[a : a + SLICE // 2]]]
            to[a : a + SLICE // 2] = (sh.mixed((keys * PLACES).sum(1)) >> np.uint64(20)) % np.uint64(buckets)
    return pair, start, to


def send_phrases(buckets: int):
    def run(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows or not bits.num_rows:
            return empty("kind int, " + PARTS)
        chunk = table.column("chunk")[0].as_py()
        table = sh.ordered(table)
        data, at = sh.packed(table.column("text"))
        pos, first, last, hashes = triggers(data, at)
        docs = sh.ids_of(table)[np.searchsorted(at, pos, side="right") - 1]
        uniq, bucket, _, which = dictionary(hashes, docs, buckets)
        live, hot = np.zeros(len(uniq), bool), np.zeros(len(uniq), bool)
        cuts = cuts_of(bucket)
        place = dict(zip(bucket[cuts[:-1]].tolist(), zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), strict=True))
        for b, raw in zip(bits.column("bucket").to_pylist(), bits.column("data").to_pylist(), strict=True):
            i, j = place[b]
            half = (j - i + 7) // 8
            live[i:j] = np.unpackbits(np.frombuffer(raw, np.uint8, half), count=j - i)
            if len(raw) > half:
                hot[i:j] = np.unpackbits(np.frombuffer(raw, np.uint8, offset=half), count=j - i)
        keep = np.flatnonzero(live[which])
        if not keep.size:
            return empty("kind int, " + PARTS)
        split = hot[which[keep]]
        pos, first, last, docs, to = pos[keep], first[keep], last[keep], docs[keep], bucket[which[keep]]
        if split.any():
            pair, start, dealt = single_strings(data, first[split], last[split], buckets)
            pos, docs = (np.concatenate([x[~split], x[split][pair]]) for x in (pos, docs))
            first, last, to = np.append(first[~split], start), np.append(last[~split], start), np.append(to[~split], dealt)
            order = np.argsort(pos, kind="stable")
            pos, first, last, docs, to = pos[order], first[order], last[order], docs[order], to[order]
        row = np.zeros(len(pos), PAIR)
        row["pos"], row["far"], row["near"], row["doc"] = pos, pos - first, pos - last, docs
        padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        around = sliding_window_view(padded, SIDE + LENGTH)[pos]
        row["around"] = np.where(inside(row["far"], row["near"]), around, np.uint8(0))
        key = np.concatenate([row["around"], row["far"][:, None], row["near"][:, None]], 1)
        _, same = np.unique(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), return_inverse=True)
        home = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(home, same, docs)
        ours = docs == home[same]
        later = np.flatnonzero(~ours)
        spread = (last - first + 1)[later]
        starts = np.repeat(first[later], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        local = intervals(starts)
        row, to = row[ours], to[ours]
        order = np.argsort(to, kind="stable")
        row, to = row[order], to[order]
        cuts = cuts_of(to)
        sent = pa.array([pack(row[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        out = [parts(to[cuts[:-1]], chunk, sent).add_column(0, "kind", pa.array(np.zeros(len(cuts) - 1), pa.int32()))]
        if len(local):
            out.append(parts(np.array([chunk % buckets]), chunk, pa.array([local.tobytes()], pa.binary())).add_column(0, "kind", pa.array([1], pa.int32())))
        return pa.concat_tables(out)

    return run


def agreeing(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows and how many bytes each agrees in with the one before it (the first: none)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel())
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if len(s) > 1 else np.zeros(0, int)
    return order, np.append(-1, common)


def first_homes(rows: np.ndarray) -> list[np.ndarray]:
    """(index, start) of the strings whose class has a smaller document: the two suffix arrays combined."""
    around, doc = rows["around"], rows["doc"]
    trigger, before, after = around[:, SIDE : SIDE + TRIGGER], around[:, :SIDE][:, ::-1], around[:, SIDE + TRIGGER :]
    order1, common1 = agreeing(np.concatenate([trigger, before], 1))
    order2, common2 = agreeing(np.concatenate([trigger, after], 1))
    n, hits = len(rows), []
    class1, class2 = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(SPAN):
        own = np.flatnonzero((rows["far"] >= back) & (rows["near"] <= back))
        if len(own) < 2:
            continue
        class1[order1] = np.cumsum(common1 < TRIGGER + back)
        class2[order2] = np.cumsum(common2 < TRIGGER + SIDE - back)
        key = class1[own] * (n + 1) + class2[own]
        order = np.argsort(key)
        cuts = cuts_of(key[order])
        home = np.minimum.reduceat(doc[own][order], cuts[:-1])
        late = own[order][doc[own][order] > np.repeat(home, np.diff(cuts))]
        hits.append(np.stack([late, rows["pos"][late] - back]))
    return hits


def combine(table: pa.Table) -> pa.Table:
    kind = table.column("kind").to_numpy()
    out = [table.filter(pa.array(kind == 1)).select(["chunk", "data"])]
    pairs = table.filter(pa.array(kind == 0))
    if pairs.num_rows:
        got = [unpack(x) for x in pairs.column("data").to_pylist()]
        rows = np.concatenate(got)
        chunk = np.repeat(pairs.column("chunk").to_numpy(), [len(x) for x in got])
        if hits := first_homes(rows):
            who, start = np.concatenate(hits, 1)
            order = np.argsort(chunk[who], kind="stable")
            who, start = chunk[who][order], start[order]
            cuts = cuts_of(who)
            back = [intervals(start[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            out.append(pa.table({"chunk": pa.array(who[cuts[:-1]], pa.int32()), "data": pa.array(back, pa.binary())}))
    return pa.concat_tables(out)


def cut_out(table: pa.Table, hits: pa.Table) -> pa.Table:
    """What is left of each document, and the removed byte ranges."""
    table = sh.ordered(table)
    data, at = sh.packed(table.column("text"))
    got = [np.frombuffer(x, np.int64) for x in hits.column("data").to_pylist()] if hits.num_rows else []
    change = np.zeros(len(data) + 1, np.int32)
    if got:
        pairs = np.concatenate(got).reshape(-1, 2)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    starts, ends, row = sh.words(gone.view(np.uint8), at, np.array([False, True] + [False] * 254))
    left = np.concatenate([[0], np.cumsum(~gone)])
    spans = pa.StructArray.from_arrays([pa.array(starts - at[row], pa.int64()), pa.array(ends - at[row], pa.int64())], ["start", "end"])
    counts = np.append(0, np.cumsum(np.bincount(row, minlength=table.num_rows)))
    return pa.table({
        "doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(at)), "spans": pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans),
        "kept": sh.blobs(data[~gone], left[at]),
    })


def remove_repeats(docs: DataFrame, chunk_bytes: int = sh.CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte ranges [start, end) of each text and the bytes that stay.

    A trigger with more than ``hot`` phrase pairs is split; results don't depend on it. Only columns doc_id and text count. A null or empty text and one of under 50 bytes have no spans; rows without an
    id are left out; rows with one and the same id don't remove bytes from each other; of two equal texts the one with
    the smaller id stays whole.
    """
    chunks = sh.chunk_count(docs, chunk_bytes)
    parts_ = sh.chunked(docs, chunks)
    by_chunk = lambda: parts_.groupBy("chunk")
    buckets = -(-chunks // BUCKET_CHUNKS)
    bits = by_chunk().applyInArrow(send_triggers(buckets), PARTS).groupBy("bucket").applyInArrow(repeated(hot), PARTS)
    phrases = by_chunk().cogroup(bits.groupBy("chunk")).applyInArrow(send_phrases(buckets), "kind int, " + PARTS)
    hits = phrases.groupBy("bucket").applyInArrow(combine, "chunk int, data binary")
    return by_chunk().cogroup(hits.groupBy("chunk")).applyInArrow(
        cut_out, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def digest(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
