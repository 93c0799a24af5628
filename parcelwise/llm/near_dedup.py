"""Operator 4: near-duplicates by one-permutation MinHash.

1. Each text gives its set of word shingles, a digest of the set and a one-permutation signature: one hash per shingle,
   the smallest in each of ``BINS`` bins, empty bins filled by optimal densification (each empty bin draws other bins by
   a hash of its own until it meets a filled one). Bands of ``ROWS`` bins are the bucket keys. No shuffle.
2. Equal sets are one node, so copies cost one row each and no pairs.
3. In each bucket with several nodes, edges go from a centre, first the smallest id, to the members that are not yet in
   its component: a star. Edges are confirmed on the full sets, the confirmed ones joined to components. Buckets that are
   then one component are done. Of the others the centre leaves, and GROWTH times as many centres are taken, drawn by a
   hash, until no members are left. So any two nodes of a bucket have been compared or are connected: no link between
   bucket mates is lost, and only nodes that stay apart are compared again. Edges are never rows of their own: a centre
   meets the members of a bucket block by block, one list for each chunk of documents.
4. Components go back to the documents through the digests.

The chance that two sets at the least similarity of 0.85 (0.8) share no bucket is (1 - 0.85^4)^32 = 6e-11 (5e-8).
Hot buckets are met by pre-aggregation and joins that can be split, without windows over a bucket; a centre's set is sent
once to each chunk of documents that has members of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
GROWTH = 8
CHUNK = 4 << 20
DRAW = 1 << 40
MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int64())]))
WORD_KEYS = sh.splitmix(64, 21) | np.uint64(1)
DRAWS = (sh.splitmix(BINS * 64, 22) % np.uint64(BINS)).astype(np.int64).reshape(64, BINS)
BAND_KEYS = sh.splitmix(BANDS, 23)


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted; a text of fewer words has all of them as one."""
    data = sh.LOWER[data]
    starts, ends, row = sh.words(data, at, ~sh.SPACE)
    hashes = sh.word_hashes(data, starts, ends)
    words = np.bincount(row, minlength=len(at) - 1)
    left = np.cumsum(words)[row] - np.arange(len(row))
    first = left == words[row]
    with np.errstate(over="ignore"):
        padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
        h = np.zeros(len(row), np.uint64)
        for i in range(size):
            h = h * WORD_KEYS[0] + np.where(i < left, padded[i : i + len(row)], np.uint64(0)) * WORD_KEYS[i % 63 + 1]
        h = sh.mixed(h + np.minimum(left, size).astype(np.uint64))
    use = (left >= size) | (first & (words[row] < size))
    row, h = row[use], h[use]
    order = np.lexsort([h, row])
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def signatures(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Densified one-permutation MinHash of sorted (row, hash) pairs; rows without shingles stay zero."""
    bin_ = (h >> np.uint64(57)).astype(np.int64)
    slot = row * BINS + bin_
    new = np.ones(len(slot), bool)
    new[1:] = slot[1:] != slot[:-1]
    low, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    low[slot[new]], filled[slot[new]] = h[new], True
    low, filled = low.reshape(n, BINS), filled.reshape(n, BINS)
    out = low.copy()
    r, b = np.nonzero(~filled & filled.any(1)[:, None])
    for draws in DRAWS:
        if not r.size:
            break
        found = filled[r, draws[b]]
        out[r[found], b[found]] = low[r[found], draws[b[found]]]
        r, b = r[~found], b[~found]
    if r.size:
        out[r, b] = low[r, filled.argmax(1)[r]]
    return out


def sketch(size: int):
    def make(data, at):
        n = len(at) - 1
        row, h = shingles(data, at, size)
        count = np.bincount(row, minlength=n)
        sums = []
        with np.errstate(over="ignore"):
            for key in (1, 2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sh.mixed(h ^ WORD_KEYS[40 + key]))])
                edge = np.append(0, np.cumsum(count))
                sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            sig = signatures(row, h, n)
            band = BAND_KEYS[None, :] + np.zeros((n, 1), np.uint64)
            for i in range(ROWS):
                band = sh.mixed(band * WORD_KEYS[50] + sig[:, i::ROWS])
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(band.view(np.int64).ravel()))
        return [pa.array(count), pa.array(sums[0]), pa.array(sums[1]), bands]

    return make


def lists(column, *fields: str):
    """Offsets and flat numpy fields of a column of struct lists."""
    arr = pa.concat_arrays([c for c in column.chunks]) if column.num_chunks else pa.array([], MEMBERS)
    flat = arr.flatten()
    size = pc.fill_null(pc.list_value_length(arr), 0).to_numpy()
    return np.append(0, np.cumsum(size)), *(flat.field(f).to_numpy() for f in fields)


def confirm(size: int, percent: int):
    """Chunk of documents; sets of centres and blocks of centres and members that met -> confirmed links.

    Each centre is held once against the members it met in any block, if their labels differ and their sizes allow it.
    """

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not table.num_rows or not asked.num_rows:
            return none
        table = sh.ordered(table)
        data, at = sh.packed(table.column("text"))
        edge, sets = set_index(data, at, size)
        ids, count = sh.ids_of(table), np.diff(edge)
        kind = asked.column("kind").to_numpy()
        told, met = asked.filter(pa.array(kind == 0)), asked.filter(pa.array(kind == 1))
        label = np.full(len(ids), -1, np.int64)
        cc, center, center_label = lists(met.column("centers"), "doc_id", "label")
        mm, member, member_label = lists(met.column("members"), "doc_id", "label")
        first, last = np.searchsorted(ids, member, "left"), np.searchsorted(ids, member, "right")
        label[first[first < last]] = member_label[first < last]
        again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
        for i in again:
            label[i] = label[i - 1]
        against: dict[int, list] = {}
        for r in range(met.num_rows):
            rows = np.unique(np.concatenate([np.arange(i, j) for i, j in zip(first[mm[r] : mm[r + 1]], last[mm[r] : mm[r + 1]], strict=True)] or [first[:0]]))
            for c in center[cc[r] : cc[r + 1]].tolist():
                against.setdefault(c, []).append(rows)
        labels = dict(zip(center.tolist(), center_label.tolist(), strict=True))
        a, b = [], []
        for c, raw in zip(told.column("center").to_pylist(), told.column("shingles").to_pylist(), strict=True):
            ours = np.frombuffer(raw, np.uint64)
            rows = np.unique(np.concatenate(against.get(c) or [first[:0]]))
            fits = 100 * np.minimum(count[rows], len(ours)) >= percent * np.maximum(count[rows], len(ours))
            rows = rows[fits & (label[rows] != labels.get(c)) & (count[rows] > 0)]
            if not rows.size:
                continue
            n = count[rows]
            theirs = sets[np.repeat(edge[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            spot = np.minimum(np.searchsorted(ours, theirs), len(ours) - 1)
            both = np.add.reduceat((ours[spot] == theirs).astype(np.int64), np.cumsum(n) - n)
            found = rows[100 * both >= percent * (len(ours) + n - both)]
            a.append(np.full(len(found), c))
            b.append(ids[found])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))}) if a else none

    return run


def set_index(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text in the back-to-back sorted sets, made a bounded stretch of texts at a time."""
    edges, sets = [np.zeros(1, np.int64)], []
    for i, j in sh.pieces(at):
        row, h = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
        edges.append(edges[-1][-1] + np.cumsum(np.bincount(row, minlength=j - i)))
        sets.append(h)
    return np.concatenate(edges), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def fetch(size: int):
    """Chunk of documents and blocks of its centres -> each centre's set, once for each chunk that it meets, and the blocks."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        n = asked.num_rows if table.num_rows else 0
        asked = asked.slice(0, n)
        cuts, centers = lists(asked.column("centers"), "doc_id")
        to = np.repeat(asked.column("to").to_numpy(), np.diff(cuts))
        wanted = np.unique(np.stack([to.astype(np.int64), centers], 1), axis=0) if len(to) else np.zeros((0, 2), np.int64)
        table = sh.ordered(table)
        table = table.filter(pc.is_in(table.column("doc_id"), pa.array(np.unique(wanted[:, 1]))))
        data, at = sh.packed(table.column("text"))
        edge, sets = set_index(data, at, size)
        ids = sh.ids_of(table)
        place = np.searchsorted(ids, wanted[:, 1])
        raw = [sets[edge[i] : edge[i + 1]].tobytes() for i in place]
        m, full = len(wanted), [i for i, x in enumerate(raw) if x]
        rows = pa.table({
            "chunk": pa.array(wanted[:, 0], pa.int32()), "kind": pa.array(np.zeros(m), pa.int32()), "center": pa.array(wanted[:, 1]), "shingles": pa.array(raw, pa.binary()),
            "centers": pa.nulls(m, MEMBERS), "members": pa.nulls(m, MEMBERS)}).take(pa.array(full, pa.int64()))
        blocks = pa.table({
            "chunk": asked.column("to"), "kind": pa.array(np.ones(n), pa.int32()), "center": pa.nulls(n, pa.int64()), "shingles": pa.nulls(n, pa.binary()),
            "centers": asked.column("centers").cast(MEMBERS), "members": asked.column("members").cast(MEMBERS)})
        return pa.concat_tables([rows, blocks])

    return run


def confirmed(texts: DataFrame, members: DataFrame, centers: DataFrame, chunks: int, size: int, percent: int) -> DataFrame:
    """Links (a, b) between centres and members (both: bucket, doc_id, label) of other labels.

    texts: (chunk, doc_id, text). Centres and members of a bucket meet as blocks, a list for each chunk, so neither
    rows nor what is sent grow with the number of pairs.
    """
    where = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")
    listed = lambda df, chunk, name: df.groupBy("bucket", where.alias(chunk)).agg(F.collect_list(F.struct("doc_id", "label")).alias(name))
    met = listed(centers, "chunk", "centers").join(listed(members, "to", "members"), "bucket")
    labels = F.array_union(F.transform("centers", lambda x: x["label"]), F.transform("members", lambda x: x["label"]))
    asked = met.filter(F.size(labels) > 1).select("chunk", "to", "centers", "members")
    pairs = "array<struct<doc_id:long,label:long>>"
    sets = texts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(
        fetch(size), f"chunk int, kind int, center long, shingles binary, centers {pairs}, members {pairs}")
    return texts.groupBy("chunk").cogroup(sets.groupBy("chunk")).applyInArrow(confirm(size, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): smallest node that each node of (a, b) links reaches. Neighbours' smallest label, then the label's
    own label, again and again until nothing changes; each turn is saved."""
    both = sh.save(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = sh.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "low").alias("next"), "label")
        jump = lower.select(F.col("node").alias("via"), F.col("next").alias("to"))
        new = sh.save(lower.join(jump, F.col("next") == F.col("via")).select("node", F.least("next", "to").alias("label"), (F.col("label") > F.least("next", "to")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.filter("moved").head(1):
            return labels


def group(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document with an id.

    A shingle is ``words`` lower-cased words between blanks, or all words of a shorter text; a text that is null or has
    no words has an empty set, is linked with nothing and is a component of its own. Documents are linked when ``percent``
    per cent of the union of their sets is in both; the component's name is its smallest id. Rows with one and the same
    id are one document: a link of any of them counts for all.
    """
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = sh.save(sh.annotate(docs, ["doc_id"], "n_shingles long, d1 long, d2 long, bands array<long>", lambda: sketch(words)), "sketches")
    full = sketched.filter("n_shingles > 0")
    nodes = full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"))
    first = full.join(nodes.select("node", F.col("d1").alias("e1"), F.col("d2").alias("e2")), (F.col("doc_id") == F.col("node")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    rows = first.select("doc_id", F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high").select("bucket", "n")
    # a draw from 0 to the size of the bucket: about k members of each bucket have one under k
    draw = F.pmod(F.xxhash64("doc_id", "bucket"), F.lit(DRAW)) / F.lit(float(DRAW)) * F.col("n")
    members = sh.save(rows.join(several, "bucket").select("bucket", "doc_id", draw.alias("draw")).distinct(), "members")
    ids = members.select("doc_id").distinct()
    touched = docs.join(ids, "doc_id", "left_semi")
    texts = sh.save(touched, "texts")
    chunks = sh.chunk_count(texts, CHUNK)
    texts = sh.chunked(texts, chunks)
    labels = ids.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"))
    high, labels = 0, sh.save(labels, "labels")
    while True:
        named = members.join(labels, F.col("doc_id") == F.col("node")).select("bucket", "doc_id", "draw", "label")
        seen = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("doc_id").alias("least"))
        named = sh.save(named.join(seen.filter("low < high").select("bucket", "least"), "bucket"), "open")
        if not named.head(1):
            break
        chosen = F.col("draw") < high if high else F.col("doc_id") == F.col("least")
        centers = named.filter(chosen)
        links = sh.save(confirmed(texts, named, centers, chunks, words, percent), "confirmed")
        name = lambda side: labels.select(F.col("node").alias(f"{side}_node"), F.col("label").alias(f"{side}_label"))  # noqa: B023, E731
        edges = links.join(name("a"), F.col("a") == F.col("a_node")).join(name("b"), F.col("b") == F.col("b_node")).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()
        moved = components(edges).select(F.col("node").alias("old"), F.col("label").alias("new"))
        labels = sh.save(labels.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        members = named.filter(F.col("draw") >= high).select("bucket", "doc_id", "draw")
        high = max(GROWTH, high * GROWTH)
    named = nodes.join(labels.withColumnRenamed("node", "key"), F.col("node") == F.col("key"), "left").select(
        F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("label", "node").alias("component"))
    same = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n_shingles") > 0)
    return sketched.join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def remove_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, of which each component keeps the one with the smallest id; rows without an id stay."""
    gone = group(docs, words, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone__"))
    return docs.join(gone, F.col("doc_id") == F.col("gone__"), "left_anti")
