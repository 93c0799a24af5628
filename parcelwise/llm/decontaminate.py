"""Operator 2: finds passages of a benchmark in documents by suffix arrays and removes the affected documents.

Each batch of documents is a shard with a suffix array over word numbers: all positions whose word occurs in the
benchmark, in the order of their next ``window`` words and then of the word before them (the others can't start a
match). Every suffix of every benchmark text is binary-searched in it; the range it finds holds all places that agree with
it in a whole window. Those of them with the same word before continue a match that began earlier, and they lie together in
the range; so only beginnings are taken out, and each is extended to the longest verbatim match by comparing prefix hashes
of word numbers. Memory follows the number of longest matches, also where one word repeats in item and document.

Nothing is shuffled. The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text; with more than one block
the documents pass once per block, the marks so far saved in between.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

WINDOW = 10
BLOCK_BYTES = 8 << 20
FOUND = "n_words__ long, hit__ binary, found__ array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def test_suffixes(items: pa.Table, window: int) -> dict:
    """Word numbers of a benchmark block: vocabulary, ids by place, and the suffixes that start a window."""
    data, at = sh.packed(items.column("text"))
    data = sh.LOWER[data]
    starts, ends, row = sh.words(data, at, sh.LETTERLIKE)
    hashes = sh.word_hashes(data, starts, ends)
    vocabulary = np.unique(hashes)
    ids = np.zeros(len(starts) + items.num_rows + window, np.int64)
    place = np.arange(len(starts)) + row
    ids[place] = np.searchsorted(vocabulary, hashes) + 1
    size = np.bincount(row, minlength=items.num_rows)
    first = np.cumsum(size) - size
    offset = np.arange(len(starts)) - first[row]
    length = np.where(size[row] >= window, window, size[row])
    whole = offset + length <= size[row]
    names = np.array(items.column("item_id").to_pylist(), object)
    # the word before, or one that equals none at the start of an item and before an item shorter than a window
    before = np.where((offset > 0) & (size[row] >= window), ids[place - 1], -1)
    return {"vocabulary": vocabulary, "ids": ids, "sums": prefix_sums(ids), "before": before[whole], "left": (size[row] - offset)[whole], "place": place[whole], "offset": offset[whole], "length": length[whole], "item": row[whole], "names": names}


def columns(ids: np.ndarray, place: np.ndarray, window: int, bits: int, fill: np.ndarray | None = None) -> list[np.ndarray]:
    """The next ``window`` word numbers packed into as few integers as hold them; words from fill[i] on count as largest."""
    per = 62 // bits
    out = []
    for a in range(0, window, per):
        key = np.zeros(len(place), np.int64)
        for j in range(per):
            word = ids[place + a + j] if a + j < window else np.zeros(len(place), np.int64)
            if fill is not None:
                word = np.where(a + j >= abs(fill), np.where(fill > 0, 0, (1 << bits) - 1), word)
            key = (key << bits) | word
        out.append(key)
    return out


def suffix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by all columns: by the first, and by the rest only where that is not unique."""
    order = np.argsort(keys[0], kind="stable")
    if len(keys) > 1 and len(order):
        s = keys[0][order]
        run = np.cumsum(np.append(0, s[1:] != s[:-1]))
        shared = np.flatnonzero(np.bincount(run)[run] > 1)
        sub = order[shared]
        order[shared] = sub[np.lexsort([k[sub] for k in keys[:0:-1]] + [run[shared]])]
    return order


def bound(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Vectorised binary search in rows sorted by several columns."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        below, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, w in zip(keys, wanted, strict=True):
            have, want = k[mid], w[open_]
            below |= same & (have < want)
            same &= have == want
        below |= same & right
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


def prefix_sums(ids: np.ndarray) -> np.ndarray:
    """Sums of mixed word numbers times powers, from the start to each place."""
    out = np.zeros(len(ids) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(sh.mixed((ids.astype(np.uint64) + np.uint64(1)) * sh.POWER) * sh.powers(len(ids))[0], out=out[1:])
    return out


def common_words(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from i on the left and j on the right, between ``least`` (known to agree) and ``most``."""
    down = sh.powers(max(len(left), len(right)))[1]
    low, high = least.copy(), most.copy()
    with np.errstate(over="ignore"):
        while (open_ := np.flatnonzero(low < high)).size:
            a, b = i[open_], j[open_]
            mid = (low[open_] + high[open_] + 1) // 2
            same = (left[a + mid] - left[a]) * down[a] == (right[b + mid] - right[b]) * down[b]
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
    return low


def search(test: dict, window: int, data: np.ndarray, at: np.ndarray):
    """(words per document, test suffix, first word in the shard, words, row) of all longest matches in one shard."""
    data = sh.LOWER[data]
    starts, ends, row = sh.words(data, at, sh.LETTERLIKE)
    n_words = np.bincount(row, minlength=len(at) - 1)
    none = np.zeros(0, np.int64)
    vocabulary = test["vocabulary"]
    if not len(test["place"]) or not len(starts):
        return n_words, none, none, none, none
    hashes = sh.word_hashes(data, starts, ends)
    number = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    number = np.where(vocabulary[number] == hashes, number + 1, 0)
    ids = np.zeros(len(starts) + len(at) - 1 + window, np.int64)
    place = np.arange(len(starts)) + row
    ids[place] = number
    bits = int(len(vocabulary) + 1).bit_length()
    suffix = place[number > 0]
    keys = [*columns(ids, suffix, window, bits), ids[suffix - 1]]
    order = suffix_order(keys)
    keys, suffix = [k[order] for k in keys], suffix[order]
    length, before = test["length"], test["before"]
    wanted = columns(test["ids"], test["place"], window, bits, length)
    low = bound(keys[:-1], wanted, False)
    high = bound(keys[:-1], columns(test["ids"], test["place"], window, bits, -length), True)
    # places from a to b continue a match
    a, b = low.copy(), low.copy()
    later = np.flatnonzero((before >= 0) & (low < high))
    asked = [*(w[later] for w in wanted), before[later]]
    a[later], b[later] = bound(keys, asked, False), bound(keys, asked, True)
    n = (a - low) + (high - b)
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    places = suffix[np.where(k < (a - low)[which], low[which] + k, b[which] + k - (a - low)[which])]
    word = np.searchsorted(place, places)
    doc = row[word]
    rest = np.cumsum(n_words)[doc] - word
    most = np.where(length[which] < window, length[which], np.minimum(test["left"][which], rest))
    words = common_words(test["sums"], test["place"][which], prefix_sums(ids), places, length[which], most)
    return n_words, which, word, words, doc


def marker(broadcast, window: int, earlier: bool):
    def start():
        test = broadcast.value

        def make(data, at):
            n_words, which, at_word, words, doc = search(test, window, data, at)
            item, offset = test["item"][which], test["offset"][which]
            order = np.lexsort([offset, at_word - offset, item, doc])
            item, offset, at_word, words, doc = (x[order] for x in (item, offset, at_word, words, doc))
            first = np.cumsum(n_words) - n_words
            hit = np.zeros(n_words.sum() + 1, np.int32)
            np.add.at(hit, at_word, 1)
            np.add.at(hit, at_word + words, -1)
            hit = (np.cumsum(hit[:-1]) > 0).view(np.uint8)
            found = pa.StructArray.from_arrays(
                [pa.array(test["names"][item], pa.string()), pa.array(offset), pa.array(at_word - first[doc]), pa.array(words)],
                ["item_id", "item_word", "doc_word", "n_words"],
            )
            cuts = np.append(0, np.cumsum(np.bincount(doc, minlength=len(n_words))))
            return [pa.array(n_words), sh.blobs(hit, np.append(0, np.cumsum(n_words))), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found)]

        return make

    return start


def mark(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of each document and: n_words__ (words), hit__ (a byte for each word, 1 if inside a window of an
    item), found__ (longest verbatim matches: item, first word in item and document, number of words).

    A null text and one without words have no hits; items without words or without an id match nothing; repeated items
    and documents are each searched; an empty benchmark marks nothing.
    """
    items = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    spark = docs.sparkSession
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        test = spark.sparkContext.broadcast(test_suffixes(block.toArrow(), window))
        carry = keep if b == blocks - 1 else [*keep, *({"text"} - {*keep})]
        earlier = ["hit_so_far__", "found_so_far__"] if b else []
        docs = sh.annotate(docs, [*carry, *earlier], FOUND, marker(test, window, bool(b)))
        if b:
            either = F.expr("transform(sequence(1, cast(n_words__ as int)), i -> greatest(ascii(substr(hit__, i, 1)), ascii(substr(hit_so_far__, i, 1))))")
            docs = docs.withColumn("hit__", F.when(F.col("n_words__") > 0, F.unhex(F.array_join(F.transform(either, lambda x: F.lpad(F.hex(x), 2, "0")), ""))).otherwise(F.col("hit__")))
            docs = docs.withColumn("found__", F.concat("found_so_far__", "found__")).drop(*earlier)
        if b < blocks - 1:
            docs = sh.save(docs, "decontaminate").withColumnsRenamed({"hit__": "hit_so_far__", "found__": "found_so_far__"}).drop("n_words__")
    return docs


def digest(marked: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform("found__", lambda m: m["item_id"])))
    n_hit = F.octet_length(F.translate(F.hex("hit__"), "0", "")).cast("long")
    return marked.select(
        "doc_id", F.col("n_words__").alias("n_words"), n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a window of an item."""
    return mark(docs, items, docs.columns).filter(F.size("found__") == 0).select(*[f"`{c}`" for c in docs.columns])
