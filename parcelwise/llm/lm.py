"""Operator 3: scores texts with a log-bilinear language model trained by noise-contrastive estimation.

1. Word counts of the whole training corpus: each chunk of documents sends its distinct words (64-bit hashes) with their
   counts, dealt by hash; groups add them up and send each chunk the counts of its words back, in its own order.
2. Words are classes on two levels. The ``SHORT`` most frequent words and the end of a text are classes of the first
   level; so are groups of slots. Slots are the second level: the next most frequent words have one each, all further
   words share hashed ones. Both kinds grow with the square root of the counted words (``layout``), and so do the
   input vectors that words are hashed to. The last ``CONTEXT`` words, weighted by their places, predict a vector;
   its products with class vectors, and within a group with slot vectors, are the scores. Each task trains both levels
   on all training tokens of its partition against noise draws; the weights are averaged by token count.
3. Each chunk is scored with batched matrix products: p(class | context) p(slot | group, context), each normalised
   exactly, times the add-one share of a word in its slot where that is hashed. That is a proper distribution over all words.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh
from parcelwise.llm.suffix_dedup import CODEC, cuts_of, parts

CHUNK = 4 << 20
#: A group of words gets the words of so many chunks' worth of text, whatever the size of the corpus.
CHUNKS_A_BUCKET = 8
SHORT = 30
LEAST = 4096
GROWTH = 16
SIZE = 16
CONTEXT = 4
NOISE = 48
SLOT_NOISE = 16
BATCH = 2048
ROUND = 512
#: Tokens of one slot group go through the batched products in blocks of so many rows.
BLOCK = 8
MEET = 64
RATE = 0.2
PIECE = 1 << 16
COUNTED = "kind int, chunk int, bucket int, data binary, tokens long, types long"


def is_held(doc_id: int, folds: int, held: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == held


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    data = sh.LOWER[data]
    starts, ends, row = sh.words(data, at, ~sh.SPACE)
    return sh.word_hashes(data, starts, ends), row


def vocabulary(table: pa.Table, buckets: int):
    """Distinct words of a chunk in the order of (bucket, hash), and for each word of the texts which one it is."""
    data, at = sh.packed(table.column("text"))
    found = [(h, r + i) for i, j in sh.pieces(at) for h, r in [tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])]]
    hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
    row = np.concatenate([r for _, r in found]) if found else np.zeros(0, np.int64)
    uniq, inverse = np.unique(hashes, return_inverse=True)
    bucket = ((uniq >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return hashes, row, uniq[order], bucket[order], back[inverse]


def shrink(values: np.ndarray) -> bytes:
    raw = values.astype("<i8").tobytes()
    return np.array([len(raw)], "<i8").tobytes() + CODEC.compress(raw, asbytes=True)


def grow(blob: bytes) -> np.ndarray:
    return np.frombuffer(CODEC.decompress(blob[8:], int(np.frombuffer(blob, "<i8", 1)[0]), asbytes=True), "<i8")


def send_counts(buckets: int, folds: int, held: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        table = sh.ordered(table)
        _, row, uniq, bucket, which = vocabulary(table, buckets)
        train = np.array([not is_held(d, folds, held) for d in sh.ids_of(table).tolist()], bool)
        counts = np.bincount(which, train[row].astype(float), minlength=len(uniq)).astype(np.int64)
        cuts = cuts_of(bucket)
        data = [uniq[i:j].tobytes() + shrink(counts[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return parts(bucket[cuts[:-1]], chunk, pa.array(data, pa.binary())).append_column("n", pa.array(np.diff(cuts)))

    return run


def add_counts(table: pa.Table) -> pa.Table:
    """Corpus counts of the words of one group: back to each chunk, and in all."""
    sizes = table.column("n").to_numpy()
    blobs = table.column("data").to_pylist()
    hashes = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blobs, sizes, strict=True)])
    counts = np.concatenate([grow(b[8 * n :]) for b, n in zip(blobs, sizes, strict=True)])
    uniq, which = np.unique(hashes, return_inverse=True)
    total = np.bincount(which, counts, minlength=len(uniq)).astype(np.int64)
    cuts = np.append(0, np.cumsum(sizes))
    back = [shrink(total[which[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    n, seen = len(back), total > 0
    told = uniq[seen].tobytes() + shrink(total[seen])
    same = [*table.column("chunk").to_pylist(), -1], [*table.column("bucket").to_pylist(), -1]
    return pa.table({
        "kind": pa.array([0] * n + [1], pa.int32()), "chunk": pa.array(same[0], pa.int32()), "bucket": pa.array(same[1], pa.int32()),
        "data": pa.array([*back, told], pa.binary()), "tokens": pa.array([0] * n + [int(total.sum())], pa.int64()),
        "types": pa.array([0] * n + [int(seen.sum())], pa.int64()),
    })


def corpus_words(data: bytes, types: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the training words of one group."""
    return np.frombuffer(data, np.uint64, types), grow(data[8 * types :])


def leading(most: int):
    """The ``most`` most frequent words of each group; ``more`` marks the last one of a group that has further words."""

    def run(batches):
        for batch in batches:
            for data, types in zip(batch.column("data").to_pylist(), batch.column("types").to_pylist(), strict=True):
                hashes, n = corpus_words(data, types)
                top = np.lexsort([hashes.view(np.int64), -n])[:most]
                more = np.zeros(len(top), bool)
                more[-1:] = len(n) > most
                yield pa.RecordBatch.from_arrays([pa.array(hashes[top].view(np.int64)), pa.array(n[top]), pa.array(more)], ["hash", "n", "more"])

    return run


def layout(types: int) -> dict:
    """How many slots words have of their own and how many are hashed, groups of slots, slots a group, and input vectors."""
    half = max(64, GROWTH * math.isqrt(types))
    groups = math.isqrt(2 * half)
    return {"own": half, "hashed": half, "groups": groups, "wide": -(-2 * half // groups), "inputs": max(LEAST, 1 << (GROWTH * math.isqrt(types)).bit_length())}


def found(values: np.ndarray, k: np.ndarray, keys: np.ndarray, before) -> np.ndarray:
    """Moves each place ``k`` in sorted ``values`` on to the first one that is not ``before`` its key, or to the end. It is
    the result of a binary search, in a step or two where the first places are near."""
    last = len(values) - 1
    late = np.flatnonzero(before(values[k], keys))
    while len(late):
        k[late] += 1
        late = late[k[late] <= last]
        late = late[before(values[k[late]], keys[late])]
    return k


def slot_of(shape: dict, hashes: np.ndarray) -> np.ndarray:
    """SHORT words: 0, 1, ..; slots of words: from len(short) on; hashed slots: after all of these."""
    code = shape["short"] + shape["own"] + ((hashes >> np.uint64(40)) % np.uint64(shape["hashed"])).astype(np.int64)
    if len(shape["known"]):
        known = shape["known"]
        bits = len(known).bit_length()
        guide = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        k = found(known, np.minimum(guide, len(known) - 1)[hashes >> np.uint64(64 - bits)], hashes, np.less)
        k = np.minimum(k, len(known) - 1)
        code = np.where(known[k] == hashes, shape["rank"][k], code)
    return code


def slot_sums(shape: dict):
    """Tokens and types of the words that share each hashed slot."""

    def run(batches):
        for batch in batches:
            for data, types in zip(batch.column("data").to_pylist(), batch.column("types").to_pylist(), strict=True):
                hashes, n = corpus_words(data, types)
                code = slot_of(shape, hashes) - shape["short"] - shape["own"]
                shared = code >= 0
                slots, which = np.unique(code[shared], return_inverse=True)
                sums = [np.bincount(which, w, minlength=len(slots)).astype(np.int64) for w in (n[shared], np.ones(shared.sum()))]
                yield pa.RecordBatch.from_arrays([pa.array(slots), *map(pa.array, sums)], ["slot", "tokens", "types"])

    return run


def shares(shape: dict, top: np.ndarray, slots: np.ndarray, ends: int) -> dict:
    """Shares of the classes of the first level, and within each group of its slots (0: no such slot)."""
    place = position(shape, np.arange(len(slots)))
    table = np.zeros(shape["groups"] * shape["wide"])
    table[place] = slots + 1.0
    table = table.reshape(shape["groups"], shape["wide"])
    classes = np.concatenate([top + 1.0, [ends + 1.0], table.sum(1)])
    return shape | {"classes": classes / classes.sum(), "slots": (table / table.sum(1, keepdims=True)).ravel()}


def position(shape: dict, slot: np.ndarray) -> np.ndarray:
    """Where a slot stands in the table of groups; neighbours in frequency go to different groups."""
    return slot % shape["groups"] * shape["wide"] + slot // shape["groups"]


def fresh(shape: dict, seed: int = 3) -> dict:
    """Untrained weights whose scores are the logs of the shares."""
    rng = np.random.default_rng(seed)
    classes, slots = shape["classes"], shape["slots"]
    return {"in": (rng.normal(size=(shape["inputs"] + 1, SIZE)) * 0.3).astype(np.float32), "out": (rng.normal(size=(len(classes), SIZE)) * 0.1).astype(np.float32),
            "place": np.full((CONTEXT, SIZE), 1 / CONTEXT, np.float32), "bias": np.log(classes).astype(np.float32),
            "slot": (rng.normal(size=(len(slots), SIZE)) * 0.1).astype(np.float32), "slot_bias": np.log(np.maximum(slots, 1e-30)).astype(np.float32)}


def encode(shape: dict, hashes: np.ndarray, row: np.ndarray, n: int, code: np.ndarray | None = None):
    """``code``: the slots of the words, where known. Classes (words, the end, groups), places in the table of slots (-1: none), input vector, offset in the text, row and
    place of each token, ends of texts included. The last input vector stands for what is before the start."""
    words = np.bincount(row, minlength=n)
    size = words + 1
    first = np.cumsum(size) - size
    place = np.arange(len(row)) + row
    code = slot_of(shape, hashes) if code is None else code
    rest = code - shape["short"]
    cls, at = np.full(len(row) + n, shape["short"], np.int64), np.full(len(row) + n, -1, np.int64)
    cls[place] = np.where(rest < 0, code, shape["short"] + 1 + rest % shape["groups"])
    at[place] = np.where(rest < 0, -1, position(shape, rest))
    given = np.full(len(cls), shape["inputs"], np.int64)
    given[place] = (hashes % np.uint64(shape["inputs"])).astype(np.int64)
    doc = np.repeat(np.arange(n), size)
    return cls, at, given, np.arange(len(cls)) - first[doc], doc, place


def predicted(p: dict, given: np.ndarray, early: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the inputs, and the vector that the CONTEXT inputs before each token predict. ``given`` begins CONTEXT
    tokens before the first one to predict; ``early[j]``: tokens whose j-th last input is before the start of their text."""
    vectors = p["in"].take(given, axis=0)
    n = len(given) - CONTEXT
    q = np.zeros((n, SIZE), np.float32)
    for j in range(CONTEXT):
        term = vectors[CONTEXT - 1 - j : CONTEXT - 1 - j + n] * p["place"][j]
        term[early[j]] = p["in"][-1] * p["place"][j]
        q += term
    return vectors, q


def window(given: np.ndarray, offset: np.ndarray, a: int, b: int, start: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Inputs and early tokens of the tokens a to b."""
    lead = given[max(0, a - CONTEXT) : b]
    lead = np.concatenate([np.full(max(0, CONTEXT - a), start), lead])
    near = np.flatnonzero(offset[a:b] < CONTEXT)
    return lead, [near[offset[a:b][near] <= j] for j in range(CONTEXT)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def sorting(index: np.ndarray, size: int) -> np.ndarray:
    """The stable order of an index below ``size``."""
    return np.argsort(index.astype(np.uint16 if size <= 1 << 16 else np.int32), kind="stable")


def rows_of(index: np.ndarray, parts_: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of an index below ``size`` and the sums of their gradients, by one sort. Only what comes after the
    first gradient of a row is added up."""
    order = sorting(index, size)
    index = index[order]
    first = np.concatenate([[True], index[1:] != index[:-1]])
    rows, sums = index[first], parts_.take(order[first], axis=0)
    again = np.flatnonzero(~first)
    if len(again):
        which, width = (np.cumsum(first) - 1)[again], parts_.shape[1]
        more = starts_of(which)
        k = np.repeat(np.arange(len(more)), np.diff(np.append(more, len(which))))
        added = np.bincount((k[:, None] * width + np.arange(width)).ravel(), parts_.take(order[again], axis=0).ravel(), minlength=len(more) * width)
        sums[which[more]] += added.reshape(-1, width)
    return rows, sums


def joined(p: dict) -> dict:
    """Weights as they are trained: the bias of a class or slot is the last column of its vector."""
    return {"in": p["in"], "place": p["place"], "out": np.column_stack([p["out"], p["bias"]]), "slot": np.column_stack([p["slot"], p["slot_bias"]])}


def parted(w: dict) -> dict:
    return {"in": w["in"], "place": w["place"], "out": w["out"][:, :SIZE], "bias": w["out"][:, SIZE], "slot": w["slot"][:, :SIZE], "slot_bias": w["slot"][:, SIZE]}


def slot_step(slot: np.ndarray, q: np.ndarray, at: np.ndarray, wide: int, draw, log_slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the second level: of ``q``, whose rows are in the order of their places ``at`` in the table of slots,
    and by row of that table. The tokens of a group meet its noise slots in blocks of BLOCK rows, the last one filled up
    with rows of zeros, so that one batched product handles all groups."""
    group = at // wide
    first = starts_of(group)
    size = np.diff(np.append(first, len(group)))
    drawn = draw(group[first])
    slot_k = np.float32(np.log(SLOT_NOISE))
    there, other = slot.take(at, axis=0), slot.take(drawn, axis=0)
    there[:, SIZE] -= log_slot[at]
    other[:, :, SIZE] -= log_slot[drawn]
    there[:, SIZE] -= slot_k
    other[:, :, SIZE] -= slot_k
    d = sigmoid(np.einsum("ns,ns->n", q, there)) - 1
    blocks = -(-size // BLOCK)
    begin = np.cumsum(blocks) - blocks
    row = np.arange(len(at)) + np.repeat(begin * BLOCK - first, size)
    padded = np.zeros((blocks.sum() * BLOCK, SIZE + 1), np.float32)
    padded[row] = q
    padded = padded.reshape(-1, BLOCK, SIZE + 1)
    other = other.take(np.repeat(np.arange(len(first)), blocks), axis=0)
    e = sigmoid(padded @ other.transpose(0, 2, 1))
    dq = d[:, None] * there + (e @ other).reshape(-1, SIZE + 1).take(row, axis=0)
    each = e.transpose(0, 2, 1) @ padded
    noisy = each.take(begin, axis=0)
    for k in range(1, blocks.max()):
        more = np.flatnonzero(blocks > k)
        noisy[more] += each.take(begin[more] + k, axis=0)
    return dq, *rows_of(np.concatenate([at, drawn.ravel()]), np.concatenate([d[:, None] * q, noisy.reshape(-1, SIZE + 1)]), len(slot))


def put_rows(table: np.ndarray, rows: np.ndarray | None, values: np.ndarray) -> None:
    """Write whole rows (None: all of them), each as one item."""
    if rows is None:
        table[:] = values
    else:
        item = np.dtype((np.void, table.shape[1] * table.itemsize))
        np.put(table.view(item)[:, 0], rows, values.view(item)[:, 0])


def train_step(p: dict, speed: dict, lead: np.ndarray, early: list[np.ndarray], cls: np.ndarray, at: np.ndarray, noise: np.ndarray, draw, log_share: np.ndarray, log_slot: np.ndarray, wide: int) -> None:
    """One noise-contrastive step on both levels of ``joined`` weights. The noise classes are shared by the batch, the noise
    slots by the tokens of a group: ``draw(groups)`` gives SLOT_NOISE of each. Tokens are put in the order of class and slot."""
    n = len(cls)
    vectors, context = predicted(p, lead, early)
    words = len(p["out"]) - len(p["slot"]) // wide
    order = sorting(np.where(at < 0, cls, at + words), words + len(p["slot"]))
    cls, at = cls[order], at[order]
    q = np.ones((n, SIZE + 1), np.float32)
    q[:, :SIZE] = context.take(order, axis=0)
    level = p["out"].copy()
    level[:, SIZE] -= log_share
    level[:, SIZE] -= np.float32(np.log(len(noise)))
    target, against = level.take(cls, axis=0), level.take(noise, axis=0)
    d_true = sigmoid(np.einsum("ns,ns->n", q, target)) - 1
    d_noise = sigmoid(q @ against.T)
    dq = d_true[:, None] * target + d_noise @ against
    first = starts_of(cls)
    drawn = np.zeros((len(p["out"]), len(noise)), np.float32)
    drawn[noise, np.arange(len(noise))] = 1
    out = drawn @ (d_noise.T @ q)
    out[cls[first]] += np.add.reduceat(d_true[:, None] * q, first, axis=0)
    grads = {"out": (None, out)}
    short = int(np.searchsorted(at, 0))
    if short < n:
        back, *grads["slot"] = slot_step(p["slot"], q[short:], at[short:], wide, draw, log_slot)
        dq[short:] += back
    of_context = np.empty((n, SIZE), np.float32)
    of_context[order] = dq[:, :SIZE]
    dq = of_context
    place, back, start = np.zeros((CONTEXT, SIZE), np.float32), np.zeros_like(vectors), np.zeros(SIZE, np.float32)
    for j in range(CONTEXT):
        part = slice(CONTEXT - 1 - j, CONTEXT - 1 - j + n)
        place[j] = (vectors[part].T @ dq).diagonal() + ((p["in"][-1] - vectors[part][early[j]]) * dq[early[j]]).sum(0)
        term = dq * p["place"][j]
        start += term[early[j]].sum(0)
        term[early[j]] = 0
        back[part] += term
    grads |= {"place": (None, place), "in": rows_of(np.append(lead, len(p["in"]) - 1), np.concatenate([back, start[None]]), len(p["in"]))}
    for k, (rows, g) in grads.items():
        g /= np.float32(n)
        pace = g * g
        pace += speed[k] if rows is None else speed[k].take(rows, axis=0)
        put_rows(speed[k], rows, pace)
        np.sqrt(pace, out=pace)
        pace += np.float32(1e-4)
        g *= np.float32(RATE)
        g /= pace
        put_rows(p[k], rows, (p[k] if rows is None else p[k].take(rows, axis=0)) - g)


def drawing(shape: dict, rng):
    """SLOT_NOISE draws by share from each of some groups, in ascending order."""
    ends, wide, filled = np.cumsum(shape["slots"]), shape["wide"], shape["filled"]
    guide = np.minimum(np.searchsorted(ends, np.arange(len(ends) + 1) / wide, side="right"), len(ends) - 1)

    def draw(groups: np.ndarray) -> np.ndarray:
        keys = (groups[:, None] + np.sort(rng.random((len(groups), SLOT_NOISE)), axis=1)).ravel()
        drawn = found(ends, guide[(keys * wide).astype(np.int64)], keys, np.less_equal).reshape(-1, SLOT_NOISE)
        return np.clip(drawn, (groups * wide)[:, None], (groups * wide + filled[groups] - 1)[:, None])

    return draw


def trainer(shape: dict):
    def run(batches):
        p, rng, total = fresh(shape), np.random.default_rng(4), 0
        log_share, log_slot = p["bias"], p["slot_bias"]
        p = joined(p)
        speed = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        upto, draw = np.cumsum(shape["classes"]), drawing(shape, rng)
        for batch in batches:
            data, at = sh.packed(batch.column("text"))
            for i, j in sh.pieces(at):
                hashes, row = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                cls, slot, given, offset, _, _ = encode(shape, hashes, row, j - i)
                for a in range(0, len(cls), BATCH):
                    b = min(a + BATCH, len(cls))
                    noise = np.minimum(np.searchsorted(upto, rng.random(NOISE), side="right"), len(upto) - 1)
                    train_step(p, speed, *window(given, offset, a, b, shape["inputs"]), cls[a:b], slot[a:b], noise, draw, log_share, log_slot, shape["wide"])
                total += len(cls)
        if total:
            task = TaskContext.get().partitionId() if TaskContext.get() else 0
            p = parted(p)
            flat = np.concatenate([p[k].ravel() for k in sorted(p)])
            cut = range(0, len(flat), PIECE)
            columns = [pa.array(range(len(cut)), pa.int64()), pa.array([task] * len(cut), pa.int64()), pa.array([flat[a : a + PIECE].tobytes() for a in cut], pa.binary()), pa.array([total] * len(cut), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "task", "weights", "total"])

    return run


def averaged(table: pa.Table) -> pa.Table:
    """The mean of one piece of the weights over some tasks, by token count."""
    totals = table.column("total").to_numpy()
    mean = sum(np.frombuffer(w.as_buffer(), np.float32) * (n / totals.sum()) for w, n in zip(table.column("weights"), totals, strict=True))
    return pa.table({"piece": table.column("piece")[:1], "task": pa.array([table.column("task")[0].as_py() // MEET], pa.int64()),
                     "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary()), "total": pa.array([int(totals.sum())], pa.int64())})


def mean_weights(pieces: DataFrame, tasks: int) -> list:
    """Averages in levels: at most MEET copies of a piece meet in a group, however many tasks trained."""
    while True:
        pieces = pieces.groupBy("piece", F.floor(F.col("task") / MEET)).applyInArrow(lambda t: averaged(t), "piece long, task long, weights binary, total long")
        if tasks <= MEET:
            return sorted((r.piece, r.weights) for r in pieces.collect())
        tasks = -(-tasks // MEET)


def leading_words(words: DataFrame, most: int, buckets: int) -> list:
    """The ``most`` most frequent words of the corpus, ties by hash. Each group sends its first ones; where the last one a
    group sent still belongs to the result and the group has more, all send four times as many."""
    send = 2 * most // buckets + SHORT
    while True:
        lead = words.mapInArrow(leading(send), "hash long, n long, more boolean").orderBy(F.desc("n"), "hash").limit(most).collect()
        if not any(r.more for r in lead):
            return lead
        send *= 4


def train(docs: DataFrame, counted: DataFrame, types: int, ends: int, buckets: int) -> dict:
    """The net from all texts of ``docs``; ``counted``: words and counts by group."""
    shape = layout(types)
    most = SHORT + shape["own"]
    words = counted.filter("kind = 1").select("data", "types")
    lead = leading_words(words, most, buckets)
    hashes, counts = np.array([r.hash for r in lead], np.int64).view(np.uint64), np.array([r.n for r in lead], np.int64)
    order = np.argsort(hashes)
    shape |= {"short": min(SHORT, len(lead)), "own": max(0, len(lead) - SHORT), "known": hashes[order], "rank": order}
    slots, kinds = np.zeros(shape["own"] + shape["hashed"], np.int64), np.zeros(shape["hashed"], np.int64)
    slots[: shape["own"]] = counts[shape["short"] :]
    for r in words.mapInArrow(slot_sums(shape), "slot long, tokens long, types long").groupBy("slot").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect():
        slots[shape["own"] + r.slot], kinds[r.slot] = r.tokens, r.types
    shape = shares(shape, counts[: shape["short"]], slots, ends)
    shape["filled"] = (shape["slots"].reshape(shape["groups"], shape["wide"]) > 0).sum(1)
    pieces = sh.save(docs.select("text").mapInArrow(trainer(shape), "piece long, task long, weights binary, total long"), "weights")
    got = mean_weights(pieces, (pieces.agg(F.max("task")).first()[0] or 0) + 1)
    p, at = fresh(shape), 0
    if got:
        flat = np.frombuffer(b"".join(w for _, w in got), np.float32)
        for k in sorted(p):
            p[k] = flat[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
    p["slot_bias"] = np.where(shape["slots"] > 0, p["slot_bias"], np.float32(-1e30))
    return {"net": p, "shape": shape, "shared": slots[shape["own"] :] + kinds + 1}


def log_softmax(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray, own: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of q's scores at one column each; ``q`` has a last column of ones. Blocks fit the cache
    and are worked out in ``room``, of at least ROUND rows."""
    table = np.concatenate([vectors, bias[:, None]], 1)
    seen = bias > -1e29
    reach, most = np.sqrt((vectors[seen] ** 2).sum(1).max(initial=0)), bias.max(initial=-1e30)
    out, ones = np.empty(len(q)), np.ones(len(table), np.float32)
    for a in range(0, len(q), ROUND):
        part = q[a : a + ROUND]
        s = np.matmul(part, table.T, out=room[: len(part) * len(table)].reshape(len(part), len(table)))
        value = np.einsum("ns,ns->n", part, table.take(own[a : a + ROUND], axis=0))
        if np.sqrt(np.einsum("ns,ns->n", part, part).max()) * reach + most > 80:
            top = s.max(1, keepdims=True)
            s -= top
            value -= top[:, 0]
        np.exp(s, out=s)
        out[a : a + ROUND] = value - np.log(s @ ones)
    return out


def log_probabilities(p: dict, shape: dict, cls: np.ndarray, at: np.ndarray, given: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each class after its context, and of the slot in its group."""
    q, out = np.empty((len(cls), SIZE + 1), np.float32), np.empty(len(cls))
    room = np.empty(ROUND * max(len(p["bias"]), shape["wide"]), np.float32)
    for a in range(0, len(cls), BATCH):
        b = min(a + BATCH, len(cls))
        q[a:b, :SIZE], q[a:b, SIZE] = predicted(p, *window(given, offset, a, b, shape["inputs"]))[1], 1
        out[a:b] = log_softmax(q[a:b], p["out"], p["bias"], cls[a:b], room)
    own = np.flatnonzero(at >= 0)
    own = own[sorting(cls[own], len(p["bias"]))]
    cuts = cuts_of(cls[own])
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        rows = own[i:j]
        low = at[rows[0]] // shape["wide"] * shape["wide"]
        part = slice(low, low + shape["wide"])
        out[rows] += log_softmax(q.take(rows, axis=0), p["slot"][part], p["slot_bias"][part], at[rows] - low, room)
    return out / np.log(10)


def scorer(shared_model, facts: dict, buckets: int, folds: int, held: int):
    """Chunk of documents and the corpus counts of its words -> scores; ``shared_model``: a broadcast net."""

    def run(table: pa.Table, counted: pa.Table) -> pa.Table:
        model = shared_model.value
        table = sh.ordered(table)
        n = table.num_rows
        hashes, row, uniq, bucket, which = vocabulary(table, buckets)
        c = np.zeros(len(uniq), np.int64)
        cuts = cuts_of(bucket)
        place = dict(zip(bucket[cuts[:-1]].tolist(), cuts[:-1].tolist(), strict=True))
        for b, raw in zip(counted.column("bucket").to_pylist(), counted.column("data").to_pylist(), strict=True):
            got = grow(raw)
            c[place[b] : place[b] + len(got)] = got
        shape = model["shape"]
        c, code = c[which], slot_of(shape, uniq)[which]
        words = np.bincount(row, minlength=n)
        size = words + 1
        ids = sh.ids_of(table)
        base = np.bincount(row, np.log10(c + 1.0), minlength=n) + np.log10(facts["ends"] + 1.0) - size * np.log10(facts["tokens"] + facts["types"] + 1.0)
        known = np.bincount(row, c > 0, minlength=n).astype(np.int64) + (facts["ends"] > 0)
        score, a = np.zeros(n), 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(np.cumsum(size), (np.cumsum(size)[a - 1] if a else 0) + 400_000)))
            lo, hi = np.searchsorted(row, [a, b])
            cls, at, given, offset, doc, place_ = encode(shape, hashes[lo:hi], row[lo:hi] - a, b - a, code[lo:hi])
            log = log_probabilities(model["net"], shape, cls, at, given, offset)
            shared = code[lo:hi] - shape["short"] - shape["own"]
            other = shared >= 0
            log[place_[other]] += np.log10((c[lo:hi][other] + 1.0) / model["shared"][shared[other]])
            score[a:b] = np.bincount(doc, log, minlength=b - a)
            a = b
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": pa.array([is_held(d, folds, held) for d in ids.tolist()], pa.bool_()), "n_tokens": pa.array(size.astype(np.int64)),
            "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, facts["tokens"]), pa.int64()), "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def score(docs: DataFrame, folds: int = 7, held: int = 2, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document with an id.

    A text's tokens are its lower-cased words between blanks and one end; a null or empty text is the end alone. Counts
    and net come from all documents of the other folds; repeated documents count and are scored each time. Without
    training documents the base is 0 for every text and the net stays untrained.
    """
    spark = docs.sparkSession
    docs = docs.filter(F.col("doc_id").isNotNull())
    chunks = sh.chunk_count(docs, chunk_bytes)
    buckets = -(-chunks // CHUNKS_A_BUCKET)
    parts_ = sh.chunked(docs, chunks)
    sent = parts_.groupBy("chunk").applyInArrow(send_counts(buckets, folds, held), "bucket int, chunk int, data binary, n long")
    counted = sh.save(sent.groupBy("bucket").applyInArrow(add_counts, COUNTED), "counts")
    told = counted.filter("kind = 1").agg(F.sum("tokens"), F.sum("types")).first()
    training = docs.filter(sh.remainder("doc_id", folds) != held)
    ends = training.count()
    facts = {"ends": ends, "tokens": (told[0] or 0) + ends, "types": (told[1] or 0) + (ends > 0)}
    model = spark.sparkContext.broadcast(train(training, counted, told[1] or 0, ends, buckets))
    back = counted.filter("kind = 0").select("chunk", "bucket", "data")
    return parts_.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        scorer(model, facts, buckets, folds, held), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
