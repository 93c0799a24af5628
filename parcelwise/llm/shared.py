"""What the operators share: saved tables, chunks of documents, packed text columns, word positions.

Rules that hold for every operator: a null text counts as empty; extra columns are ignored unless an operator
says that it keeps them; repeated rows are handled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.session import ensure_checkpoint_dir

CHUNK_BYTES = 2 << 20
BATCH_BYTES = 2 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, so that tasks can import them anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="parcelwise-"), "parcelwise.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``, one of our own only where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or ensure_checkpoint_dir(spark)).rstrip("/")


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks of about ``chunk_bytes`` of text the documents make."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / chunk_bytes))


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, doc_id, text) of the rows with an id; ids are dealt evenly over the chunks by hash."""
    ship(docs.sparkSession)
    return docs.filter(F.col("doc_id").isNotNull()).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )


def packed(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column back to back, and the offset of each row (one more than rows)."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_binary())
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def ordered(table: pa.Table) -> pa.Table:
    """The documents of a chunk in the order that every pass over it uses."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").to_numpy().astype(np.int64)


def blobs(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for each stretch data[cuts[i]:cuts[i + 1]]."""
    width = data.dtype.itemsize
    raw = pa.py_buffer(np.ascontiguousarray(data))
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int64)), raw]).cast(pa.binary())


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values from a rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59B % 2**63)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))


#: Byte value -> the same with A-Z lower-cased; byte classes of the two kinds of words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTERLIKE = np.zeros(256, bool)
LETTERLIKE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BYTE_KEYS = splitmix(256, 11)
POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes for which ``inside[byte]`` holds; runs never cross rows."""
    if not data.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    on = inside[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    last = on.copy()
    last[:-1] &= ~on[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < data.size)]
    first[edge] = on[edge]
    last[edge - 1] = on[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: exact prefix sums of keyed bytes times powers, taken back to power zero.

    The sum of a word is divided by the power at its start (powers of an odd number have an inverse), so equal words
    hash alike wherever they stand. Words are handled in pieces of bounded size.
    """
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        step, i = 1 << 13, 0
        while i < len(starts):
            j = min(len(starts), i + step)
            lo, hi = starts[i], ends[j - 1]
            power, inverse = powers(int(hi - lo))
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(BYTE_KEYS[data[lo:hi]] * power, out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
    return out


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            up = np.full(size, POWER, np.uint64)
            up[0] = 1
            down = np.full(size, np.uint64(pow(int(POWER), -1, 2**64)), np.uint64)
            down[0] = 1
            _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def pieces(at: np.ndarray, most: int = BATCH_BYTES, rows: int = 8192):
    """(first row, last row) ranges of at most ``most`` bytes and ``rows`` rows; a longer row is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, min(int(np.searchsorted(at, at[i] + most, side="right")) - 1, i + rows, n))
        yield i, j
        i = j


def annotate(docs: DataFrame, keep: list[str], extra: str, start) -> DataFrame:
    """``keep`` columns of ``docs`` and the ``extra`` ones that a function of the whole texts makes, without a shuffle.

    ``start()`` is called once per task and gives the function: (bytes, offsets) of up to BATCH_BYTES of texts (or
    one longer text) -> one Arrow array per extra column. Extra columns replace kept ones of the same name.
    """
    ship(docs.sparkSession)
    names = [x.strip().split(" ")[0] for x in top_level(extra)]
    keep = [c for c in keep if c not in names]
    source = docs.select(*[f"`{c}`" for c in keep], F.col("text").cast("string").alias("text__"))
    kept = docs.select(*[f"`{c}`" for c in keep]).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), extra])

    def run(batches):
        make = start()
        for batch in batches:
            data, at = packed(batch.column(batch.num_columns - 1))
            for i, j in pieces(at):
                made = make(data[at[i] : at[j]], at[i : j + 1] - at[i])
                old = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*old, *made], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def top_level(ddl: str) -> list[str]:
    """The columns of a DDL string; commas inside <> don't count."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def remainder(column: str, n: int):
    """crc32 of the id as text, mod n; null without an id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
