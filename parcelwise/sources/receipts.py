"""File inventories and the gates on them."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BLOCK = 1 << 20


def inventory(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Relative path, sha256 of the bytes and length of every file under a folder.

    The paths are those of Spark's own file listing, which reads no content and holds empty files too. They are dealt to
    tasks, and each task reads its files block by block through PyArrow's file systems and hashes on the way, so a file of
    any size takes one block of memory and is never a value in a row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # the part of the qualified path after the folder, cut once at the front
    root = folder.rstrip("/").split("://")[-1].lstrip("/") + "/"
    files = spark.createDataFrame([(unquote(uri),) for uri in reader.load(folder).inputFiles()], "uri string")
    path = F.expr(f"substring(uri, locate('{root}', uri) + {len(root)})")
    # one row a file: dealt by hash, so large files that lie together don't meet in one task
    return files.select(path.alias("path"), "uri").repartition("uri").mapInArrow(hashed, "path string, sha256 string, byte_length long")


def hashed(batches):
    """The files of a task one by one."""
    for batch in batches:
        found = [stream_sha256(uri) for uri in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                                         names=["path", "sha256", "byte_length"])


def stream_sha256(uri: str) -> tuple[str, int]:
    """sha256 and number of the bytes behind a qualified path, read in blocks."""
    scheme, _, rest = uri.partition(":")
    store, place = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(place, compression=None, buffer_size=BLOCK) as stream:
        while block := stream.read(BLOCK):
            digest.update(block)
            size += len(block)
    return digest.hexdigest(), size


def receipts(files: DataFrame, source_id: str, retrieved_at) -> DataFrame:
    """Inventory rows as snapshot receipts."""
    return files.select(F.lit(source_id).alias("source_id"), "path", "sha256", "byte_length",
                        F.lit(retrieved_at).cast("timestamp").alias("retrieved_at"))


def pin_gate(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Files against pinned hashes: every pin with ok, a missing file fails."""
    out = pins.select("path", F.col("sha256").alias("expected")).join(files.select("path", F.col("sha256").alias("actual")), "path", "left")
    return out.withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def header_gate(columns: Mapping[str, Sequence[str]], required: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Required columns missing per file, from schemas alone."""
    return {name: [c for c in need if c not in columns.get(name, ())] for name, need in required.items()
            if any(c not in columns.get(name, ()) for c in need)}
