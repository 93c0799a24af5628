"""Writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_products(products: Mapping[str, DataFrame], folder: str) -> None:
    """Index, ranking and full list as separate JSON outputs."""
    for name, df in products.items():
        write_json(df, f"{folder}/{name}")


def package(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """One row per key with its attributes nested, ready for a JSON package."""
    return df.select(F.col(key).alias("key"), F.struct(*attributes).alias("attributes"))
