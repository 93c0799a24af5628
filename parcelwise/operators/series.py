"""Wide monthly tables: long form, latest value, history and data lag."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators.joins import keep_areas

# Fixed value: month columns are named by their last day.
MONTH_COLUMN = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def month_columns(columns: Sequence[str]) -> list[str]:
    """Month columns of a wide table, oldest first; an error when there is none."""
    found = sorted(c for c in columns if MONTH_COLUMN.match(c))
    if not found:
        raise ValueError(f"no month columns in {list(columns)[:20]}")
    return found


def to_long(wide: DataFrame, ids: Sequence[str], months: Sequence[str] | None = None) -> DataFrame:
    """One row per (key, month) with a positive value; only the asked columns are read."""
    months = list(months or month_columns(wide.columns))
    slim = wide.select(*ids, *[F.col(f"`{m}`").try_cast("double").alias(m) for m in months])
    long = slim.unpivot(list(ids), [F.col(f"`{m}`") for m in months], "month", "value")
    return long.where("value > 0").withColumn("month", F.col("month").cast("date"))


def latest(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest positive value per key and its month."""
    return long.groupBy(*keys).agg(
        F.bround(F.max_by("value", "month"), 2).alias("latest_value"), F.max("month").alias("latest_month"),
    ).withColumn("period_start", F.trunc("latest_month", "MM"))


def history(long: DataFrame, keys: Sequence[str], months: Sequence[str]) -> DataFrame:
    """Map month -> value over the given trailing months; at most ``len(months)`` entries per key."""
    low = min(months)
    rows = long.where(F.col("month") >= F.lit(low).cast("date"))
    entries = F.sort_array(F.collect_list(F.struct(F.date_format("month", "yyyy-MM-dd").alias("m"),
                                                   F.bround("value", 2).alias("v"))))
    return rows.groupBy(*keys).agg(F.map_from_entries(entries).alias("history"))


def modal_month(latest_rows: DataFrame, month: str = "latest_month") -> DataFrame:
    """The most frequent latest month; the later month wins a tie. One row."""
    return (
        latest_rows.where(F.col(month).isNotNull()).groupBy(month).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.desc(month)).limit(1)
    )


def lag_days(month: Column, as_of: Column) -> Column:
    return F.datediff(as_of, month)


def observation_rows(latest_rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Latest values as all-unit market observations."""
    return latest_rows.select(
        F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(":"), F.date_format("latest_month", "yyyy-MM"),
                 F.lit(":all_units")).alias("m_id"),
        F.concat(F.lit("zcta:"), F.col(key).cast("string")).alias("area_id"),
        F.col("period_start").alias("m_period"), F.col("latest_value").alias("m_value"),
        F.lit("all_units").alias("m_scope"), F.lit(None).cast("int").alias("m_bedroom"),
        F.lit("unknown").alias("m_gross_net"), F.lit("index").alias("m_basis"),
    )


def area_rows(df: DataFrame, key: str, vintage: str) -> DataFrame:
    """Area dimension rows for the areas of a source."""
    k = F.col(key).cast("string")
    return df.select(
        F.concat(F.lit("zcta:"), k).alias("market_area_id"), F.lit("zcta").alias("geography_type"), k.alias("name"),
        F.lit(vintage).alias("vintage"), F.concat(F.lit("zcta:"), k, F.lit(f":{vintage}")).alias("geometry_id"),
    ).distinct()


def areas_with_series(areas: DataFrame, latest_rows: DataFrame, key: str) -> DataFrame:
    """All areas with their latest value; a missing area shows the modal month."""
    modal = modal_month(latest_rows).select("latest_month").scalar()
    return keep_areas(areas, latest_rows, key, "latest_value").withColumn(
        "current_month", F.coalesce("latest_month", modal))


def nested(long: DataFrame, keys: Sequence[str], period: str = "period", value: str = "value") -> DataFrame:
    """Series rows nested as an ordered list of (period, value); one entry per calendar period."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(period).alias("period"), F.col(value).alias("value"))))
    return long.groupBy(*keys).agg(entries.alias("observations"))
