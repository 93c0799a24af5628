"""Tabular text sources. Everything is read as text; typing is a later, explicit step."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions.typed import finite, zip5
from parcelwise.operators.joins import first_per_key


def read_csv(spark: SparkSession, path: str, *, empty_for_null: bool = False, quote_lines: bool = False) -> DataFrame:
    """Headered CSV as all-text columns: BOM and outer blanks off the header names.

    ``empty_for_null`` turns missing cells into empty text. ``quote_lines`` allows line breaks inside quotes,
    which makes a file unsplittable.
    """
    df = (
        spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
        .option("multiLine", quote_lines).option("escape", '"').csv(path)
    )
    names = [c.lstrip("﻿").strip() for c in df.columns]
    if not any(names):
        raise ValueError(f"no header row in {path}")
    df = df.toDF(*names)
    if empty_for_null:
        df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])
    return df


def _spaces(name: str) -> str:
    return re.sub(r"\s+", " ", name).strip()


def find_column(columns: Sequence[str], *wanted: str, prefix: bool = False) -> str:
    """Column by normalised name, then ignoring blanks, then (if asked) by prefix."""
    norm = {_spaces(c): c for c in columns}
    packed = {k.replace(" ", ""): c for k, c in norm.items()}
    for w in wanted:
        if _spaces(w) in norm:
            return norm[_spaces(w)]
        if _spaces(w).replace(" ", "") in packed:
            return packed[_spaces(w).replace(" ", "")]
    if prefix:
        for w in wanted:
            for k, c in packed.items():
                if k.startswith(_spaces(w).replace(" ", "")):
                    return c
    raise KeyError(f"no column like {wanted} among {list(columns)[:12]}")


def bedroom_limits(df: DataFrame, zip_name: str, area_name: str, code_name: str, prefix: str, area_contains: str = "",
                   bedrooms: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Wide rent-limit table to rows (zip, area_code, area_name, bedroom, value).

    Keeps the areas whose name contains the filter text and values that are positive after rounding.
    """
    q = lambda c: F.col(f"`{c}`")
    zip_c, area_c, code_c = (find_column(df.columns, n) for n in (zip_name, area_name, code_name))
    beds = {b: find_column(df.columns, f"{prefix} {b}BR", prefix=True) for b in bedrooms}
    area = F.trim(F.coalesce(q(area_c).cast("string"), F.lit("")))
    slim = df.where(area.contains(area_contains)).select(
        zip5(q(zip_c).cast("string")).alias("zip"), F.trim(q(code_c).cast("string")).alias("area_code"),
        area.alias("area_name"), *[F.bround(finite(q(c)), 0).cast("bigint").alias(str(b)) for b, c in beds.items()],
    ).where("zip is not null")
    long = slim.unpivot(["zip", "area_code", "area_name"], [F.col(f"`{b}`") for b in beds], "bedroom", "value")
    return long.where("value > 0").withColumn("bedroom", F.col("bedroom").cast("int"))


def bedroom_maps(limits: DataFrame) -> DataFrame:
    """Rows of ``bedroom_limits`` to one row per ZIP with a map bedroom -> value (at most one per bedroom)."""
    entries = F.sort_array(F.collect_set(F.struct(F.col("bedroom").cast("string").alias("b"), F.col("value").alias("v"))))
    return limits.groupBy("zip", "area_code", "area_name").agg(F.map_from_entries(entries).alias("bedrooms"))


def program_rows(
    df: DataFrame, key: str, areas: Mapping[str, str], programs: Mapping[tuple[str, str], str],
    program_columns: tuple[str, str], measures: Sequence[str],
) -> DataFrame:
    """Program table: code lists choose the rows, each measure becomes a row, negative codes become null.

    The raw value stays beside the null with the reason.
    """
    def lookup(pairs: Mapping, col: Column) -> Column:
        return F.try_element_at(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]), col)

    a, b = (F.col(c).cast("string") for c in program_columns)
    chosen = df.select(
        lookup(areas, F.col(key).cast("string")).alias("geography_id"),
        lookup({"|".join(k): v for k, v in programs.items()}, F.concat(a, F.lit("|"), b)).alias("program_id"),
        *[F.col(m).try_cast("double").alias(m) for m in measures],
    ).where("geography_id is not null and program_id is not null")
    long = chosen.unpivot(["geography_id", "program_id"], list(measures), "statistic", "source_value")
    ok = F.col("source_value") >= 0
    return long.select("*", F.when(ok, F.col("source_value")).alias("value"),
                       F.when(~F.coalesce(ok, F.lit(False)), "missing or suppressed code").alias("unavailable_reason"))


def program_problems(rows: DataFrame, areas: Mapping[str, str], programs: Mapping[tuple[str, str], str], statistics: Sequence[str]) -> DataFrame:
    """What keeps a program table from being whole: an area's program that occurs twice, or not at all."""
    spark = rows.sparkSession
    per = rows.where(F.col("statistic") == statistics[0]).groupBy("geography_id", "program_id").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(g, p) for g in sorted({*areas.values()}) for p in sorted({*programs.values()})], "geography_id string, program_id string")
    problem = F.when(F.col("n") > 1, "duplicate geographic program").when(F.col("n").isNull(), "missing geographic program")
    return wanted.join(per, ["geography_id", "program_id"], "left").select("geography_id", "program_id", problem.alias("problem")).where("problem is not null")


def metro_rows(df: DataFrame, state: str, metro: str, state_name: str = "State", metro_name: str = "Metro") -> DataFrame:
    """Rows of a wide series table whose state is the one asked for and whose metro area contains the text."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df.where((text(state_name) == state) & text(metro_name).contains(metro))


def wide_market_series(df: DataFrame, area_types: Sequence[str], first: str = "2021-01") -> DataFrame:
    """Wide monthly listing table (areaName, areaType, YYYY-MM columns) to long rows; blank cells stay as null."""
    months = [c for c in df.columns if re.match(r"^\d{4}-\d{2}$", c) and c >= first]
    slim = df.where(F.col("areaType").isin(*area_types)).select(
        "areaName", "areaType", *[F.nullif(F.col(f"`{m}`").cast("string"), F.lit("")).try_cast("double").alias(m) for m in months])
    return slim.unpivot(["areaName", "areaType"], [F.col(f"`{m}`") for m in months], "period", "value")


def read_crosswalk(df: DataFrame, key: str, fields: Sequence[str], order: Column) -> DataFrame:
    """Key to trimmed attributes; blank keys are skipped and the last row of a key wins."""
    k = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    slim = df.select(k.alias(key), *[F.trim(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields], order.alias("_o"))
    return first_per_key(slim.where(F.col(key) != ""), [key], F.desc("_o")).drop("_o")
