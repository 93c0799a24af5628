"""Typed ingest: raw text rows become typed rows, or quarantine rows with the first reason that applies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import typed


class SchemaDrift(ValueError):
    """Required columns are missing."""


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaDrift(f"required columns missing: {missing}; present: {df.columns[:12]}")
    return df


# how each kind of field is read; ``parse`` kinds read the cleaned text and can be bad, ``text`` kinds cannot
PARSE = {"money": typed.money, "number": typed.number, "whole": typed.whole, "date": typed.date}
TEXT = {"id": typed.plain_id, "upper": typed.upper_id, "name": typed.tidy_name, "zip": typed.zip5}


def type_columns(raw: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add one typed column per field (name -> (kind, raw column)) and ``bad_fields``, the ones that failed.

    Cleaned texts, values and faults are columns one after the other, and the results leave through a generator: a later
    filter on them stays behind it, where it would otherwise be worked out from the raw texts once more for each rule.
    """
    parsed = [n for n, (kind, _) in fields.items() if kind in PARSE]
    texts = raw.select("*", *[typed.clean(F.col(fields[n][1])).alias(f"_text_{n}") for n in parsed])
    values = texts.select("*", *[
        (PARSE[kind](F.col(f"_text_{n}")) if kind in PARSE else TEXT[kind](F.col(source))).alias(f"_value_{n}") for n, (kind, source) in fields.items()])
    bad = [F.when(F.col(f"_text_{n}").isNotNull() & F.col(f"_value_{n}").isNull(), F.lit(n)) for n in parsed]
    row = F.struct(*[F.col(f"_value_{n}").alias(n) for n in fields],
                   (F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")).alias("bad_fields"))
    return values.select(*[F.col(f"`{c}`") for c in raw.columns], F.inline(F.array(row)))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule whose condition holds, null when the row is good."""
    out = F
    for name, cond in rules:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out.otherwise(F.lit(None).cast("string"))


def row_reason(name: str, key: str, date: str, value: str, low: float, high: float) -> Column:
    """The fixed order of row checks: parse, name, key, date, value, sign, band."""
    v = F.col(value)
    return F.when(
        F.size("bad_fields") > 0, F.concat(F.lit("parse_error: "), F.element_at("bad_fields", 1))
    ).otherwise(first_reason(
        ("missing_name", F.col(name).isNull()), ("missing_key", F.col(key).isNull()),
        ("missing_date", F.col(date).isNull()), ("missing_value", v.isNull()),
        ("non_positive_value", v <= 0), ("value_out_of_band", ~v.between(low, high)),
    ))


def quarantine_rows(flagged: DataFrame, row_id: str, raw: Sequence[str]) -> DataFrame:
    """Rejected rows with their reason and all raw fields in a map."""
    pairs = [x for c in raw for x in (F.lit(c), F.col(c))]
    return flagged.where("reason is not null").select(row_id, "reason", F.create_map(*pairs).alias("fields"))


def subject_and_observation(
    valid: DataFrame, subject: Sequence[str], observation: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """One typed record split into its subject row and its observation row."""
    return valid.select(*subject), valid.select(*observation)


def source_health(flagged: DataFrame) -> DataFrame:
    """Raw, valid and quarantined counts and the valid share (zero for an empty input)."""
    raw, valid = F.count("*"), F.count_if(F.col("reason").isNull())
    return flagged.agg(
        raw.alias("raw"), valid.alias("valid"), (raw - valid).alias("quarantined"),
        F.coalesce(F.try_divide(valid.cast("double"), raw.cast("double")), F.lit(0.0)).alias("valid_share"),
    )


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count per column and value in one scan; a missing or empty value is counted as UNKNOWN."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "field", "value")
    return long.groupBy("field", F.coalesce(F.nullif("value", F.lit("")), F.lit("UNKNOWN")).alias("value")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """One row of counts, one column per predicate."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in predicates.items()])
