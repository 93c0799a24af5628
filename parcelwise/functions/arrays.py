"""Ordered lists and maps inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_reasons(first: Column, second: Column) -> Column:
    """Second list appended to the first without repeats, order kept."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")),
                                     F.coalesce(second, F.array().cast("array<string>"))))


def when_list(*pairs: tuple[Column, str | Column]) -> Column:
    """Texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, text if isinstance(text, Column) else F.lit(text))
                                     for cond, text in pairs]))


def fold_reasons(reasons: Column, stem: int = 48) -> Column:
    """Drop blanks and any reason that shares its first ``stem`` characters with an earlier one."""
    def key(text: Column) -> Column:
        return F.regexp_replace(F.lower(F.btrim(text)), r"\s+", " ")

    def step(kept: Column, text: Column) -> Column:
        k = key(text)
        seen = F.exists(
            kept,
            lambda s: (key(s) == k) | F.startswith(key(s), F.substring(k, 1, stem))
            | F.startswith(F.substring(k, 1, stem), F.substring(key(s), 1, stem)),
        )
        return F.when((k == "") | seen, kept).otherwise(F.concat(kept, F.array(F.btrim(text))))

    return F.aggregate(reasons, F.array().cast("array<string>"), step)


def keyed_lists(*pairs: tuple[Column, Column]) -> Column:
    """Map from id to its list, for example caveats by observation."""
    return F.create_map(*[c for pair in pairs for c in pair])


def split_names(c: Column, codes: dict[str, str], sep: str = "/") -> Column:
    """Composite name ``A/B`` to the codes of its known parts."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    lookup = F.create_map(*pairs)
    parts = F.split(F.upper(c), sep)
    return F.array_compact(F.transform(parts, lambda p: F.try_element_at(lookup, F.btrim(p))))
