"""Tables out of page text, pattern and wording scans, ranked search.

Texts are processed whole. Labels, patterns and queries are short argument lists, so they are applied inside
the row; no text is paired with another table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import rules, typed
from parcelwise.operators.ingest import first_reason
from parcelwise.operators.joins import first_per_key, top_per_key

# Row labels of a data page and the field each fills.
FIELD_LABELS = {
    "DEVELOPMENT NAME": "name_raw", "HUD AMP #": "hud_amp_raw", "TDS #": "tds_raw",
    "CONSOLIDATED TDS #": "consolidated_tds_raw", "PROGRAM": "program_raw", "# OF CURRENT UNITS": "current_units_raw",
    "NUMBER OF RENTAL ROOMS": "rental_rooms_raw", "AVG NO R/R PER UNIT": "avg_rr_raw",
    "AVG MONTHLY GROSS RENT": "avg_rent_raw", "BOROUGH": "borough_raw",
}

# Token shapes by kind.
TOKENS = {
    "hud_amp": r"(?i)NY\d{9}", "tds": r"\b\d{3}\b", "money": r"\$[\d,]+(?:\.\d+)?",
    "number": r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?",
    "program": r"(?i)FEDERAL|MIXED FINANCE/LLC1|MIXED FINANCE/LLC2|SECTION 8|STATE|CITY|PRIVATE",
    "borough": r"(?i)MANHATTAN|BRONX|BROOKLYN|QUEENS|STATEN ISLAND",
}

# Marks of a page that carries a data block, and the value band.
PAGE_MARKS = ("DEVELOPMENTS IN FULL OPERATION", "DEVELOPMENT NAME")
VALUE_HIGH = 5000

_GAP = r"[^\S\n]"  # white space inside a line


def _label_pattern(label: str, labels: Sequence[str]) -> str:
    """Line that starts with the label, unless a longer label starts it too. A period may stand before each gap and at the end."""
    between = rf"\.?{_GAP}+"
    spelled = {x: between.join(map(re.escape, x.split())) + r"\.?" for x in labels if x.startswith(label)}
    own = spelled.pop(label)
    return rf"(?mi)^{''.join(f'(?!{longer})' for longer in spelled.values())}{own}{_GAP}*(.*)$"


def page_fields(text: Column, labels: Mapping[str, str] = FIELD_LABELS) -> dict[str, Column]:
    """Rest of the last line that starts with each label; null when the page has no such line."""
    body = F.regexp_replace(text, r"\r\n?", "\n")
    out = {}
    for label, field in labels.items():
        found = F.regexp_extract_all(body, F.lit(_label_pattern(label, list(labels))), F.lit(1))
        out[field] = typed.strip(F.try_element_at(found, F.lit(-1)))
    return out


def tokens(c: Column, kind: str) -> Column:
    """All tokens of one kind; an empty list for a missing field."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKENS[kind]), F.lit(0))


def page_blocks(pages: DataFrame, page: str = "page_id", text: str = "text") -> DataFrame:
    """Data pages with their token lists and, when the block cannot be read, a reason.

    Pages without the marks and pages whose value columns are empty (templates) are left out.
    """
    marked = F.lit(True)
    for m in PAGE_MARKS:
        marked = marked & F.col(text).contains(m)
    header = F.split_part(F.col(text), F.lit("\n"), F.lit(1))
    fields = page_fields(F.col(text))
    df = pages.where(marked).select(page, rules.section_of(header).alias("section"), *[c.alias(f) for f, c in fields.items()])
    lists = {"tds": "tds_raw", "amp": "hud_amp_raw", "rent": "avg_rent_raw", "units": "current_units_raw",
             "rooms": "rental_rooms_raw", "rr": "avg_rr_raw", "program": "program_raw", "borough": "borough_raw"}
    kinds = {"tds": "tds", "amp": "hud_amp", "rent": "money", "units": "number", "rooms": "number", "rr": "number",
             "program": "program", "borough": "borough"}
    df = df.select("*", *[tokens(F.col(c), kinds[n]).alias(n) for n, c in lists.items()])
    n, no_field = F.size("tds"), F.col("tds_raw").isNull() | F.col("avg_rent_raw").isNull()
    template = F.when(no_field, (n == 0) & (F.size("rent") == 0)).otherwise(
        (n == 0) & (F.size("rent") == 0) & (F.size("amp") == 0))
    reason = first_reason(
        ("missing_key_field_rows", no_field), ("no_tds_tokens", n == 0),
        ("column_count_mismatch", (n != F.size("amp")) | (n != F.size("rent"))))
    return df.where(~template).withColumn("page_reason", reason)


def page_records(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """One row per column of each readable block: parallel token lists zipped by position.

    Optional lists that are shorter give nulls. ``reason`` is set for rows that go to quarantine.
    """
    lists = ("tds", "amp", "rent", "units", "rooms", "rr", "program", "borough")
    zipped = F.transform("tds", lambda t, i: F.struct(
        t.alias("tds"), *[F.get(F.col(c), i).alias(c) for c in lists[1:]]))
    rows = blocks.where("page_reason is null").select(page, "section", F.posexplode(zipped).alias("column_index", "r"))
    rent, units = typed.parse_money(F.col("r.rent")), typed.parse_whole(F.col("r.units"))
    rooms, rr = typed.parse_number(F.col("r.rooms")), typed.parse_number(F.col("r.rr"))
    out = rows.select(
        page, "section", "column_index", typed.plain_id(F.col("r.tds")).alias("key"),
        typed.upper_id(F.col("r.amp")).alias("hud_amp"), rent["value"].alias("value"),
        units["value"].alias("units"), rooms["value"].alias("rooms"), rr["value"].alias("rooms_per_unit"),
        typed.tidy_name(F.col("r.program")).alias("program"), F.upper(typed.tidy_name(F.col("r.borough"))).alias("borough"),
        (rent["bad"] | units["bad"] | rooms["bad"] | rr["bad"]).alias("_bad"),
    )
    confidence = rules.parse_confidence(F.col("hud_amp"), F.col("units"))
    reason = first_reason(
        ("parse_error", F.col("_bad")), ("missing_key_or_value", F.col("key").isNull() | F.col("value").isNull()),
        ("value_out_of_band", (F.col("value") <= 0) | (F.col("value") > VALUE_HIGH)),
        ("low_confidence_key_fields", F.col("confidence") == "low"))
    return out.withColumn("confidence", confidence).withColumn("reason", reason).drop("_bad")


def page_quarantine(blocks: DataFrame, records: DataFrame, page: str = "page_id") -> DataFrame:
    """Rejected pages and rejected columns in one table."""
    return blocks.where("page_reason is not null").select(
        page, F.lit(None).cast("int").alias("column_index"), F.lit(None).cast("string").alias("key"),
        F.col("page_reason").alias("reason")
    ).unionByName(records.where("reason is not null").select(page, "column_index", "key", "reason"))


def vintage(pages: DataFrame, pattern: str, fmt: str, default: str, order: str = "page_id", first: int | None = None) -> DataFrame:
    """Date found on the earliest page that has one, else the default. One row; ``first`` pages only when asked for."""
    early = pages if first is None else pages.orderBy(order).limit(first)
    found = F.try_to_date(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")), fmt)
    return early.agg(F.coalesce(F.min_by(found, F.when(found.isNotNull(), F.col(order))), F.lit(default).cast("date"))
                     .alias("vintage"))


@dataclass(frozen=True)
class TableSpec:
    """Where a table sits in a text and what its rows look like.

    ``row`` is matched per line; its groups fill ``columns``. ``start`` must occur exactly once; the table ends
    at ``end``. ``scope`` must occur in between. ``keys`` are the expected values of the first column, each
    exactly once; ``expected`` is the row count when keys are not listed. ``amounts`` are whole-number columns that
    must not be negative or unreadable; in each row the first of ``relation`` must be the sum of its others, by
    ``tolerance`` at most.
    """

    name: str
    start: str
    end: str
    row: str
    columns: tuple[str, ...]
    scope: str | None = None
    keys: tuple[str, ...] = ()
    expected: int | None = None
    amounts: tuple[str, ...] = ()
    relation: tuple[str, ...] = ()
    tolerance: int = 1


def scoped_table(texts: DataFrame, spec: TableSpec, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of one table out of many texts, and what is wrong with each text (empty when all is well).

    A text with any problem publishes no row at all.
    """
    parts = F.split(F.col(text), re.escape(spec.start))
    body = F.split_part(F.get(parts, 1), F.lit(spec.end), F.lit(1))
    tagged = texts.select(
        doc, (F.size(parts) - 1).alias("_starts"), F.coalesce(body, F.lit("")).alias("_body"))
    scope_ok = F.col("_body").contains(spec.scope) if spec.scope else F.lit(True)
    good = tagged.withColumn("_scope", scope_ok)
    lines = good.where("_starts = 1 and _scope").select(doc, F.posexplode(F.split("_body", "\n")).alias("line_no", "line"))
    pattern = spec.row
    rows = lines.where(F.col("line").rlike(pattern)).select(
        doc, "line_no", *[F.regexp_extract("line", pattern, i + 1).alias(c) for i, c in enumerate(spec.columns)])
    problems = good.select(doc, first_reason(
        ("start_marker_not_unique", F.col("_starts") != 1), ("missing_scope", ~F.col("_scope"))
    ).alias("problem")).where("problem is not null")
    accepted = good.where("_starts = 1 and _scope").select(doc)
    if spec.keys:
        k = spec.columns[0]
        want = accepted.withColumn(k, F.explode(F.lit(list(spec.keys))))
        have = rows.groupBy(doc, k).agg(F.count("*").alias("_n"))
        wrong = want.join(have, [doc, k], "left").where(F.coalesce("_n", F.lit(0)) != 1).select(
            doc, F.concat(F.lit("missing or duplicate row: "), F.col(k)).alias("problem"))
        problems = problems.unionByName(wrong)
    if spec.expected is not None:
        have = rows.groupBy(doc).agg(F.count("*").alias("_n"))
        wrong = accepted.join(have, doc, "left").where(F.coalesce("_n", F.lit(0)) != spec.expected).select(
            doc, F.lit(f"expected {spec.expected} rows").alias("problem"))
        problems = problems.unionByName(wrong)
    if spec.amounts or spec.relation:
        number = lambda c: whole_number(F.col(c))
        sound = F.lit(True)
        for c in {*spec.amounts, *spec.relation}:
            sound = sound & F.coalesce(number(c) >= 0, F.lit(False))
        holds = F.lit(True)
        if spec.relation:
            rest = number(spec.relation[1])
            for c in spec.relation[2:]:
                rest = rest + number(c)
            holds = F.coalesce(F.abs(number(spec.relation[0]) - rest) <= spec.tolerance, F.lit(False))
        first = F.col(spec.columns[0])
        broken = rows.select(doc, F.when(~sound, F.concat(F.lit("bad amount: "), first)).when(
            ~holds, F.concat(F.lit("amounts do not add up: "), first)).alias("problem")).where("problem is not null")
        problems = problems.unionByName(broken)
    return rows.join(problems.select(doc).distinct(), doc, "left_anti"), problems


def whole_number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("bigint")


def positional_cells(rows: DataFrame, ids: Sequence[str], cells: str, where: Mapping[int, tuple], names: Sequence[str]) -> DataFrame:
    """Text cells of a line to observation rows: position -> (category, period, ...) from a fixed lookup.

    ``N/A`` gives a null value with a reason.
    """
    look = F.array(*[F.struct(F.lit(i).alias("pos"), *[F.lit(v).alias(n) for v, n in zip(t, names, strict=True)])
                     for i, t in where.items()])
    parts = F.split(F.btrim(cells), r"\s+")
    out = rows.select(*ids, parts.alias("_p"), F.inline(look))
    cell = F.get("_p", F.col("pos"))
    return out.select(*ids, *names, whole_number(cell).alias("value"),
                      F.when(cell == "N/A", "no value published").when(cell.isNull(), "column missing").alias("unavailable_reason"))


# Scan rules (name -> pattern) for paths, secrets, credentials and provider tokens in texts.
SCAN_RULES = {
    "private_path": r"(?i)(/Users/[^\s\"'<>]+|/home/[^\s\"'<>]+|file://[^\s\"'<>]+|/private/var/[^\s\"'<>]+|/var/folders/[^\s\"'<>]+)",
    "secret": r"(?i)(api[_-]?key\s*[:=]\s*['\"][^'\"]+['\"]|secret\s*[:=]\s*['\"][^'\"]+['\"]|password\s*[:=]\s*['\"][^'\"]+['\"]|"
              r"sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})",
    "shared_credential": r"(?i)(Set-Cookie\s*:)",
    "provider_token": r"(?i)(mapbox[_-]?access[_-]?token|MAPBOX_TOKEN|pk\.[A-Za-z0-9_-]{20,}|maptiler[_-]?key|tiles\.mapbox\.com)",
}


# Excerpt lengths that differ from the usual one.
EXCERPTS = {"private_path": 80}


def pattern_scan(texts: DataFrame, patterns: Mapping[str, str], doc: str = "doc_id", text: str = "text", cuts: Mapping[str, int] = EXCERPTS, cut: int = 60) -> DataFrame:
    """Every match of every rule in every text, with an excerpt of the rule's length (``cut`` if not listed).

    One scan, no join.
    """
    per_rule = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("hits"))
        for n, p in patterns.items()])
    hits = texts.select(doc, F.inline(per_rule)).where(F.size("hits") > 0)
    length = F.lit(cut)
    for name, n in cuts.items():
        length = F.when(F.col("rule") == name, n).otherwise(length)
    return hits.select(doc, "rule", F.posexplode("hits").alias("hit_no", "_h")).select(
        doc, "rule", "hit_no", F.left("_h", length).alias("excerpt"))


# Causal wording, and the phrases that make a sentence harmless.
CAUSAL = (
    r"\bcaused? by\b", r"\bcaus(?:e|es|ed)\b", r"\bleads? to\b", r"\bresults? in\b", r"\bdue to\b", r"\bthe effect of\b",
    r"\bthe impact of\b",
)
LIMITING = (
    "not evidence", "not a cause", "not caused", "does not show", "does not establish", "cannot conclude",
    "cannot attribute", "no causal",
)
# Fixed value: sentence boundary.
SENTENCE_END = r"(?<=[.!?])\s+|[;\n]+"


def wording_problems(
    texts: DataFrame, ids: Sequence[str], text: str = "text", flagged: Sequence[str] = CAUSAL, limits: Sequence[str] = LIMITING
) -> DataFrame:
    """Sentences with a flagged phrase and no limiting phrase."""
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in flagged)
    s = F.col("sentence")
    excused = F.lit(False)
    for phrase in limits:
        excused = excused | F.lower(s).contains(phrase)
    out = texts.select(*ids, F.posexplode(F.split(F.col(text), SENTENCE_END)).alias("sentence_no", "sentence"))
    return out.where(s.rlike(pattern) & ~excused).withColumn("sentence", typed.strip(s))


def query_hits(df: DataFrame, queries: Sequence[str], score) -> DataFrame:
    """A row for each query that a row of ``df`` answers, with ``query`` and ``score``.

    The queries are a short list that travels with the plan; they are scored inside the row, and only hits become rows.
    ``score`` maps a query (normalised text q, digits, stripped text raw) to a number, null where it is no hit.
    """
    asked = F.array(*[F.struct(F.lit(x).alias("query"), typed.search_text(F.lit(x)).alias("q"), F.regexp_replace(F.lit(x), r"\D", "").alias("digits"),
                               typed.strip(F.lit(x)).alias("raw")) for x in queries])
    scored = F.transform(asked, lambda s: F.struct(s["query"].alias("query"), score(s["q"], s["digits"], s["raw"]).alias("score")))
    return df.select("*", F.explode(F.filter(scored, lambda h: h["score"] > 0)).alias("_hit")).select("*", "_hit.query", "_hit.score").drop("_hit")


def subject_texts(subjects: DataFrame) -> DataFrame:
    """Subjects with the normal forms that a search reads."""
    norm = typed.search_text
    base = subjects.select(
        "subject_id", "name", *[F.coalesce(c, F.lit("")).alias(c) for c in ("key", "code", "area")],
        norm(F.coalesce("name", F.lit(""))).alias("_n"),
        norm(F.concat_ws(" ", "name", "key", "code", "area", "program", F.col("subject_id").cast("string"),
                         F.coalesce("aliases", F.array().cast("array<string>")))).alias("_hay"))
    return base.select("*", *[norm(F.col(c)).alias(f"_{c}") for c in ("key", "code", "area")])


def subject_score(q: Column, digits: Column, raw: Column) -> Column:
    n = F.col("_n")
    key_hit = (F.col("key") != "") & ((F.col("key") == raw) | (F.col("_key") == q))
    points = (
        F.when(n == q, 100).when(F.startswith(n, q), 80).when(F.contains(n, q), 50).otherwise(0)
        + F.when(key_hit, 90).otherwise(0)
        + F.when((F.col("code") != "") & F.contains(F.col("_code"), q), 40).otherwise(0)
        + F.when(F.contains(F.col("_area"), q), 10).otherwise(0)
    )
    points = F.when((points == 0) & F.contains(F.col("_hay"), q), 5).otherwise(points)
    # a row counts only when the query occurs in its text, or equals its key
    seen = F.contains(F.col("_hay"), q) | F.startswith(n, q) | key_hit
    return F.when((q != "") & seen, points)


def ranked_subjects(hits: DataFrame, limit: int) -> DataFrame:
    return top_per_key(hits, ["query"], limit, F.desc("score"), F.col("name"), F.col("subject_id")).select(
        "query", "rank", "subject_id", "name", "score")


def search_subjects(subjects: DataFrame, queries: Sequence[str], limit: int = 12) -> DataFrame:
    """Ranked hits per query. ``subjects``: subject_id, name, key, code, area, program, aliases."""
    return ranked_subjects(query_hits(subject_texts(subjects), queries, subject_score), limit)


def area_texts(areas: DataFrame) -> DataFrame:
    """Areas with the normal forms that a search reads."""
    norm = typed.search_text
    return areas.select(
        "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("code", "name", "parent")],
        norm(F.coalesce("name", F.lit(""))).alias("_n"), norm(F.coalesce("code", F.lit(""))).alias("_c"),
        norm(F.concat_ws(" ", "code", "name", "parent")).alias("_hay"))


def area_score(q: Column, digits: Column, raw: Column) -> Column:
    n, kind, code = F.col("_n"), F.col("kind"), F.col("code")
    points = (
        F.when((kind == "borough") & (F.contains(n, q) | F.contains(q, n)), F.when(n == q, 90).otherwise(40))
        .when((kind == "zcta") & (F.length(digits) >= 3) & F.contains(code, digits), F.when(code == digits, 95).otherwise(70))
        .when((kind == "nta") & F.contains(F.col("_hay"), q),
              F.when(n == q, 85).when(F.startswith(n, q), 65).when(F.col("_c") == q, 80).otherwise(30))
        .when((kind == "tract") & (F.length(q) >= 4) & (F.contains(F.col("_hay"), q) | F.contains(code, raw)),
              F.when(code == raw, 88).otherwise(35))
    )
    return F.when(F.length(q) >= 2, points)


def ranked_areas(hits: DataFrame, limit: int) -> DataFrame:
    kind, code, name = F.col("kind"), F.col("code"), F.col("name")
    ident = F.concat(kind, F.lit(":"), F.when(kind == "borough", name).otherwise(code))
    label = (
        F.when(kind == "zcta", F.concat(F.lit("ZIP/ZCTA "), code))
        .when((kind == "tract") & (name != ""), F.concat(F.lit("Tract "), name))
        .when(name != "", name).otherwise(code))
    hits = hits.select("query", ident.alias("area_id"), "kind", label.alias("label"), "score")
    once = first_per_key(hits, ["query", "area_id"], F.desc("score"), F.col("label"))
    return top_per_key(once, ["query"], limit, F.desc("score"), F.col("label"), F.col("area_id")).select(
        "query", "rank", "area_id", "kind", "label", "score")


def search_areas(areas: DataFrame, queries: Sequence[str], limit: int = 8) -> DataFrame:
    """Ranked area hits per query over four kinds with their own scores and shortest query.

    ``areas``: kind (borough, zcta, nta, tract), code, name, parent.
    """
    return ranked_areas(query_hits(area_texts(areas), queries, area_score), limit)


def search_all(subjects: DataFrame, areas: DataFrame, limit: int = 14) -> DataFrame:
    """Subject hits before area hits, cut to the limit per query; both inputs are search results."""
    a = subjects.select("query", F.lit(0).alias("_s"), "rank", F.col("subject_id").cast("string").alias("id"),
                        F.col("name").alias("label"))
    b = areas.select("query", F.lit(1).alias("_s"), "rank", F.col("area_id").alias("id"), "label")
    return top_per_key(a.unionByName(b).withColumnRenamed("rank", "_r"), ["query"], limit, F.col("_s"), F.col("_r")).select(
        "query", "rank", "id", "label")
