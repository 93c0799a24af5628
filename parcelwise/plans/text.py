"""Text jobs: page tables, scoped tables, scans and search over texts derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import typed
from parcelwise.operators import index
from parcelwise.operators import text as tx
from parcelwise.plans.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

# ---- data pages: five parts per page -----------------------------------------------------------------


def pages(spark, sf) -> DataFrame:
    """Page texts with parallel value lists; some lack rows, some miscount, some are templates."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    cells = p.select(
        (k - k % 5).alias("first"), F.struct(
            k.alias("k"), F.lpad((k % 1000).cast("string"), 3, "0").alias("tds"), F.concat(F.lit("NY"), F.lpad(k.cast("string"), 9, "0")).alias("amp"),
            F.concat(F.lit("$"), F.format_number(k * 37 % 6000, 0)).alias("rent"), F.format_number(k + 900, 0).alias("units"),
            F.concat((k % 300).cast("string"), F.lit(".5")).alias("rooms"), F.when(k % 2 == 0, "FEDERAL").otherwise("Section 8").alias("program"),
            F.when(k % 3 == 0, "QUEENS").otherwise("STATEN ISLAND").alias("borough")).alias("c"))
    # at most five parts per page
    g = cells.groupBy((F.col("first") / 5).cast("bigint").alias("page_id")).agg(F.sort_array(F.collect_list("c")).alias("cs"))

    def joined(field, when=None):
        values = F.transform("cs", lambda c: c[field])
        return F.array_join(F.slice(values, 2, 9) if when == "short" else values, " ")

    n = F.col("page_id")
    amp = F.when(n % 7 == 0, joined("amp", "short")).otherwise(joined("amp"))
    line = lambda label, c: F.concat(F.lit(label + " "), c)
    full = F.concat_ws(
        "\n", F.when(n % 4 == 0, "LLC DEVELOPMENTS IN FULL OPERATION").otherwise("DEVELOPMENTS IN FULL OPERATION"),
        F.lit("DEVELOPMENT NAME a b c"), line("HUD AMP #", amp), line("TDS #", joined("tds")), F.lit("CONSOLIDATED TDS # 999 998"),
        line("Program", joined("program")), F.when(n % 5 != 0, line("# OF CURRENT UNITS", joined("units"))),
        line("NUMBER OF RENTAL ROOMS", joined("rooms")), F.when(n % 11 != 0, line("AVG. MONTHLY GROSS RENT", joined("rent"))),
        line("BOROUGH", joined("borough")))
    template = F.lit("DEVELOPMENTS IN FULL OPERATION\nDEVELOPMENT NAME\nTDS #\nAVG. MONTHLY GROSS RENT\nHUD AMP #")
    return g.select("page_id", F.when(n % 13 == 0, template).otherwise(full).alias("text"))


_PAGES = """
    pg as (select (p_partkey - p_partkey % 5) // 5 as page_id, p_partkey as k, p_partkey % 5 as i,
                  min(p_partkey) over (partition by (p_partkey - p_partkey % 5) // 5) as k0 from part),
    head as (select distinct page_id from pg where page_id % 13 <> 0)"""


@R.add("q_page_fields", f"""with {_PAGES}
    select page_id, case when page_id % 4 = 0 then 'secondary' else 'primary' end as section, '999 998' as consolidated,
           string_agg(lpad((k % 1000)::varchar, 3, '0'), ' ' order by k) as tds,
           case when page_id % 11 <> 0 then count(*) end as rents, case when page_id % 5 <> 0 then count(*) end as units
    from pg where page_id % 13 <> 0 group by 1""")
def _(spark, sf):
    b = tx.page_blocks(pages(spark, sf))
    sized = lambda raw, toks: F.when(F.col(raw).isNotNull(), F.size(toks)).cast("bigint")
    return b.select("page_id", "section", F.col("consolidated_tds_raw").alias("consolidated"), F.col("tds_raw").alias("tds"),
                    sized("avg_rent_raw", "rent").alias("rents"), sized("current_units_raw", "units").alias("units"))


@R.add("q_page_records", f"""with {_PAGES}
    select page_id, i as column_index, (k % 1000)::varchar as key, 'NY' || lpad(k::varchar, 9, '0') as hud_amp, (k * 37 % 6000)::double as value,
           case when page_id % 5 <> 0 then k + 900 end as units, (k % 300 + 0.5)::double as rooms, case when k % 2 = 0 then 'FEDERAL' else 'Section 8' end as program,
           case when k % 3 = 0 then 'QUEENS' else 'STATEN ISLAND' end as borough, case when page_id % 5 = 0 then 'medium' else 'high' end as confidence,
           case when k * 37 % 6000 = 0 or k * 37 % 6000 > 5000 then 'value_out_of_band' end as reason
    from pg where page_id % 13 <> 0 and page_id % 11 <> 0 and page_id % 7 <> 0""")
def _(spark, sf):
    r = tx.page_records(tx.page_blocks(pages(spark, sf)))
    return r.select("page_id", F.col("column_index").cast("bigint").alias("column_index"), "key", "hud_amp", "value", "units", "rooms", "program",
                    "borough", "confidence", "reason")


@R.add("q_page_quarantine", f"""with {_PAGES}
    select page_id, null::bigint as column_index, null as key, case when page_id % 11 = 0 then 'missing_key_field_rows' else 'column_count_mismatch' end as reason
    from head where page_id % 11 = 0 or page_id % 7 = 0
    union all select page_id, i, (k % 1000)::varchar, 'value_out_of_band' from pg
    where page_id % 13 <> 0 and page_id % 11 <> 0 and page_id % 7 <> 0 and (k * 37 % 6000 = 0 or k * 37 % 6000 > 5000)""")
def _(spark, sf):
    b = tx.page_blocks(pages(spark, sf))
    q = tx.page_quarantine(b, tx.page_records(b))
    return q.withColumn("column_index", F.col("column_index").cast("bigint"))


# ---- scoped tables: one report per nation ------------------------------------------------------------

_KEYS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def reports(spark, sf) -> DataFrame:
    """A report text per nation with a table of order counts per priority; some reports are faulty."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = F.col("c_nationkey")
    per = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", "o_orderpriority").agg(F.count("*").alias("cnt"))
    per = per.where(~((n % 5 == 3) & (F.col("o_orderpriority") == "5-LOW")))
    money = lambda x: F.concat(F.lit(" $"), F.format_number(x, 0))
    row = F.concat(F.lit("  "), "o_orderpriority", F.lit("  8.1 "), money(F.col("cnt") * 370), money(F.col("cnt") * 300),
                   money(F.col("cnt") * 70 + F.when(n % 4 == 0, 5).otherwise(0)), F.lit(" "))
    # five rows per nation
    body = per.select("c_nationkey", row.alias("row")).groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("row")), "\n").alias("rows"))
    title = F.lit("Table 5: Benefit by Priority (2024)")
    scope = F.when(n % 6 == 1, "All programs").otherwise("Excluding Other Benefits")
    return body.select(F.col("c_nationkey").alias("doc_id"), F.concat_ws(
        "\n", F.lit("Intro text 1-URGENT 9.9 $1 $1 $1"), title, scope, "rows", F.lit("Chart 1 illustrates"), F.when(n % 7 == 2, title), F.lit("end")).alias("text"))


SPEC = tx.TableSpec(
    name="benefit", start="Table 5: Benefit by Priority (2024)", end="Chart 1 illustrates",
    row=r"^\s*(1-URGENT|2-HIGH|3-MEDIUM|4-NOT SPECIFIED|5-LOW)\s+(\d+\.\d+)\s+\$([\d,]+)\s+\$([\d,]+)\s+\$([\d,]+)\s*$",
    columns=("name", "years", "current", "frozen", "benefit"), scope="Excluding Other Benefits", keys=_KEYS,
    amounts=("current", "frozen", "benefit"), relation=("current", "frozen", "benefit"))

_REPORTS = """
    cnt as (select c_nationkey as doc_id, o_orderpriority as name, count(*) as n from orders join customer on o_custkey = c_custkey
            where not (c_nationkey % 5 = 3 and o_orderpriority = '5-LOW') group by all),
    doc as (select distinct doc_id from cnt),
    failed as (select doc_id from doc where doc_id % 7 = 2 or doc_id % 6 = 1 or doc_id % 4 = 0 or (select count(*) from cnt where cnt.doc_id = doc.doc_id) < 5)"""


@R.add("q_scoped_table", f"""with {_REPORTS}
    select doc_id, name, n * 370 as current, n * 300 as frozen, n * 70 as benefit from cnt where doc_id not in (select doc_id from failed)""")
def _(spark, sf):
    rows, _problems = tx.scoped_table(reports(spark, sf), SPEC)
    return rows.select("doc_id", "name", *[tx.whole_number(F.col(c)).alias(c) for c in ("current", "frozen", "benefit")])


@R.add("q_scoped_table_problems", f"""with {_REPORTS}, keys as (select unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) as name)
    select doc_id, 'start_marker_not_unique' as problem from doc where doc_id % 7 = 2
    union all select doc_id, 'missing_scope' from doc where doc_id % 7 <> 2 and doc_id % 6 = 1
    union all select doc_id, 'missing or duplicate row: ' || name from doc, keys where doc_id % 7 <> 2 and doc_id % 6 <> 1
      and not exists (select 1 from cnt where cnt.doc_id = doc.doc_id and cnt.name = keys.name)
    union all select doc_id, 'amounts do not add up: ' || name from cnt where doc_id % 7 <> 2 and doc_id % 6 <> 1 and doc_id % 4 = 0""")
def _(spark, sf):
    return tx.scoped_table(reports(spark, sf), SPEC)[1]


@R.add("q_admin_series", """
    with y as (select c_nationkey as doc_id, year(o_orderdate) as yr, count(*) as n from orders join customer on o_custkey = c_custkey
               where year(o_orderdate) between 1996 and 2000 group by all)
    select doc_id, 'FY' || yr as period, n as value from y where doc_id in (select doc_id from y group by 1 having count(*) = 5)""")
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    per = o.where("year(o_orderdate) between 1996 and 2000").join(c, o.o_custkey == c.c_custkey).groupBy(
        F.col("c_nationkey").alias("doc_id"), F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    line = per.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("yr", F.format_number("n", 0).alias("t")))).alias("s"))  # five years
    line = line.select("doc_id", F.concat(F.lit("Cases receiving subsidy "), F.array_join(F.transform("s", lambda x: x["t"]), " "), F.lit(" up 12.5% or 3.4")).alias("line"))
    ints = line.select("doc_id", typed.integers(F.col("line")).alias("ints")).where(F.size("ints") == 5)
    years = F.lit([f"FY{y}" for y in range(1996, 2001)])
    return ints.select("doc_id", F.inline(F.arrays_zip(years.alias("period"), F.col("ints").alias("value"))))


@R.add("q_positional_cells", """
    with s as (select n_regionkey as r, c_mktsegment as seg, count(*) as n from customer join nation on c_nationkey = n_nationkey group by all),
    g as (select x.r, x.seg, n from (select r, seg from (select distinct r from s), (select unnest(['AUTOMOBILE','BUILDING','FURNITURE']) as seg)) x
          left join s on s.r = x.r and s.seg = x.seg)
    select r, seg as segment, '2026-07' as period, case when coalesce(n, 0) % 3 <> 0 then n end as value,
           case when coalesce(n, 0) % 3 = 0 then 'no value published' end as unavailable_reason from g""")
def _(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
    wide = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("r")).pivot("c_mktsegment", segs).count()
    cell = lambda s: F.when(F.coalesce(s, F.lit(0)) % 3 == 0, "N/A").otherwise(F.format_number(F.col(s), 0))
    line = wide.select("r", F.concat_ws("   ", *[cell(s) for s in segs]).alias("cells"))
    where = {i: (s, "2026-07") for i, s in enumerate(segs)}
    return tx.positional_cells(line, ["r"], "cells", where, ["segment", "period"])


CEILINGS = tx.TableSpec(
    name="ceilings", start="PAYMENT STANDARDS", end="END", row=r"^\s*(\d+(?: or \d+)?)\s+(SRO|Studio|\d+)\s+\$([\d,]+)\s+\$([\d,]+)",
    columns=("family_size", "bedrooms", "old", "new"), expected=10)


def ceiling_texts(spark, sf) -> DataFrame:
    """Ten rows per nation (nine for some), amounts from the nation's customer count."""
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.count("*").alias("n"))
    i = F.col("i")
    rows = per.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 9 == 0, 9).otherwise(10))))
    size = F.when(i == 1, "1 or 2").otherwise(i.cast("string"))
    beds = F.when(i == 1, "SRO").when(i == 2, "Studio").otherwise((i - 2).cast("string"))
    row = F.concat(F.lit("  "), size, F.lit("   "), beds, F.lit("  $"), F.format_number(F.col("n") * i * 10, 0), F.lit("  $"), F.format_number(F.col("n") * i * 11, 0))
    return rows.select("doc_id", F.struct("i", row.alias("row")).alias("s")).groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("s")).select(
        "doc_id", F.concat_ws("\n", F.lit("PAYMENT STANDARDS"), F.array_join(F.transform("s", lambda x: x["row"]), "\n"), F.lit("END")).alias("text"))


@R.add("q_ceiling_rows", """
    select c_nationkey as doc_id, case when i = 1 then '1 or 2' else i::varchar end as family_size,
           case when i = 1 then 'SRO' when i = 2 then 'Studio' else (i - 2)::varchar end as bedrooms, n * i * 10 as old, n * i * 11 as new
    from (select c_nationkey, count(*) as n from customer group by 1), range(1, 11) t(i) where c_nationkey % 9 <> 0""")
def _(spark, sf):
    rows, _problems = tx.scoped_table(ceiling_texts(spark, sf), CEILINGS)
    return rows.select("doc_id", "family_size", "bedrooms", tx.whole_number(F.col("old")).alias("old"), tx.whole_number(F.col("new")).alias("new"))


@R.add("q_ceiling_problems", "select distinct c_nationkey as doc_id, 'expected 10 rows' as problem from customer where c_nationkey % 9 = 0")
def _(spark, sf):
    return tx.scoped_table(ceiling_texts(spark, sf), CEILINGS)[1]


@R.add("q_vintage", "select (date '2026-01-01' + (min(o_orderkey) filter (where o_orderkey % 500 = 302))::int)::date as vintage from orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    day = F.date_add(F.lit("2026-01-01").cast("date"), k.cast("int"))
    body = F.when(k % 500 == 302, F.concat(F.lit("Data as of "), F.date_format(day, "yyyy-MM-dd"), F.lit("."))).otherwise("Preface")
    pages_ = table(spark, sf, "orders").select(k.alias("page_id"), body.alias("text"))
    return tx.vintage(pages_, r"as of (\d{4}-\d{2}-\d{2})", "yyyy-MM-dd", "2025-01-01")


# ---- scans -------------------------------------------------------------------------------------------

# fixed values of this query: rules that find what these texts contain, beside the default rules
_RULES = {"token": r"token\s*=\s*\"[0-9a-f]{40}\"", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", **tx.SCAN_RULES}


@R.add("q_pattern_scan", "select doc_id, rule, i - 1 as hit_no, left(hits[i], case when rule = 'private_path' then 80 else 60 end) as excerpt from (" + " union all ".join(
    f"select doc_id, '{n}' as rule, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}') as hits from documents" for n, p in _RULES.items())
    + ") t, lateral (select unnest(range(1, len(hits) + 1)) as i) u")
def _(spark, sf):
    return tx.pattern_scan(table(spark, sf, "documents"), _RULES).withColumn("hit_no", F.col("hit_no").cast("bigint"))


_FLAGGED, _LIMITS = ("(?: |^)that ", " from "), (" is ",)


@R.add("q_wording_check", r"""
    with s as (select conv_id, turn, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[;\n]+')) as s from conversations)
    select conv_id, turn, regexp_replace(s, '^\s+|\s+$', '', 'g') as sentence from s where regexp_matches(s, '(?i)(?: |^)that | from ') and lower(s) not like '% is %'""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    return tx.wording_problems(c, ["conv_id", "turn"], flagged=_FLAGGED, limits=_LIMITS).drop("sentence_no")


# ---- search ------------------------------------------------------------------------------------------

_QUERIES = ["hot rod", "HOT", "brand 11", "7", " 12 ", "economy", "zzz", "ring"]


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


_SUBJ = f"""
    qs as (select unnest({_QUERIES}) as query), q as (select query, {_norm('query')} as q from qs),
    sb as (select p_partkey as subject_id, p_name as name, p_partkey::varchar as key, p_brand as code, p_type as area, {_norm('p_name')} as n,
                  {_norm("concat_ws(' ', p_name, p_partkey, p_brand, p_type, p_partkey)")} as hay from part),
    sc as (select query, subject_id, name,
        case when n = q then 100 when starts_with(n, q) then 80 when contains(n, q) then 50 else 0 end
        + case when key = trim(query) or key = q then 90 else 0 end + case when contains({_norm('code')}, q) then 40 else 0 end
        + case when contains({_norm('area')}, q) then 10 else 0 end as s0, contains(hay, q) as inhay, key = trim(query) or key = q as keyhit from sb, q),
    hits as (select query, subject_id, name, case when s0 = 0 and inhay then 5 else s0 end as score from sc where inhay or keyhit),
    subj_hits as (select query, row_number() over (partition by query order by score desc, name, subject_id) as rank, subject_id, name, score from hits where score > 0)"""


def part_subjects(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("subject_id"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("code"),
        F.col("p_type").alias("area"), F.lit(None).cast("string").alias("program"), F.lit(None).cast("array<string>").alias("aliases"))


def search_parts(spark, sf, limit: int = 12) -> DataFrame:
    return tx.search_subjects(part_subjects(spark, sf), _QUERIES, limit)


@R.add("q_search_subjects", f"with {_SUBJ} select * from subj_hits where rank <= 12")
def _(spark, sf):
    return search_parts(spark, sf)


_AREA_QUERIES = ["asia", "united", "1000", "10003", "a", "1000012", "middle east", "brand 1", "n12"]

_AREAS = f"""
    ars as (select 'borough' as kind, '' as code, r_name as name, '' as parent from region
      union all select 'nta', 'N' || n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey
      union all select 'zcta', (10000 + s_suppkey)::varchar, '', '' from supplier
      union all select 'tract', (1000000 + p_partkey)::varchar, case when p_partkey % 2 = 0 then p_size::varchar else '' end, p_brand from part),
    aq as (select query, {_norm('query')} as q, regexp_replace(query, '[^0-9]', '', 'g') as digits, trim(query) as raw from (select unnest({_AREA_QUERIES}) as query)),
    a1 as (select *, {_norm('name')} as n, {_norm('code')} as c, {_norm("concat_ws(' ', code, name, parent)")} as hay from ars),
    a2 as (select query, kind, code, name, case
        when kind = 'borough' and (contains(n, q) or contains(q, n)) then case when n = q then 90 else 40 end
        when kind = 'zcta' and length(digits) >= 3 and contains(code, digits) then case when code = digits then 95 else 70 end
        when kind = 'nta' and contains(hay, q) then case when n = q then 85 when starts_with(n, q) then 65 when c = q then 80 else 30 end
        when kind = 'tract' and length(q) >= 4 and (contains(hay, q) or contains(code, raw)) then case when code = raw then 88 else 35 end end as score
      from a1, aq where length(q) >= 2),
    area_hits as (select query, row_number() over (partition by query order by score desc, label, area_id) as rank, area_id, kind, label, score from (
      select query, kind || ':' || case when kind = 'borough' then name else code end as area_id, kind,
             case when kind = 'zcta' then 'ZIP/ZCTA ' || code when kind = 'tract' and name <> '' then 'Tract ' || name when name <> '' then name else code end as label, score
      from a2 where score is not null))"""


def area_rows(spark, sf) -> DataFrame:
    r, n, s, p = (table(spark, sf, t) for t in ("region", "nation", "supplier", "part"))
    e = F.lit("")
    rows = [r.select(F.lit("borough").alias("kind"), e.alias("code"), F.col("r_name").alias("name"), e.alias("parent")),
            n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("nta"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), "n_name", "r_name"),
            s.select(F.lit("zcta"), (F.col("s_suppkey") + 10000).cast("string"), e, e),
            p.select(F.lit("tract"), (F.col("p_partkey") + 1000000).cast("string"),
                     F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(""), "p_brand")]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def search_regions(spark, sf, queries=_AREA_QUERIES, limit: int = 8) -> DataFrame:
    return tx.search_areas(area_rows(spark, sf), queries, limit)


@R.add("q_search_areas", f"with {_AREAS} select * from area_hits where rank <= 8")
def _(spark, sf):
    return search_regions(spark, sf)


@R.add("q_search_all", f"""with {_SUBJ}, {_AREAS.replace(str(_AREA_QUERIES), str(_QUERIES))}
    select query, row_number() over (partition by query order by s, rank) as rank, id, label from (
      select query, 0 as s, rank, subject_id::varchar as id, name as label from subj_hits where rank <= 14
      union all select query, 1, rank, area_id, label from area_hits where rank <= 14) qualify rank <= 14""".replace(
    "row_number() over (partition by query order by s, rank) as rank, id", "row_number() over (partition by query order by s, r) as rank, id").replace(
    "0 as s, rank,", "0 as s, rank as r,"))
def _(spark, sf):
    return tx.search_all(search_parts(spark, sf, 14), search_regions(spark, sf, _QUERIES, 14))


# every type, brand, size and word of a part name is a query, and every nation with its key behind and region with a word before it
_TABLE_QUERIES = """tq as (select distinct query from (select p_type as query from part union all select p_brand from part
    union all select unnest(string_split(p_name, ' ')) from part union all select p_size::varchar from part
    union all select n_name || ' ' || n_nationkey from nation union all select 'near ' || r_name from region) where query is not null)"""


def table_queries(spark, sf) -> DataFrame:
    p, n, r = (table(spark, sf, t) for t in ("part", "nation", "region"))
    texts = [p.select(F.explode(F.array_append(F.array_append(F.split("p_name", " "), F.col("p_type")), F.col("p_brand"))).alias("query")),
             p.select(F.col("p_size").cast("string")), n.select(F.concat_ws(" ", "n_name", "n_nationkey")), r.select(F.concat(F.lit("near "), "r_name"))]
    return texts[0].union(texts[1]).union(texts[2]).union(texts[3])


def _from_table(sql: str, queries: list[str]) -> str:
    return sql.replace(f"select unnest({queries}) as query", "select query from tq")


@R.add("q_search_table", f"with {_TABLE_QUERIES}, {_from_table(_SUBJ, _QUERIES)} select * from subj_hits where rank <= 12")
def _(spark, sf):
    return index.search_subjects(part_subjects(spark, sf), table_queries(spark, sf))


@R.add("q_search_area_table", f"with {_TABLE_QUERIES}, {_from_table(_AREAS, _AREA_QUERIES)} select * from area_hits where rank <= 8")
def _(spark, sf):
    return index.search_areas(area_rows(spark, sf), table_queries(spark, sf))
