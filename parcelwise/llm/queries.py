"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelwise.llm import decontaminate, fingerprint, infill, language, lm, mixing, near_dedup, pii, quality, resample, suffix_dedup, toxicity, wrapper

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


#: All 50-byte strings of each text as hexadecimal digits; text cut at even places.
OP1_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents where doc_id is not null),
s as (select doc_id, unnest(range(0, greatest(length(h) // 2 - 49, 0))) p, h from d),
w as (select doc_id, p, hash(substr(h, 2 * p + 1, 100)) k from s),
home as (select k, min(doc_id) f from w group by k),
hit as (select doc_id, p from w join home using (k) where doc_id > f),
edge as (select *, p - lag(p) over o > 50 or lag(p) over o is null new from hit window o as (partition by doc_id order by p)),
grp as (select *, sum(new::int) over (partition by doc_id order by p) g from edge),
span as (select doc_id, g, min(p) a, max(p) + 50 b from grp group by all),
gap as (select doc_id, b, lead(a, 1, 1000000000) over (partition by doc_id order by a) nxt, a from span),
first as (select doc_id, min(a) a from span group by all),
kept as (select gap.doc_id, string_agg(substr(h, 2 * b + 1, 2 * (nxt - b)), '' order by b) t from gap join d using (doc_id) group by all),
n as (select doc_id, sum(b - a) r, count(*) c from span group by all)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(r, 0)::bigint n_removed, coalesce(c, 0)::bigint n_spans,
  sha256(case when r is null then unhex(h) else unhex(substr(h, 1, 2 * a) || t) end) kept_sha256
from d left join n using (doc_id) left join first using (doc_id) left join kept using (doc_id)
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.mark(documents(spark, sf_dir), items, ["doc_id"]))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
with d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bp as (select item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) p from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') k from bp),
dp as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from bw) where len(w) >= n),
dw as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') k from dp),
m as (select doc_id, item_id, p, n from dw join bw using (n, k)),
h as (select doc_id, count(distinct q) c from (select doc_id, unnest(range(p, p + n)) q from m) group by all),
i as (select doc_id, count(*) c, string_agg(item_id, ',' order by item_id) s
  from (select distinct doc_id, item_id::varchar item_id from m) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(h.c, 0)::bigint n_hit, coalesce(i.c, 0)::bigint n_items,
  sha256(coalesce(i.s, '')) items_sha256, coalesce(h.c, 0) > 0 contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(near_dedup.group(documents(spark, sf_dir)))


OP4_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') w from documents where doc_id is not null),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) k from w),
n as (select doc_id, count(*) n from s group by all),
x as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (k) where a.doc_id <> b.doc_id group by all),
e as (select a, b from x join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * c >= 85 * (na.n + nb.n - c)),
r as (select doc_id a, doc_id b from w union select r.a, e.b from r join e on r.b = e.a),
m as (select a doc_id, min(b) c from r group by all)
select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, c = doc_id kept from m left join n using (doc_id)
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir), ["doc_id"]))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn(documents(spark, sf_dir))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(fingerprint.compare(documents(spark, sf_dir)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 of each distinct word byte by byte, with the byte table made from the polynomial.
OP11_SQL = rf"""
with recursive bit as (select i, 0 k, i::bigint c from range(256) r(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bit where k < 8),
crc as (select i, c from bit where k = 8),
d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents where doc_id is not null),
f as (select doc_id, unnest(w) w from d),
g as (select unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from benchmark),
v as (select w, hex(encode(w)) h from (select w from f union select w from g)),
run as (select w, h, 0 p, 4294967295::bigint c from v
  union all select w, h, p + 1, xor(crc.c, run.c >> 8) from run join crc on crc.i = xor(run.c % 256, ('0x' || substr(h, 2 * p + 1, 2))::bigint)
  where p < length(h) // 2),
b as (select w, xor(c, 4294967295) % 10000 b from run where p = length(h) // 2),
s as (select b, count(*) s from f join b using (w) group by all),
t as (select b, count(*) t from g join b using (w) group by all),
n as (select (select coalesce(sum(s), 0) from s) sn, (select coalesce(sum(t), 0) from t) tn),
gain as (select distinct b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (sn + 10000) / ((coalesce(s, 0) + 1)::double * (tn + 10000)))) g
  from b left join s using (b) left join t using (b), n),
m as (select doc_id, floor(sum(g) / count(*))::bigint weight from f join b using (w) join gain using (b) group by all),
x as (select d.doc_id, len(w)::bigint n_features, coalesce(weight, 0) weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296))))::bigint score
  from d left join m using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) rank, count(*) over () c from x where n_features >= 20)
select x.doc_id, n_features, weight, score, case when rank <= c * 10 // 100 then rank end::bigint rank from x left join r using (doc_id)
"""


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.digest(wrapper.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"]))


#: SQL can't align trees; this reads the one article element that each of the given pages has.
OP12_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') t from pages),
b as (select page_id, url, regexp_split_to_array(t, '</?(?:p|h1)>') b from a),
c as (select page_id, url, list_transform(b, lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) b from b),
d as (select page_id, url, list_transform(b, lambda x: replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) b from c),
e as (select page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(regexp_replace(x, '&amp$', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') b from d)
select page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') "text", length(coalesce(array_to_string(b, chr(10) || chr(10)), ''))::bigint n_chars from e
"""


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(documents(spark, sf_dir), ["doc_id"]))


OP13_SQL = r"""
with t as (select doc_id, coalesce(text, '') x, sha256('42:' || doc_id::varchar) h from documents),
u as (select *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') w,
  [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in range(4)] d from t),
k as (select *, len(w) n, least(d[1] % (len(w) + 1), d[2] % (len(w) + 1)) a, greatest(d[1] % (len(w) + 1), d[2] % (len(w) + 1)) b,
  case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or d[3] is null or d[3] % 100 >= 50 then 'plain'
    when d[4] % 100 < 80 then 'spm' else 'psm' end form from u),
c as (select *, array_to_string(w[1:a], '') p, array_to_string(w[a + 1:b], '') m, array_to_string(w[b + 1:], '') s from k)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end::bigint prefix_chars,
  case when form <> 'plain' then length(m) end::bigint middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else x end) output_sha256,
  sha256(x) restored_sha256 from c
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_decontaminate": op2_decontaminate, "op3_lm_score": op3_lm_score, "op4_near_dedup": op4_near_dedup, "op5_pii": op5_pii, "op6_mixing": op6_mixing, "op7_fingerprint": op7_fingerprint, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality,
           "op10_language_id": op10_language_id, "op11_resample": op11_resample, "op12_html_text": op12_html_text, "op13_infill": op13_infill, "pipeline": pipeline}
SQL = {"op1_suffix_dedup": OP1_SQL, "op2_decontaminate": OP2_SQL, "op4_near_dedup": OP4_SQL, "op11_resample": OP11_SQL, "op12_html_text": OP12_SQL, "op13_infill": OP13_SQL}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
