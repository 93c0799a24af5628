"""Operator 7: Order MinHash fingerprints, by column expressions only.

The k-mers of a text are its runs of ``K`` units, each with the number of equal ones before it. A unit is a word between
single white-space characters; a word of more than ``LONG`` bytes (``SHORT_LONG`` in a text of fewer than ``FEW`` words) gives
one unit of ``GRAM`` code points for each of its code points instead, so a text without spaces has k-mers too. All are
hashed once; the hash deals them to ``BINS`` bins. In each bin the ``PICK`` smallest are selected and put in the order in
which they stand in the text, and that tuple is hashed: one entry of the fingerprint. Moving, repeating or replacing parts
of a text changes selections or their order; likeness is the share of bins with equal entries.

Everything but the search for the next document happens inside the row. The next document in descending id order is
found on ids alone (range partitions, and one head per partition); texts are dealt by id once, and each document's
opening code points go to the one that needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh

K = 2
BITS = 6
PICK = 2
PLACE = 28
DIGITS = 3
LONG = 12
SHORT_LONG = 4
FEW = 4
GRAM = 3
BLANK = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def units(words: str) -> Column:
    """Words, and instead of long ones the runs of code points that start in them; the cost is linear in the length."""
    cut = f"if(octet_length(w) > if(size({words}) < {FEW}, {SHORT_LONG}, {LONG}), split(w, ''), array(w))"
    later = ", ".join(f"get(u, i + {j})" for j in range(1, GRAM))
    return F.expr(f"flatten(transform(transform({words}, w -> {cut}), u -> if(size(u) > 1, transform(u, (c, i) -> concat_ws('', c, {later})), u)))")


def runs(words: str) -> Column:
    """Sorted array of hash and place of each k-mer, packed into one number each."""
    mask = -1 << PLACE
    later = ", ".join(f"get({words}, i + {j})" for j in range(1, K))
    return F.expr(f"sort_array(transform({words}, (w, i) -> (xxhash64(w, {later}) & {mask}L) | i))")


def numbered(packed: str) -> Column:
    """The same with the hash taken over k-mer and occurrence number (a binary search for the start of the equal ones)."""
    steps = ", ".join(str(1 << s) for s in range(PLACE - 1, -1, -1))
    same = f"shiftright(get({packed}, cast(j as int) - n - step), {PLACE}) = shiftright(x, {PLACE})"
    count = f"aggregate(array({steps}), 0, (n, step) -> if(j - n - step >= 0 and {same}, n + step, n))"
    before = f"if(j > 0 and shiftright(get({packed}, j - 1), {PLACE}) = shiftright(x, {PLACE}), {count}, 0)"
    high = (1 << 63) - (1 << PLACE)
    return F.expr(f"sort_array(transform({packed}, (x, j) -> (xxhash64(shiftright(x, {PLACE}), {before}) & {high}L) | (x & {(1 << PLACE) - 1}L)))")


def picked(packed: str) -> Column:
    """The PICK smallest of each bin."""
    shift = 63 - BITS
    return F.expr(f"filter({packed}, (y, j) -> j < {PICK} or shiftright(get({packed}, j - {PICK}), {shift}) <> shiftright(y, {shift}))")


def entries(chosen: str) -> Column:
    """One string per filled bin: the bin and the hash of its k-mers in text order."""
    shift = 63 - BITS
    hash_ = lambda y: f"shiftright({y}, {PLACE})"
    place = lambda y: f"({y} & {(1 << PLACE) - 1}L)"
    mate = f"get({chosen}, j + 1)"
    pair = f"if({place('y')} <= {place(mate)}, xxhash64({hash_('y')}, {hash_(mate)}), xxhash64({hash_(mate)}, {hash_('y')}))"
    value = f"if(j + 1 < size({chosen}) and shiftright({mate}, {shift}) = shiftright(y, {shift}), {pair}, xxhash64({hash_('y')}))"
    entry = f"concat(lpad(hex(shiftright(y, {shift})), 2, '0'), lpad(hex({value} & {16**DIGITS - 1}L), {DIGITS}, '0'))"
    first = f"j = 0 or shiftright(get({chosen}, j - 1), {shift}) <> shiftright(y, {shift})"
    return F.expr(f"array_compact(transform({chosen}, (y, j) -> if({first}, {entry}, null)))")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the entries of the fingerprint of a text column; each step is a column, so it is computed once."""
    df = df.withColumn("fp_words__", F.split(text, BLANK, -1))
    df = df.withColumn("fp_words__", units("fp_words__"))
    df = df.withColumn("fp_runs__", runs("fp_words__")).drop("fp_words__")
    df = df.withColumn("fp_numbered__", numbered("fp_runs__")).drop("fp_runs__")
    df = df.withColumn("fp_picked__", picked("fp_numbered__")).drop("fp_numbered__")
    return df.withColumn(name, entries("fp_picked__")).drop("fp_picked__")


def likeness(a: str, b: str) -> Column:
    """Equal entries among the bins that either has; each text has at least one."""
    bins = lambda c: F.transform(c, lambda e: F.substring(e, 1, 2))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))


def next_ids(docs: DataFrame) -> DataFrame:
    """(next_id, doc_id, need): the next smaller id of each id (of the smallest: the largest) and a third of its longest text."""
    spark = docs.sparkSession
    ids = sh.save(docs.groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 3)).alias("need")), "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sh.save(ids.repartitionByRange(parts, F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id"))))
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("part")
    follow = heads.select("part", F.coalesce(F.lead("head").over(order), F.max("head").over(Window.partitionBy())).alias("follow"))
    return inside.join(F.broadcast(follow), "part").select(F.coalesce("next_id", "follow").alias("next_id"), "doc_id", "need")


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every document with an id.

    edited: the text with its last third (whole code points, rounded down) replaced by as many from the start of the next
    document. A null text is empty; an empty text has the fingerprint of one empty word. Of documents with one id each
    gets a row, and as a next document the one with the largest text counts; a single document is its own next.
    """
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_fingerprint(docs, "text", "own")
    needs = next_ids(docs).withColumnRenamed("doc_id", "for_id")
    opening = F.struct(F.expr("substring(text, 1, cast(need as int))").alias("opening"), "own")
    given = own.join(needs, F.col("doc_id") == F.col("next_id")).groupBy("for_id").agg(F.max(opening).alias("given"))
    third = "cast(floor(char_length(text) / 3) as int)"
    edited = F.expr(f"concat(substring(text, 1, char_length(text) - {third}), substring(given.opening, 1, {third}))")
    both = own.join(given, F.col("doc_id") == F.col("for_id")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "own", F.col("given.own").alias("next_own"), edited.alias("edited"))
    both = with_fingerprint(both, "edited", "changed")
    return both.select(
        "doc_id", "n_chars", "edited", F.array_join("own", "").alias("fingerprint"), F.array_join("changed", "").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"))


def digest(compared: DataFrame) -> DataFrame:
    return compared.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
