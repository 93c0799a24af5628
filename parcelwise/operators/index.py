"""Search with a table of queries: an inverted index of character grams finds the rows worth scoring.

A text that contains a query contains all its grams, so the rows of its rarest gram are a superset of its hits, and
scoring them exactly gives the hits themselves. What a query costs is the length of that posting list, not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import typed
from parcelwise.operators import text as tx

GRAM = 3


def grams(text: str, shortest: int = 1) -> Column:
    """Distinct runs of ``shortest`` to ``GRAM`` characters of a text column."""
    runs = [f"if(char_length({text}) >= {n}, transform(sequence(1, char_length({text}) - {n - 1}), i -> substring({text}, i, {n})), array())" for n in range(shortest, GRAM + 1)]
    return F.expr(f"array_distinct(concat({', '.join(runs)}))")


def row_key(df: DataFrame) -> DataFrame:
    """Rows with a key of their content, for postings that are kept apart from the rows."""
    return df.withColumn("_row", F.xxhash64(*df.columns))


def postings(rows: DataFrame, text: str) -> DataFrame:
    """Every row once for each ``gram`` of its text; a null text has none. Rows are dealt out first: a small file is one task, and
    taking its texts apart is the work."""
    return rows.repartition(_parts(rows)).select("*", F.explode(grams(text)).alias("gram"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def asked(queries: DataFrame) -> DataFrame:
    """Each query once, with its search forms: ``_q`` normal form, ``_digits``, ``_raw``; null queries are left out."""
    x = F.col("query")
    return queries.where(x.isNotNull()).select("query").distinct().select(
        "query", typed.search_text(x).alias("_q"), F.regexp_replace(x, r"\D", "").alias("_digits"), typed.strip(x).alias("_raw"))


def rarest(needles: DataFrame, posted: DataFrame) -> DataFrame:
    """(query, gram): of each query's longest grams the one with the fewest rows; a gram no row has ends the search."""
    own = needles.where("_needle <> ''").select("query", F.explode(grams("_needle")).alias("gram"), F.least(F.char_length("_needle"), F.lit(GRAM)).alias("_len"))
    own = own.where(F.char_length("gram") == F.col("_len")).drop("_len")
    counts = with_gram_of(posted.select("gram"), own).groupBy("gram").agg(F.count("*").alias("_n"))
    best = own.join(counts, "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "gram")).alias("_best"))
    return best.where("_best._n > 0").select("query", "_best.gram")


def with_gram_of(posted: DataFrame, own: DataFrame) -> DataFrame:
    """Postings of the grams in ``own``. Normal forms have 37 characters, so there are at most 52,059 grams to broadcast."""
    return posted.join(F.broadcast(own.select("gram").distinct()), "gram", "left_semi")


def containing(needles: DataFrame, posted: DataFrame) -> DataFrame:
    """The rows that may contain the query's ``_needle``, with the columns of ``needles``; each row once for a query.

    Taken apart, a small file makes many postings, which the sizes of files do not show: neither side may be broadcast.
    The postings of a gram are dealt to as many tasks as there are.
    """
    best = rarest(needles, posted)
    salts = _parts(posted)
    asked_ = best.join(needles, "query").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = with_gram_of(posted, best).withColumn("_salt", F.pmod(F.xxhash64(*posted.columns), F.lit(salts)).cast("int"))
    return met.hint("merge").join(asked_, ["gram", "_salt"]).drop("gram", "_salt")


def contained(texts: DataFrame, text: str, needles: DataFrame) -> DataFrame:
    """The rows whose text may stand inside the query's ``_needle``: its first gram does. An empty text stands in every query."""
    heads = texts.withColumn("gram", F.substring(text, 1, GRAM))
    inside = needles.withColumn("gram", F.explode(F.array_append(grams("_needle"), F.lit(""))))
    return inside.join(heads, "gram").drop("gram")


def scored(candidates: DataFrame, score) -> DataFrame:
    """Rows that their queries hit, with the score."""
    return candidates.withColumn("score", score(F.col("_q"), F.col("_digits"), F.col("_raw"))).where("score > 0")


def search_subjects(subjects: DataFrame, queries: DataFrame, limit: int = 12) -> DataFrame:
    """As ``text.search_subjects``, for a table with a column ``query``; an empty query finds nothing."""
    needles = asked(queries).withColumn("_needle", F.col("_q"))
    found = containing(needles, postings(tx.subject_texts(subjects), "_hay"))
    return tx.ranked_subjects(scored(found, tx.subject_score), limit)


def search_areas(areas: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """As ``text.search_areas``, for a table with a column ``query``.

    Ways to a hit: the text has the query, a code has the query's digits, a borough's name stands in the query. Each kind is
    searched only by the queries that its score admits.
    """
    rows, asked_ = tx.area_texts(areas), asked(queries)
    q = asked_.withColumn("_needle", F.col("_q")).where(F.length("_q") >= 2)
    digits = asked_.where((F.length("_q") >= 2) & (F.length("_digits") >= 3)).withColumn("_needle", F.col("_digits"))
    found = containing(q, postings(rows.where("kind in ('borough', 'nta')"), "_hay"))
    found = found.unionByName(containing(q.where(F.length("_q") >= 4), postings(rows.where("kind = 'tract'"), "_hay")))
    found = found.unionByName(containing(digits, postings(rows.where("kind = 'zcta'"), "_hay")))
    # a borough that is found twice is one area
    found = found.unionByName(contained(rows.where("kind = 'borough'"), "_n", q))
    return tx.ranked_areas(scored(found, tx.area_score), limit)
