"""Search by a table of queries finds what scoring every row for every query finds."""

import random

from parcelwise.operators import index
from parcelwise.operators import text as tx

SUBJECTS = "subject_id long, name string, key string, code string, area string, program string, aliases array<string>"
AREAS = "kind string, code string, name string, parent string"
ODD = ["", " ", "--", "a", "AB", " abc ", "no such text", "key-7", "7", "10-003", "x Alpha y", "b", "é", "alpha  beta", "code 3"]


def both(spark, search, table_search, rows, queries):
    ask = spark.createDataFrame([(q,) for q in [*queries, *queries[:3], None]], "query string")
    return sorted(map(tuple, search(rows, queries, 6).collect()), key=repr), sorted(map(tuple, table_search(rows, ask, 6).collect()), key=repr)


def test_subjects(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "abc", "gamma-ray", "x", "ab", "é1"])
    rows = [(i, f"{word()} {word()}", rng.choice([f"key-{i % 9}", "", None]), rng.choice([f"Code {i % 5}", None]), rng.choice([word(), None]), "P", rng.choice([[word()], [], None]))
            for i in range(150)]
    rows += [rows[0], rows[0], (None, None, None, None, None, None, None), (900, "", "", "", "", "", [])]
    df = spark.createDataFrame(rows, SUBJECTS)
    want, got = both(spark, tx.search_subjects, index.search_subjects, df, ODD + ["beta", "gamma", "key", "é1", "ab x"])
    assert want and got == want
    none = spark.createDataFrame([], "query string")
    assert index.search_subjects(df, none).count() == 0 and index.search_subjects(df.limit(0), none.union(df.select("name"))).count() == 0


def test_areas(spark):
    rows = [("borough", "", n, "") for n in ("Alpha", "B", "")] + [("zcta", str(10000 + i), "", "") for i in range(20)]
    rows += [("nta", f"N{i}", f"alpha beta {i}", "Alpha") for i in range(9)] + [("tract", f"12.{i}", None if i % 2 else str(i), "code 3") for i in range(20)]
    rows += [rows[4], (None, None, None, None)]
    want, got = both(spark, tx.search_areas, index.search_areas, spark.createDataFrame(rows, AREAS), ODD + ["12.5", "n3", "003", "Alpha beta"])
    assert want and got == want


def test_only_rows_with_the_rarest_gram_are_scored(spark):
    rows = index.row_key(spark.createDataFrame([(i, f"common text {i:04d}") for i in range(500)], "id long, t string"))
    ask = spark.createDataFrame([("q", "common text 0123")], "query string, _needle string")
    assert index.containing(ask, index.postings(rows, "t")).distinct().count() <= 11


def test_postings_are_dealt_and_never_broadcast(spark):
    # a small table makes many postings, which the size of its file does not show
    rows = spark.createDataFrame([(i, f"common text {i:04d}") for i in range(500)], "id long, t string")
    ask = spark.createDataFrame([("q", "common text 0123"), ("r", "ext")], "query string, _needle string")
    got = index.containing(ask, index.postings(rows, "t"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "Repartition" in plan
    assert got.where("query = 'r'").count() == 500 and got.columns == ["id", "t", "query", "_needle"]


def test_short_queries_meet_no_tracts(spark):
    rows = spark.createDataFrame([("tract", str(1000 + i), "", "") for i in range(50)] + [("nta", "N10", "x", "y")], AREAS)
    ask = spark.createDataFrame([("10",), ("1010",)], "query string")
    got = {(r.query, r.area_id) for r in index.search_areas(rows, ask).collect()}
    assert got == {("10", "nta:N10"), ("1010", "tract:1010")}
