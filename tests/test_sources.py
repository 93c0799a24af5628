"""Readers and writers on files the tests write themselves."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import ingest, series
from parcelwise.sources import geojson, receipts, sinks, tabular


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv(spark, tmp_path):
    df = tabular.read_csv(spark, put(tmp_path / "a.csv", "﻿ID , NAME\n1,x\n2,\n"), empty_for_null=True)
    assert df.columns == ["ID", "NAME"] and [tuple(r) for r in df.collect()] == [("1", "x"), ("2", "")]
    with pytest.raises(ingest.SchemaDrift):
        ingest.require_columns(df, ["ID", "RENT"])


def test_headers():
    cols = ["ZIP\nCode", "SAFMR0BR - 90%", "HUD Area  Code"]
    assert tabular.find_column(cols, "ZIP Code") == "ZIP\nCode"
    assert tabular.find_column(cols, "HUD Area Code") == "HUD Area  Code"
    assert tabular.find_column(cols, "SAFMR 0BR", prefix=True) == "SAFMR0BR - 90%"
    with pytest.raises(KeyError):
        tabular.find_column(cols, "SAFMR 1BR")


def test_limits(spark):
    df = spark.createDataFrame([("501", "A1", "New York, NY", "1998.5", "x"), ("10011", "A1", "New York, NY", "0", "2500.5"), ("9", "B", "Elsewhere", "1", "1")],
                               "`ZIP Code` string, `Code` string, `Area` string, `SAFMR 0BR` string, `SAFMR 1BR` string")
    got = tabular.bedroom_limits(df, "ZIP Code", "Area", "Code", "SAFMR", "New York", bedrooms=(0, 1))
    assert {(r["zip"], r["bedroom"], r["value"]) for r in got.collect()} == {("00501", 0, 1998), ("10011", 1, 2500)}
    assert {r["zip"]: r["bedrooms"] for r in tabular.bedroom_maps(got).collect()} == {"00501": {"0": 1998}, "10011": {"1": 2500}}


def test_program_rows(spark):
    df = spark.createDataFrame([("36005", "3", "TBV, All", "10", "-4"), ("36005", "9", "x", "1", "1"), ("99", "3", "TBV, All", "1", "1")],
                               "code string, program string, sub string, units string, rent string")
    got = tabular.program_rows(df, "code", {"36005": "bronx"}, {("3", "TBV, All"): "voucher"}, ("program", "sub"), ["units", "rent"])
    assert {(r["geography_id"], r["statistic"], r["value"], r["source_value"], r["unavailable_reason"]) for r in got.collect()} == {
        ("bronx", "units", 10.0, 10.0, None), ("bronx", "rent", None, -4.0, "missing or suppressed code")}


def test_wide_series(spark):
    df = spark.createDataFrame([("Bronx", "borough", "1", "", "3"), ("Harlem", "hood", "1", "2", "3")], "areaName string, areaType string, `2020-12` string, `2021-01` string, `2021-02` string")
    got = tabular.wide_market_series(df, ["borough", "city"])
    assert {(r["areaName"], r["period"], r["value"]) for r in got.collect()} == {("Bronx", "2021-01", None), ("Bronx", "2021-02", 3.0)}


def test_months(spark):
    df = spark.createDataFrame([("1", "5", "", "0"), ("2", "7", "8.005", "9")], "zip string, `2025-01-31` string, `2025-02-28` string, `2025-03-31` string")
    long = series.to_long(df, ["zip"])
    got = {r["zip"]: (r["latest_value"], str(r["latest_month"]), str(r["period_start"])) for r in series.latest(long, ["zip"]).collect()}
    assert got == {"1": (5.0, "2025-01-31", "2025-01-01"), "2": (9.0, "2025-03-31", "2025-03-01")}
    assert {r["zip"]: sorted(r["history"]) for r in series.history(long, ["zip"], ["2025-02-28", "2025-03-31"]).collect()} == {"2": ["2025-02-28", "2025-03-31"]}
    with pytest.raises(ValueError):
        series.month_columns(["zip"])


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    feats = [{"type": "Feature", "properties": {"tds": "1"}, "geometry": {"type": "Polygon", "coordinates": square}},
             {"type": "Feature", "properties": {"tds": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
             {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [3, 4]}}, {"type": "Feature", "properties": {}, "geometry": None}]
    path = put(tmp_path / "f.geojson", json.dumps({"type": "FeatureCollection", "features": feats}))
    rows = geojson.read_features(spark, path).orderBy("feature_index").collect()
    assert [len(r["parts"]) if r["parts"] else None for r in rows] == [1, 2, None, None] and (rows[2]["x"], rows[2]["y"]) == (3.0, 4.0)
    lines = put(tmp_path / "f.jsonl", "\n".join(json.dumps(f) for f in feats))
    assert geojson.read_feature_lines(spark, lines).count() == 4
    kept = geojson.transform_features(geojson.read_features(spark, path), lambda d: d.withColumn("tds", F.col("properties")["tds"]).where("tds is not null"))
    assert kept.count() == 2
    with pytest.raises(Exception, match="not a FeatureCollection"):
        geojson.read_features(spark, put(tmp_path / "g.json", json.dumps({"type": "Other"}))).collect()


def test_inventory_and_sinks(spark, tmp_path):
    folder = tmp_path / "d"
    (folder / "sub").mkdir(parents=True)
    put(folder / "a.txt", "hello")
    put(folder / "sub" / "b.txt", "page one")
    files = receipts.inventory(spark, str(folder))
    got = {r["path"]: (r["sha256"], r["byte_length"]) for r in files.collect()}
    assert got == {"a.txt": (hashlib.sha256(b"hello").hexdigest(), 5), "sub/b.txt": (hashlib.sha256(b"page one").hexdigest(), 8)}
    pins = spark.createDataFrame([("a.txt", got["a.txt"][0]), ("sub/b.txt", "0"), ("gone", "1")], "path string, sha256 string")
    assert {r["path"]: r["ok"] for r in receipts.pin_gate(files, pins).collect()} == {"a.txt": True, "sub/b.txt": False, "gone": False}
    assert receipts.header_gate({"x": ["a"]}, {"x": ["a", "b"]}) == {"x": ["b"]}
    assert receipts.receipts(files, "s", "2025-01-01 00:00:00").count() == 2
    assert geojson.read_pages(spark, str(folder / "sub")).first()["text"] == "page one"
    df = spark.createDataFrame([("z", 1), ("y", 2)], "k string, v int")
    sinks.write_parquet(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_products({"index": sinks.package(df, "k", ["v"])}, str(tmp_path / "j"))
    assert {r["key"]: r["attributes"]["v"] for r in spark.read.json(str(tmp_path / "j" / "index")).collect()} == {"z": 1, "y": 2}


def test_inventory_of_large_files(spark, tmp_path):
    """A sparse file of 3 GB, more than a value in a row can hold, an odd name and an empty file."""
    folder = tmp_path / "large"
    (folder / "sub dir").mkdir(parents=True)
    size, digest = 3 << 30, hashlib.sha256()
    with open(folder / "sparse.bin", "wb") as f:
        f.seek(size - 4)
        f.write(b"tail")
    zero = bytes(1 << 24)
    for _ in range(size // len(zero) - 1):
        digest.update(zero)
    digest.update(zero[:-4] + b"tail")
    (folder / "sub dir" / "a %20é.txt").write_bytes(b"abc")
    (folder / "none").write_bytes(b"")
    rows = {r["path"]: (r["sha256"], r["byte_length"]) for r in receipts.inventory(spark, str(folder)).collect()}
    assert rows == {"sparse.bin": (digest.hexdigest(), size), "none": (hashlib.sha256().hexdigest(), 0),
                    "sub dir/a %20é.txt": (hashlib.sha256(b"abc").hexdigest(), 3)}
