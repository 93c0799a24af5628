"""Weighted medians, uncertainty, cells and shares against small models."""

import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import cells, checks, gaps
from parcelwise.operators import median as med


def model(pairs, midpoint=True):
    rows = sorted((v, Decimal(str(w))) for v, w in pairs if math.isfinite(v) and math.isfinite(w) and w > 0)
    total, run = sum((w for _, w in rows), Decimal()), Decimal()
    for i, (v, w) in enumerate(rows):
        run += w
        if run * 2 == total and midpoint and i + 1 < len(rows):
            return (v + rows[i + 1][0]) / 2
        if run * 2 >= total:
            return v
    return None


@pytest.mark.parametrize("pairs,want", [
    ([(1000, 1), (2000, 1)], 1500.0), ([(1000, 0.3), (2000, 0.1), (3000, 0.2)], 1500.0), ([(1000, 1), (2000, 1), (9000, 10)], 9000.0),
    ([(5, 0), (7, float("nan")), (9, 2)], 9.0)])
def test_golden_medians(spark, pairs, want):
    df = spark.createDataFrame([(float(v), float(w)) for v, w in pairs], "v double, w double")
    assert med.weighted_median(df, [], "v", "w").first()["median"] == want


@pytest.mark.parametrize("midpoint", [True, False])
def test_random_groups(spark, midpoint):
    rng, rows, want = random.Random(3), [], {}
    for g in range(120):
        # ties at half the weight, negative and equal values, values within one bucket
        pairs = [(rng.choice([rng.randint(-4, 4) * 50.0, 1000 + rng.randint(0, 9) / 100, rng.random() * 1e6]), rng.choice([1.0, 2.0, 0.3, 0.1, 0.2, 0.0]))
                 for _ in range(rng.randint(1, 12))]
        rows += [(g if g else None, v, w) for v, w in pairs]
        want[g if g else None] = model(pairs, midpoint)
    df = spark.createDataFrame(rows, "g int, v double, w double")
    got = {r["g"]: r["median"] for r in med.weighted_median(df, ["g"], "v", "w", midpoint=midpoint).collect()}
    assert got == {g: m for g, m in want.items() if m is not None}


def test_value_order(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1e-310, 1.7976931348623157e308, 1e300] + [2.0**e for e in range(-1074, 1024)]
    values += [math.nextafter(2.0**e, d) for e in range(-1074, 1024) for d in (0, math.inf)] + [rng.uniform(0, 10.0**rng.randint(-300, 300)) for _ in range(3000)]
    values = [s * v for v in values if v < math.inf for s in (1, -1)]
    bits = lambda v: (struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (1 if v >= 0 else -1))
    rows = med.with_order(spark.createDataFrame([(v,) for v in values], "v double"), "v", "o").collect()
    assert all(r[1] == bits(r[0]) for r in rows), [(r[0], r[1], bits(r[0])) for r in rows if r[1] != bits(r[0])][:5]


def test_medians_of_neighbouring_doubles(spark):
    """Groups whose values are a few doubles apart, spread over all magnitudes, or both, with many weights."""
    rng = random.Random(11)
    near = [1000.0]
    for _ in range(40):
        near.append(math.nextafter(near[-1], math.inf))
    groups = {1: near, 2: [rng.uniform(1000, 1000.5) for _ in range(60)], 3: [10.0**e for e in range(-300, 300, 7)], 4: [5.0], 5: [1000.0, 1e-320, 2e-320, 1e-3, *near[:3]]}
    rows = [(g, v, float(rng.randint(1, 4)), [float(rng.randint(0, 3)) for _ in range(20)]) for g, vs in groups.items() for v in vs for _ in range(3)]
    df = spark.createDataFrame(rows, "g int, v double, w double, r array<double>")
    ready = med.weighted_rows(df, F.col("v"), F.col("w"), F.col("r"), 20, med.WHOLE)
    got = {(x["g"], x["_r"]): (x["_m"], x["_first"]) for x in med.medians(ready, ["g"]).collect() if x["_r"] <= 20}
    for g in groups:
        for r in range(21):
            pairs = [(v, w if r == 0 else reps[r - 1]) for k, v, w, reps in rows if k == g]
            want = (model(pairs, True), model(pairs, False))
            assert got.get((g, r), (None, None)) == want, (g, r)


def test_variance(spark):
    one = spark.range(1)
    assert one.select(med.sdr_variance(F.lit(100.0), F.array(F.lit(90.0), F.lit(110.0)), 0.5)).first()[0] == 100.0


def test_replicates(spark):
    # 40 replicates: more than one weight block
    rng = random.Random(7)
    rows = [(g, float(rng.randint(500, 3000)), float(rng.randint(1, 9)), [float(rng.randint(0, 5)) for _ in range(40)]) for g in range(5) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, v double, w double, r array<double>")
    got = {x["g"]: x for x in med.median_uncertainty(df, ["g"], "v", "w", F.col("r"), 40, multiplier=0.05, critical=1.96).collect()}
    for g in range(5):
        mine = [x for x in rows if x[0] == g]
        point = model([(x[1], x[2]) for x in mine])
        reps = [model([(x[1], x[3][i]) for x in mine]) for i in range(40)]
        se = math.sqrt(0.05 * sum((m - point) ** 2 for m in reps))
        assert got[g]["point"] == point and got[g]["standard_error"] == pytest.approx(se) and got[g]["ci_upper"] == pytest.approx(point + 1.96 * se)


@pytest.mark.parametrize("broken", [float("nan"), -1.0, None])
def test_invalid_replicate(spark, broken):
    rows = [(float(v), 1.0, [1.0] * 20) for v in range(500, 660, 10)]
    rows[3][2][17] = broken
    got = med.median_uncertainty(spark.createDataFrame(rows, "v double, w double, r array<double>"), [], "v", "w", F.col("r"), 20,
                                 multiplier=0.05, critical=1.96).first()
    assert got["point"] == 575.0 and got["variance"] is None and got["replicates_used"] == 0


def test_cells(spark):
    rows = [("a", 1.0 * v, 1.0, [1.0] * 2) for v in range(500, 660, 10)] + [("b", None, 2.0, [1.0] * 2), ("c", 100.0, -1.0, [1.0] * 2), ("c", 100.0, 1.0, [1.0] * 2)]
    df = spark.createDataFrame(rows, "k string, v double, w double, r array<double>")
    dims = {"geo": {"a": F.col("k") == "a", "b": F.col("k") == "b", "c": F.col("k") == "c", "ab": F.col("k").isin("a", "b"), "none": F.lit(False)}}
    got = {r["geo"]: r for r in cells.cell_estimates(df, dims, "v", "w", F.col("r"), cells.Replicates(2)).collect()}
    a = got["a"]
    assert (a["value"], a["ci_lower"], a["ci_upper"], len(a["caveats"]), a["reliability"]) == (575.0, 575.0, 575.0, 1, "use_with_caution")
    assert got["ab"]["eligible_n"] == 17 and got["ab"]["usable_n"] == 16 and got["ab"]["eligible_weight"] == 18
    assert (got["b"]["available"], got["b"]["unavailable_reason"]) == (False, "no_usable_rent_observations")
    assert (got["c"]["available"], got["c"]["value"], got["c"]["unavailable_reason"]) == (False, None, "invalid_full_sample_weights")
    assert got["none"]["eligible_n"] == 0 and got["none"]["reliability"] == "unavailable"
    est = cells.cell_estimates(df, dims, "v", "w", F.col("r"), cells.Replicates(2))
    assert checks.violations(est, "geo", checks.cell_contracts()).count() == 0


def test_shares(spark):
    rows = [("g", "1", "0", 3.0, [2.0, 4.0]), ("g", "2", "1", 1.0, [1.0, 1.0]), ("g", None, "1", 5.0, [1.0, 1.0]), ("h", "1", "0", 0.0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, p string, b string, w double, r array<double>")
    parts = {"people": (F.col("p"), ["1", "2"]), "beds": (F.col("b"), ["0", "1"])}
    dims = {"grp": {"g": F.col("g") == "g", "h": F.col("g") == "h", "e": F.lit(False)}}
    got = {(r["grp"], r["people"], r["beds"]): r for r in cells.joint_shares(df, dims, parts, "w", F.col("r"), cells.Replicates(2, 0.05)).collect()}
    top = got["g", "1", "0"]
    assert top["share"] == 0.75 and top["standard_error"] == pytest.approx(math.sqrt(0.05 * ((2 / 3 - 0.75) ** 2 + (0.8 - 0.75) ** 2)))
    assert (top["missing_n"], top["missing_weight"]) == (1, 5.0)
    empty = got["g", "2", "0"]
    assert empty["share"] == 0 and empty["none_observed"] and empty["ci_lower"] is None and empty["reliability"] == "none_observed"
    assert got["h", "1", "0"]["unavailable_reason"] == "invalid_full_sample_weights"
    assert got["e", "1", "0"]["unavailable_reason"] == "no_valid_denominator" and len(got) == 12


def test_gap_needs_equal_fields(spark):
    rows = [("nyc", "m", "recent", "o1", 10.0, True, "reliable", ["x"], "rent"), ("nyc", "m", "incumbent", "o2", 0.0, True, "reliable", [], "rent"),
            ("bx", "m", "recent", "o3", 10.0, True, "reliable", [], "rent"), ("bx", "m", "incumbent", "o4", 5.0, True, "reliable", [], "size"),
            ("qn", "m", "recent", "o5", None, False, "unavailable", [], "rent"), ("qn", "m", "incumbent", "o6", 5.0, True, "reliable", [], "rent")]
    df = spark.createDataFrame(rows, "geography_id string, population string, cohort string, observation_id string, value double, available boolean, "
                                     "reliability string, caveats array<string>, measure string")
    got = {r["geography_id"]: r for r in gaps.gap_pairs(df, [(gaps.WITHIN, "m", "recent", "m", "incumbent")]).collect()}
    assert set(got) == {"nyc", "bx"}
    assert (got["nyc"]["difference"], got["nyc"]["percent"], got["nyc"]["direction"]) == (10.0, None, "positive")
    assert got["bx"]["mismatched"] == ["measure"] and got["bx"]["difference"] is None
    assert got["nyc"]["component_caveats"] == {"o1": ["x"], "o2": []}


def test_marks_list_their_members_again(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    x = F.col("x")
    for many in ({"a": x >= 1, "b": x >= 2, "c": x == 9}, {f"m{i:02d}": x > i - 60 for i in range(70)}, cells.Label(x.cast("string"), ("1", "3"))):
        mark, listed = cells.marks(many)
        got = df.select(cells.memberships(many).alias("want"), mark.alias("m")).withColumn("got", listed(F.col("m"))).collect()
        assert all((r.want or []) == r.got or r.want == r.got for r in got)
    assert dict(df.select(cells.marks({"a": x >= 1})[0].alias("m")).dtypes)["m"] == "bigint"


def test_only_rows_between_the_bins_found_are_kept(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("_k"), F.col("id").alias("_o"))
    hits = spark.createDataFrame([(3, 100, 200), (3, 300, 310), (5, 40, 40)], "_k long, _first_o long, _last_o long")
    got = med.in_span(rows, hits, "_low", "_high")
    want = [i for i in range(1000) if i % 7 == 3 and 100 <= i <= 310 or i == 40 and i % 7 == 5]
    assert sorted(r._o for r in got.collect()) == want
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
