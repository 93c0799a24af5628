"""Parsing and rules, one operator at a time."""

import datetime

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import arrays, rules, typed


def col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def parsed(spark, values, fn):
    return [("bad" if r["bad"] else r["value"]) for r in col(spark, values, fn)]


def test_money(spark):
    got = parsed(spark, ["$756", "$1,234.50", " n/a ", None, "-", "-$5", "- 5", "1,2,3", "12,34", "abc", "$"], typed.parse_money)
    assert got == [756.0, 1234.5, None, None, None, -5.0, -5.0, "bad", "bad", "bad", "bad"]


def test_whole(spark):
    got = parsed(spark, ["1,234", "1,234.0", "1.5", "12%", "-7", "", "x", "9007199254740993"], typed.parse_whole)
    assert got == [1234, 1234, "bad", 12, -7, None, "bad", 9007199254740993]


def test_number(spark):
    assert parsed(spark, ["12.5%", "1,000.25", "NaN", "5 %", "5x"], typed.parse_number) == [12.5, 1000.25, None, 5.0, "bad"]


def test_date(spark):
    d = datetime.date
    got = parsed(spark, ["1/1/2025", "01/31/2025", "2025-01-01", "2025-01-01T10:00:00Z", "13/45/2025", "2025-02-30", "none", "soon", "20250102"], typed.parse_date)
    assert got == [d(2025, 1, 1), d(2025, 1, 31), d(2025, 1, 1), d(2025, 1, 1), "bad", "bad", None, "bad", d(2025, 1, 2)]


def test_ids(spark):
    assert col(spark, ["021", "136.0", "abc", "000", None, "0136.00"], typed.plain_id) == ["21", "136", "abc", "0", None, "136"]
    assert col(spark, ["7", "00501", "1234567", "NY 10011-22", "none", ""], typed.zip5) == ["00007", "00501", "1234567", "10011", None, None]
    assert col(spark, [" 5", None, "123"], typed.padded_code) == ["05", "00", "123"]
    assert col(spark, ["  a \t b ", "NULL"], typed.tidy_name) == ["a b", None]
    assert col(spark, [" Queens ", "x"], lambda c: typed.code_of(c, {"QUEENS": "QN"})) == ["QN", None]


def test_buckets(spark):
    assert col(spark, ["1", "3", "4", "13", "14", "0", "1.5", "NaN", None], lambda c: typed.size_bucket(c, 1, 13)) == [
        "1", "3", "4+", "4+", None, None, None, None, None]
    assert col(spark, ["1,234 of 12.5 and 7% in 2024", "a1 2b 3"], typed.integers) == [[1234, 2024], [3]]


def test_search_text(spark):
    assert col(spark, ["  St. Mary's--Park ", "É"], typed.search_text) == ["st mary s park", ""]


@pytest.mark.parametrize("months,kind", [(0, "same_month"), (5, "near"), (6, "near"), (11, "representative_window"), (18, "representative_window"),
                                         (24, "context_only"), (36, "context_only"), (72, "too_far")])
def test_period(spark, months, kind):
    assert col(spark, [months], rules.period_class, "int") == [kind]


def test_months_apart(spark):
    df = spark.sql("select date '2025-01-31' a, date '2024-12-01' b")
    assert df.select(typed.months_apart(F.col("a"), F.col("b"))).first()[0] == 1


def test_wedge(spark):
    w = spark.range(1).select(*[c.alias(n) for n, c in rules.wedge(F.lit(783.0), F.lit(9350.0)).items()]).first()
    assert (w["monthly_wedge"], w["annual_wedge"]) == (8567.0, 102804.0) and abs(w["pct_below"] - 0.91625668) < 1e-6
    assert spark.range(1).select(rules.wedge_inputs_ok(F.lit(1.0), F.lit(0.0))).first()[0] is False


def quality(spark, **k):
    base = dict(t_scope="all_units", t_bed=None, m_scope="all_units", m_bed=None, period="near", gross=True, basis="index", contains=None)
    base.update(k)
    lit = {n: F.lit(v) for n, v in base.items()}
    for b in ("t_bed", "m_bed"):
        lit[b] = lit[b].cast("int")
    scope = rules.scope_kind(lit["t_scope"], lit["t_bed"], lit["m_scope"], lit["m_bed"])
    q = rules.quality_class(lit["period"], scope, lit["gross"], lit["basis"], lit["contains"].cast("boolean"))
    return tuple(spark.range(1).select(scope, q).first())


def test_quality_table(spark):
    wide = "development_wide_vs_representative_bedroom"
    assert quality(spark, period="too_far")[1] == "unavailable"
    assert quality(spark, period="context_only")[1] == "context_only"
    assert quality(spark, m_scope="bedroom_specific", m_bed=2) == (wide, "representative")
    assert quality(spark, t_bed=1, m_bed=2, m_scope="bedroom_specific") == ("incompatible", "representative")
    assert quality(spark, period="representative_window")[1] == "representative"
    assert quality(spark, gross=False) == ("all_unit_vs_all_unit", "strong")
    same = dict(t_bed=2, m_bed=2, m_scope="bedroom_specific", period="same_month")
    assert quality(spark, **same, basis="regulatory_market_benchmark", contains=True) == ("same_bedroom", "exact")
    assert quality(spark, **same, basis="regulatory_market_benchmark")[1] == "strong"
    assert quality(spark, **same, basis="asking", contains=True)[1] == "strong"
    assert quality(spark, t_scope="loft", m_scope="loft")[0] == "all_unit_vs_all_unit"


def test_source_and_direction(spark):
    f = lambda b, o, a: spark.range(1).select(rules.market_source(F.lit(b), F.lit(o), F.lit(a))).first()[0]
    assert [f("index", "", ""), f("", "zori:x", ""), f("asking", "hud:1", ""), f("odd", "", ""), f(None, None, None)] == [
        "zori", "zori", "hud_safmr", "odd", "unknown"]
    g = lambda r, c: tuple(spark.range(1).select(rules.direction_change(F.lit(r), F.lit(c)), rules.scale_change(F.lit(r), F.lit(c))).first())
    assert [g(5, 3), g(0, 2), g(-4, 0), g(3, -3)] == [("unchanged", "decreased"), ("emerged", "increased"), ("neutralized", "decreased"), ("reversed", "unchanged")]


def test_groups(spark):
    def group(code, aid, voucher, ok=True):
        args = F.lit(ok), rules.regime(F.lit(code)), typed.answer(F.lit(aid)), typed.answer(F.lit(voucher))
        return spark.range(1).select(rules.primary_group(*args)).first()[0]

    assert [group("05", "2", "2"), group("05", "2", "1"), group("32", "1", "1"), group("32", "1", "2"), group("80", "2", "2"),
            group("80", "1", "2"), group("80", "9", "2"), group("80", "-2", "2"), group("80", "2", "2", False), group("90", "1", "9")] == [
        "public_housing", "unknown", "section8_voucher", "rent_stabilized", "unassisted_market", "other_or_unspecified_assistance", "unknown",
        "unknown", "ineligible", "rent_controlled"]


def test_intervals(spark):
    f = lambda *v: spark.range(1).select(rules.intervals_overlap(*[F.lit(x).cast("double") for x in v])).first()[0]
    assert [f(1, 3, 3, 4), f(1, 2, 3, 4), f(1, None, 3, 4), f(1, float("nan"), 3, 4)] == [True, False, None, None]


def test_reason_folding(spark):
    long = "market geography is ZIP/ZCTA 10011 rather than the exact"
    got = spark.range(1).select(arrays.fold_reasons(F.array(*[F.lit(x) for x in (long + " footprint", "b", " ", "B", long + " parcel")]))).first()[0]
    assert got == [long + " footprint", "b"]


def test_split_names(spark):
    assert col(spark, ["Bronx / queens", "x", "QUEENS"], lambda c: arrays.split_names(c, {"BRONX": "BX", "QUEENS": "QN"})) == [["BX", "QN"], [], ["QN"]]
