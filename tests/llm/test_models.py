"""Trained operators and the pipeline: held-out accuracy on small invented texts, and the odd cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelwise.llm import language, mixing, near_dedup, pii, quality, toxicity
from tests.llm import brute

WORDS = {"en": ["the", "thing", "of", "and", "with", "house"], "de": ["der", "und", "schön", "nicht", "über", "ich"], "fr": ["le", "être", "où", "vous", "mais", "très"]}
ODD = [(9000, None), (9001, ""), (9002, " \n"), (9003, "12 34 -"), (None, "the thing of"), (None, None)]


@pytest.fixture(scope="module")
def corpus(spark):
    """(docs, labels): toxic texts hold a bad word or a bad prefix now and then, texts of low quality shout or repeat."""
    rng, docs, labels = random.Random(8), [], []
    for i in range(700):
        lang = rng.choice(list(WORDS))
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        w = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(20, 160))]
        if not good:
            w = [w[0]] * len(w) if i % 2 else [x.upper() + "!!" for x in w]
        for _ in range(toxic * 4):
            w[rng.randrange(len(w))] = rng.choice(["scum", "veju" + rng.choice("abcdef")])
        docs.append((i, " ".join(w), lang, "s" + str(i % 3)))
        labels.append((i, good, toxic))
    docs += [(d, t, None, None) for d, t in ODD]
    labels += [(3, None, None), (None, 1, 1), (9001, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumns({"label": F.lit(1), "score": F.lit("x"), "stats": F.lit(0)})
    return df.repartition(4).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def check(rows, truth, folds, held, least):
    assert all(r.held_out == (r.doc_id is not None and brute.held(r.doc_id, folds, held)) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= least * len(tested)


def test_toxicity(corpus):
    docs, labels = corpus
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect() if r.doc_id != 9001}, 5, 0, 0.93)
    assert {r.doc_id: r.score for r in rows}[9001] == 0.0
    assert [r.score for r in toxicity.classify(docs.limit(3), labels.limit(0)).collect()] == [0.0] * 3
    assert toxicity.classify(docs.limit(0), labels).count() == 0 and toxicity.remove_toxic(docs, labels).columns == docs.columns


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    u, gx = rng.normal(size=(toxicity.SIZE, 3 * toxicity.SIZE)) * 0.3, rng.normal(size=(5, 3, 3 * toxicity.SIZE))
    weight = rng.normal(size=(5, 3, toxicity.SIZE))
    loss = lambda: (toxicity.recur(gx, u, False)[0] * weight).sum()
    states, cache = toxicity.recur(gx, u, True)
    dgx, du = toxicity.recur_back(weight, cache, u)
    for a, g in ((u, du), (gx, dgx)):
        for at in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(6)]:
            a[at] += 1e-3
            up = loss()
            a[at] -= 2e-3
            down = loss()
            a[at] += 1e-3
            assert math.isclose((up - down) / 2e-3, g[at], rel_tol=0.05, abs_tol=0.01)


def test_quality(corpus):
    docs, labels = corpus
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.quality for r in labels.where("quality is not null").collect() if r.doc_id != 9001}, 3, 1, 0.95)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5} and quality.classify(docs.limit(0), labels).count() == 0
    value, p = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert value.tolist() == [1, 2.5, 4] and p.tolist() == [0, 0.5, 1]


def test_language(corpus):
    docs, _ = corpus
    rows = language.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect() if r.lang}
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(by[d] == ("und", 0.0) for d in (9000, 9001, 9002, 9003))
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_mixing(spark, corpus):
    docs, _ = corpus
    target = {"lang": spark.createDataFrame([("en", 2.0), ("de", 1.0), ("fr", 1.0), ("none such", 9.0)], "value string, share double")}
    rows = mixing.drawn(docs, target).collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    mass = lambda key: {k: sum(r.n_tokens * r.probability for r in rows if r[key] == k) for k in {r[key] for r in rows}}
    lang = mass("lang")
    total = sum(lang.values())
    assert all(math.isclose(lang[k] / total, s, abs_tol=0.01) for k, s in (("en", 0.5), ("de", 0.25), ("fr", 0.25)))
    # plain raking on the same cells
    cells = {}
    for r in rows:
        k = (r.source, r.lang, r.topic)
        cells[k] = cells.get(k, 0) + r.n_tokens
    weight, shares = dict(cells), []
    for d in range(3):
        sums = {}
        for k, v in cells.items():
            sums[k[d]] = sums.get(k[d], 0) + v
        powers = {k: v**mixing.TEMPER for k, v in sums.items() if v} if d != 1 else {"en": 2, "de": 1, "fr": 1}
        shares.append({k: v / sum(powers.values()) for k, v in powers.items()})
    for _ in range(60):
        for d in range(3):
            now = {}
            for k, v in weight.items():
                now[k[d]] = now.get(k[d], 0) + v
            weight = {k: v * shares[d].get(k[d], 0) / now[k[d]] if now[k[d]] else 0 for k, v in weight.items()}
    most = max(weight[k] / n for k, n in cells.items() if n)
    for r in rows:
        k = (r.source, r.lang, r.topic)
        if cells[k]:
            assert math.isclose(r.probability, weight[k] / cells[k] / most, abs_tol=0.01)
    assert {r.doc_id for r in rows if r.sampled} == {r.doc_id for r in mixing.sample(docs, target).collect()}
    assert mixing.drawn(docs.limit(0)).count() == 0


def test_rare_cells(spark, corpus):
    """A rare source is kept whole and takes nothing from the others; a budget is met and the targets with it."""
    docs, _ = corpus
    docs = docs.where("doc_id < 700")
    one = docs.where("doc_id = 3").withColumns({"doc_id": F.lit(7000).cast("long"), "source": F.lit("rare"), "text": F.lit("the thing of and " * 3)})
    kept = lambda rows: sum(r.n_tokens * r.probability for r in rows) / sum(r.n_tokens for r in rows)
    before, after = mixing.drawn(docs).collect(), mixing.drawn(docs.unionByName(one)).collect()
    assert abs(kept(after) - kept(before)) < 0.01 and {r.doc_id: r.probability for r in after}[7000] == 1
    target = {"lang": spark.createDataFrame([("en", 2.0), ("de", 1.0), ("fr", 1.0)], "value string, share double")}
    assert math.isclose(kept(mixing.drawn(docs, target, 0.5).collect()), 0.5, abs_tol=1e-6)
    told = {(r.dimension, r.value): r for r in mixing.report(docs.unionByName(one), target, 0.5).collect()}
    assert math.isclose(told["lang", "en"].share, 0.5, abs_tol=1e-3) and told["source", "rare"].kept == 1
    assert told["source", "rare"].share < told["source", "rare"].target


def test_pipeline(spark, corpus, tmp_path):
    docs, labels = corpus
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    extra = [(5000, "see " + passage + " there", "en", "s0"), (5001, "write to a.b@c.org about the thing of the house and more", "en", "s0")]
    copy = docs.where("doc_id = 10").withColumn("doc_id", F.lit(5002).cast("long"))
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string").withColumns({"label": F.lit(1), "score": F.lit("x"), "stats": F.lit(0)})
    docs.unionByName(more).unionByName(copy).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        rows, was = now.collect(), {r.doc_id: r for r in before.collect()}
        ids = {r.doc_id for r in rows}
        if name != "mixing":
            assert now.columns == before.columns
        if name == "toxicity":
            assert ids == {r.doc_id for r in toxicity.add_scores(before, labels, ["doc_id"]).collect() if r.score__ < 0.5}
        if name == "near_dedup":
            want = brute.near([(d, r.text) for d, r in was.items() if d is not None], 5, 80)
            assert {d for d in ids if d is not None} == {d for d, _, c in want if d == c} and 5002 not in ids
            assert near_dedup.group(before, 5, 80).count() == len(want)
        if name == "decontamination":
            assert set(was) - ids == {5000}
        if name == "pii":
            assert ids == set(was) and {r.doc_id: r.text for r in rows}[5001] == "write to [email] about the thing of the house and more"
            assert pii.find(now, ["doc_id"]).where("size(spans__) > 0").count() == 0
        if name == "mixing":
            assert ids <= set(was) and all(0 < r.mix_probability <= 1 for r in rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
