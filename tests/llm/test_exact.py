"""Operators with one right answer, against brute force on small inputs with all the odd cases."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import decontaminate, fingerprint, lm, near_dedup, pii, suffix_dedup
from tests.llm import brute

ODD = [(900, None), (901, ""), (902, "  \n"), (903, "one"), (904, "ONE"), (905, "é" * 70), (None, "no id"), (None, None)]


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.withColumns({c: F.lit(7) for c in ("chunk", "bucket", "label", "data", "lang", "kind", "n_words", "spans")})


def test_repeats(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcd é") for _ in range(2000))
    docs = []
    for i in range(40):
        text = "".join(rng.choice("abc de") for _ in range(rng.randint(0, 300)))
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 1900)
            text += base[a:a + rng.randint(30, 100)] + rng.choice(["", "xé", "zz" * 40, "=-" * 60])
        docs.append((3 * i, text))
    docs += [(1000, docs[5][1]), (1000, docs[5][1]), (18, docs[9][1])]
    want = sorted((d, n, tuple(s), k) for d, n, s, k in brute.repeats([x for x in docs + ODD if x[0] is not None]))
    for chunk_bytes in (1 << 20, 2500):
        got = suffix_dedup.remove_repeats(frame(spark, docs + ODD), chunk_bytes).collect()
        assert sorted((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == want
    assert suffix_dedup.remove_repeats(frame(spark, docs).limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    got = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.remove_repeats(frame(spark, [(1, long[1000:201_000]), (2, long)]))).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].n_spans) == (200_000, 1)
    assert got[2].kept_sha256 == hashlib.sha256((long[:1000] + long[201_000:]).encode()).hexdigest()


def test_contamination(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice(["a", "b", "C", "d1", "é", "zz", "Foo"]) + rng.choice([" ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 2, 3, 9, 10, 11, 30]))) for i in range(25)] + [(None, text(12)), (50, None), (3, text(15))]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(3)) for i in range(60)] + ODD + [(5, text(20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), n, h, i) for d, n, h, i in brute.contaminated(docs, items))
    for block_bytes in (1 << 20, 150):
        marked = decontaminate.mark(frame(spark, docs), bench, ["doc_id"], block_bytes=block_bytes).collect()
        assert sorted((str(r.doc_id), r.n_words__, sum(r.hit__), sorted({m.item_id for m in r.found__})) for r in marked) == want
    kept = decontaminate.remove_contaminated(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns and kept.count() == sum(not h for _, _, h, _ in want)
    assert decontaminate.mark(frame(spark, docs), bench.limit(0), ["doc_id"]).where("size(found__) > 0").count() == 0
    assert decontaminate.mark(frame(spark, docs).limit(0), bench, ["doc_id"]).count() == 0


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    doc = "x y " + " ".join(f"w{i}" for i in range(5, 30)) + " z"
    found = decontaminate.mark(frame(spark, [(1, doc)]), spark.createDataFrame([(9, item)], "item_id long, text string"), ["doc_id"]).first().found__
    assert [(m.item_id, m.item_word, m.doc_word, m.n_words) for m in found] == [("9", 5, 2, 25)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(names) for _ in range(rng.choice([5, 9, 30, 120, 300]))] for _ in range(8)]
    docs = []
    for i in range(150):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            b[rng.randrange(len(b))] = rng.choice(names)
        docs.append((2 * i + 1, " ".join(b) if i % 3 else "\t".join(b).upper()))
    docs += ODD
    rng.shuffle(docs)
    want = brute.near([x for x in docs if x[0] is not None], size, percent)
    assert sorted(tuple(r) for r in near_dedup.group(frame(spark, docs), size, percent).collect()) == want
    if size == 5:
        kept = near_dedup.remove_near_duplicates(frame(spark, docs))
        assert kept.columns == frame(spark, docs).columns
        assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([d for d, _, c in want if d == c] + [-1, -1])
        assert near_dedup.group(frame(spark, docs).limit(0)).count() == 0


def test_base_spans():
    rng = random.Random(3)
    bits = ["a", "@", "b.", "1", "2", "55", "255", ".", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "@x.y", "é", "_", "0"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 24)))
        assert sorted(pii.base_spans(text)) == sorted(brute.personal(text)), text
    assert pii.base_spans("9" * 100_000 + ".1.1.1") == brute.personal("1.1.1") and pii.base_spans("0" * 6000 + ".1.1.1")[0][2] == "ip"


def test_personal_data(spark):
    docs = [(1, "mail é a.b@c.org, or +1 (212) 555-0147 x@y.zz"), (2, "plain 1999 text, v1.2.3 of 12:30"), (3, "call (212) 555-0147 now"), *ODD]
    rows = {r.doc_id: r for r in pii.digest(pii.find(frame(spark, docs), ["doc_id"])).collect()}
    told = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    for d, t in docs:
        base = told(brute.personal(t))
        assert rows[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert rows[1].spans == told(brute.personal(docs[0][1])) and rows[2].spans == "" and rows[3].spans == "phone:5:19"
    df = frame(spark, docs)
    masked = pii.mask(pii.find(df, df.columns), df.columns)
    assert masked.columns == df.columns and masked.where("doc_id = 1").first().text == "mail é [email], or [phone] [email]"
    assert masked.where("doc_id = 900").first().text is None and pii.find(df.limit(0), ["doc_id"]).count() == 0


def test_language_model(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["der", "die", "das", "und"] if i % 2 else ["the", "of", "and", "a", f"x{i}"]) for _ in range(rng.randint(0, 200)))) for i in range(200)] + ODD
    own = [(d, brute.words(t) + ["<end> "]) for d, t in docs if d is not None]
    count = collections.Counter(w for d, ws in own if not brute.held(d, 7, 2) for w in ws)
    total, types = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.score(frame(spark, docs), chunk_bytes=20_000).collect()}
    assert len(got) == len(own)
    for d, ws in own:
        base = sum(math.log10((count[w] + 1) / (total + types + 1)) for w in ws)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.held(d, 7, 2), len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    tested = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)
    assert lm.score(frame(spark, docs).limit(0)).count() == 0


def fingerprint_model(spark, text):
    """Entries of a fingerprint by windows over exploded rows, another way to the same numbers."""
    from pyspark.sql import Window

    df = spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", " ", -1)).alias("i", "w"))
    df = df.withColumn("k", F.shiftright(F.xxhash64("w", F.lead("w").over(Window.orderBy("i"))), 28))
    df = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1)
    df = df.withColumn("h", F.shiftright(F.xxhash64("k", "n").bitwiseAND((1 << 63) - (1 << 28)), 28))
    df = df.withColumn("bin", F.shiftright("h", 29)).withColumn("place", F.row_number().over(Window.partitionBy("bin").orderBy("h", "i"))).where("place <= 2")
    got = df.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("x")).select(
        "bin", F.when(F.size("x") == 2, F.xxhash64(F.get("x", F.lit(0))["h"], F.get("x", F.lit(1))["h"])).otherwise(F.xxhash64(F.get("x", F.lit(0))["h"])).alias("v"))
    return "".join(f"{r.bin:02X}{r.v & 0xFFF:03X}" for r in sorted(got.collect()))


def test_fingerprints(spark):
    rng = random.Random(6)
    docs = [(5 * i, " ".join(rng.choice(["a", "b", "cé", "dd"] + [f"w{rng.randint(0, 400)}"] * 4) for _ in range(rng.choice([1, 3, 40, 300])))) for i in range(25)] + ODD[:-2]
    docs += [(2000, docs[3][1]), (2001, "a b " * 60)]
    df = frame(spark, docs + ODD[-2:])
    rows = sorted(((d, t or "") for d, t in docs), reverse=True)
    got = {r.doc_id: r for r in fingerprint.compare(df).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        third = len(t) // 3
        assert (got[d].n_chars, got[d].edited) == (len(t), t[:len(t) - third] + after[:third])
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    for d, t in (docs[0], docs[7], docs[-1], (901, "")):
        assert got[d].fingerprint == fingerprint_model(spark, t)
    assert got[2000].fingerprint == got[docs[3][0]].fingerprint and got[901].fingerprint == got[900].fingerprint
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.edited, r.near_edited, r.near_next) for r in fingerprint.compare(one).collect()] == [("a a", 0.0, 1.0)]
    assert fingerprint.compare(df.limit(0)).count() == 0


def test_fingerprints_without_spaces(spark):
    """Two thirds of an edited text are unchanged, whatever parts its words."""
    rng = random.Random(12)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(n))
    lines = lambda sep: sep.join(f"w{rng.randint(0, 9999)}" for _ in range(300))
    docs = [(1, han(900)), (2, han(900)), (3, lines("\n")), (4, lines("\t")), (5, "".join(rng.choice("abcdef0123456789") for _ in range(900)))]
    for r in fingerprint.compare(frame(spark, docs)).collect():
        # documents 2 and 4 are filled up from a text of their kind
        assert (0.1 if r.doc_id in (2, 4) else 0) < r.near_edited < 1 and len(r.fingerprint) > 200


def test_contexts_of_rare_words(spark):
    """Words beyond the most frequent ones have probabilities that follow their context."""
    rng = random.Random(11)
    filler = [f"f{i}" for i in range(lm.SHORT + 10)]
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(2)]
    text = lambda k: " ".join(rng.choice(topics[k if k < 2 else rng.randrange(2)]) for _ in range(60))
    docs = [(i, text(i % 2)) for i in range(1000)] + [(i, " ".join(filler * 8)) for i in range(1000, 1200)]
    pure = [i for i in range(1000) if brute.held(i, 7, 2)]
    mixed = [i for i in range(2000, 3000) if brute.held(i, 7, 2)]
    docs += [(i, text(2)) for i in mixed]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(frame(spark, docs)).collect()}
    mean = lambda ids: sum(got[i] for i in ids) / len(ids)
    assert mean(pure) > mean(mixed) + 0.1


def test_language_model_adds_up():
    rng = np.random.default_rng(2)
    shape = lm.layout(5000)
    shape |= {"short": 9, "own": 700, "known": np.zeros(0, np.uint64), "rank": np.zeros(0, np.int64)}
    shape = lm.shares(shape, np.arange(9), rng.integers(0, 50, 700 + shape["hashed"]), 3)
    p = lm.fresh(shape)
    p["slot_bias"] = np.where(shape["slots"] > 0, p["slot_bias"], np.float32(-1e30))
    slots = np.flatnonzero(shape["slots"] > 0)
    cls = np.concatenate([np.arange(10), 10 + slots // shape["wide"]])
    at = np.concatenate([np.full(10, -1), slots])
    lead = lm.CONTEXT  # so many tokens more, so that all others follow the same ones
    cls, at, given = np.append([0] * lead, cls), np.append([-1] * lead, at), np.full(len(cls) + lead, rng.integers(shape["inputs"]))
    for offset in (np.full(len(cls), 99), np.zeros(len(cls), int)):
        assert math.isclose((10 ** lm.log_probabilities(p, shape, cls, at, given, offset))[lead:].sum(), 1, rel_tol=1e-4)
