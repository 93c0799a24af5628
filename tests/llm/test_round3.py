"""Resampling, page texts and infilling against plain Python, with the odd cases of each."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from parcelwise.llm import decontaminate, infill, resample, suffix_dedup, wrapper
from tests.llm import brute
from tests.llm.test_exact import ODD, frame

LONG = "wordé " * 60_000


def infilled(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    if doc_id is None:
        return n, "plain", None, None, text
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark):
    rng = random.Random(4)
    bits = ["a", "bc", " ", "  ", "\n", "é", "漢字", "\U0001f600", "<", "S>", "<P", " ", "\x1c", "x" * 300]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([1, 3, 20, 400])))) for i in range(400)]
    docs += [(1000 + i, LONG + "x" * i) for i in range(4)] + [(2000, "q <M> r"), (2001, "x" * 100_000), (7, docs[7][1]), (7, docs[7][1])] + ODD
    made = infill.transform(frame(spark, docs), ["doc_id"]).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key)
    assert got == sorted(((d, *infilled(d, t)) for d, t in docs), key=key)
    assert sorted(r.back for r in made) == sorted(t or "" for _, t in docs)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert infill.transform(frame(spark, docs).limit(0), ["doc_id"]).count() == 0


def test_fenwick_cuts():
    rng = np.random.default_rng(1)
    for size in (1, 255, 256, 257, 70_000):
        data = rng.choice(np.frombuffer(b"ab \xc3", np.uint8), size)
        cutter = infill.Cutter(data, np.array([0, 0, size, size]))
        ends = np.flatnonzero(infill.unit_ends(data, np.array([0, size]))) + 1
        assert cutter.n.tolist() == [0, len(ends), 0]
        ks = np.arange(len(ends) + 1)
        byte, point = cutter.cut(np.ones(len(ks), np.int64), ks)
        want = np.concatenate([[0], ends])
        assert (byte == want).all() and (point == np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[want]).all()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resampled(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [(d, WORDS.findall(lower(t))) for d, t in docs if d is not None]
    feats = lambda w: [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s = collections.Counter(b for _, w in words for b in feats(w))
    t = collections.Counter(b for x in target for b in feats(WORDS.findall(lower(x))))
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets)))) for b in s}
    rows = []
    for d, w in words:
        f = feats(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[:percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def test_resample(spark):
    rng = random.Random(6)
    names = ["a", "Bc", "été", "d9", "x" * 100, "zz", "New", "york"]
    text = lambda n: rng.choice([" ", "-", "_"]).join(rng.choice(names) for _ in range(n))
    docs = [(rng.randint(-10**15, 10**15), text(rng.choice([0, 5, 19, 20, 21, 80]))) for _ in range(300)]
    docs += [(i, docs[0][1]) for i in range(40)] + [(2**62, text(30)), (-2**62, text(30)), (5000, LONG)] + [(77, text(25))] * 3 + ODD
    target = [text(12), None, "", "new york"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, weight int")
    for longest, percent in ((1, 10), (3, 60)):
        got = resample.resample(frame(spark, docs), bench, longest=longest, percent=percent).collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((tuple(r) for r in got), key=key) == sorted(resampled(docs, target, longest, percent=percent), key=key)
    assert resample.resample(frame(spark, docs).limit(0), bench).count() == 0
    assert resample.resample(frame(spark, docs), bench.limit(0)).where("rank = 1").count() == 1


def test_radix_ranks(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0, 1, 5, -70_000]), rng.choice([-2**63, 2**63 - 1, 0, rng.randint(-9, 9)])) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("rank_of_old", F.lit(1))
    got = sorted((r.rank, r.a, r.b) for r in resample.radix_ranks(df, "a", "b").collect())
    assert [r for r, _, _ in got] == list(range(1, len(rows) + 1)) and [(a, b) for _, a, b in got] == sorted(rows)
    same = resample.radix_ranks(spark.createDataFrame([(3, 4)] * 5, "a long, b long"), "a", "b")
    assert sorted(r.rank for r in same.collect()) == [1, 2, 3, 4, 5]


def test_crc():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(5000)), np.uint8)
    cuts = np.array(sorted(rng.sample(range(5000), 90)))
    got = resample.crc_of(data, cuts[:-1], cuts[1:])
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]


def page(i, body, rng):
    """A page with every kind of surrounding: fixed lines and lines that vary in places that are no content."""
    say = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randrange(99)) for _ in range(n))
    return f"""<!doctype html><html><head><title>{say(4)}</title><style>p {{}}</style></head><body class="no-sidebar page-{i}">
<div class="site-header"><div>{say(5)}</div></div><div id=topMenu><a href=/x>{say(2)}</a></div><ul><li><a href="/{i}">{say(3)}</a></ul>
<div>Our site since 1999</div><div class="cookie-notice">{say(9)}</div>{body}
<div class="widget"><p>{say(8)}</p></div><form action="/s"><p>{say(3)}</p><input name=q></form>
<section id="comments"><article class="comment"><p>{say(12)}</p></article></section>
<div class='ad-slot'>{say(6)}<script>if (1 < 2) {{ document.write("<p>{say(2)}</p>") }}</script></div><footer>{say(4)}</footer></body></html>"""


def test_main_text(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(999)}" for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 9))]
        inner = "".join(f"<p>{p[:5]}<b>{p[5:]}</b>" + ("</p>" if rng.random() < 0.5 else "\n ") for p in paragraphs)
        if i % 3 == 0:  # no article element: what varies outside the marked places is content
            body = f"<div class='box'><div class=text-{i}><p>Read more on our site</p>{inner}</div></div>"
        elif i % 3 == 1:
            body = f"<article><header><h1>T{i} &amp; &lt;b&gt;</h1></header><p>Read more on our site</p>{inner}<aside><p>x</p></aside></article>"
            paragraphs = [f"T{i} & <b>", *paragraphs]
        else:
            body = f"<main id=m{i}><h2>T{i}</h2><!-- <p>no</p> --><ul><li>one<li>two&nbsp;  {i}</ul>{inner}</main>"
            paragraphs = [f"T{i}", f"two {i}", *paragraphs]  # "one" stands on every page
        rows.append((i, f"https://h{i % 3}.example/{i}", page(i, body, rng)))
        want[i] = paragraphs
    rows += [(100, "https://h1.example/z", None), (101, None, "<p>a&eacute;&copy b</p>c<td>d"), (102, "x", ""), (103, "https://h9.example/", "<div hidden>n</div>t<br>u <span class=ad>v</span>w"),
             (104, "https://h8.example/", "<p>" + "long &amp; text. " * 50_000), (105, "https://h8.example/2", "<div>" * 3000 + "deep" + "</div>" * 3000), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "rank", "n")})
    got = collections.defaultdict(list)
    for r in wrapper.digest(wrapper.extract(df, ["page_id", "url"])).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for i, paragraphs in want.items():
        assert got[i][0].split("\n\n") == paragraphs, i
    assert got[3][0] == got[3][1] and got[100] == [""] and got[102] == [""] and got[105] == ["deep"]
    assert got[101] == ["aé© b\n\nc d"] and got[103] == ["t u w"] and got[104] == [" ".join(["long & text."] * 50_000)]
    assert wrapper.extract(df.limit(0), ["page_id"]).count() == 0


def test_matching():
    a = wrapper.Shape("0 \n1 div\n2 p\n2 ul\n3 li\n1 footer")
    b = wrapper.Shape("0 \n1 nav\n1 div\n2 ul\n3 li\n2 p\n1 footer")
    n, found = wrapper.matching(a, b)
    assert n == 5 and found.tolist() == [0, 2, -1, 3, 4, 6]  # p and ul stand in another order: the heavier one is matched
    assert wrapper.matching(a, a)[0] == 6 and wrapper.matching(a, a)[1].tolist() == list(range(6))


def test_one_repeated_word():
    """An item of 500 equal words in a text of 60,000: as many longest matches as diagonals, and memory in proportion."""
    import pyarrow as pa

    items = pa.table({"item_id": ["1", "2"], "text": ["la " * 500, "so la la"]})
    test = decontaminate.test_suffixes(items, 10)
    text = ("so " + "la " * 60_000).encode()
    tracemalloc.start()
    n, which, at, words, doc = decontaminate.search(test, 10, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and n.tolist() == [60_001]
    first = test["item"][which] == 0
    assert first.sum() == 60_000 - 9 + 490 and (~first).sum() == 1 and words[~first].tolist() == [3]
    assert words[first].max() == 500 and set(at[first][words[first] == 500].tolist()) == set(range(1, 59_502))


def test_longest_matches(spark):
    """All longest matches, in texts of few words with many repeats, a very long one and repeated rows, against brute force."""
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(["a", "b"]) for _ in range(n))
    items = [(str(i), text(rng.choice([2, 4, 6, 15]))) for i in range(12)]
    docs = [(i, text(rng.randint(0, 40)) + rng.choice(["", " c " + text(9)])) for i in range(30)] + [(50, "c " * 50_000 + items[0][1])] + ODD
    docs += [(60, docs[3][1]), (60, docs[3][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = []
    for d, t in docs:
        w, found = (t or "").lower().split(), []
        for name, x in items:
            v = x.split()
            k = min(4, len(v))
            for i in range(len(v) - k + 1):
                for j in range(len(w) - k + 1):
                    if w[j:j + k] == v[i:i + k] and (i == 0 or j == 0 or w[j - 1] != v[i - 1]):
                        n = k
                        while len(v) >= 4 and i + n < len(v) and j + n < len(w) and v[i + n] == w[j + n]:
                            n += 1
                        found.append((name, i, j, n))
        want.append((str(d), sorted(found)))
    got = decontaminate.mark(frame(spark, docs), bench, ["doc_id"], window=4).collect()
    assert sorted((str(r.doc_id), sorted(tuple(m) for m in r.found__)) for r in got) == sorted(want)


def passages(rng, n):
    """Documents of random words around one passage of 60 bytes, some with a line of dashes too."""
    passage = "".join(rng.choice("abcdefghij ") for _ in range(60))
    noise = lambda: "".join(rng.choice("klmnopqrstuvwxyz ") for _ in range(rng.randint(30, 90)))
    return [(i, noise() + passage + noise() + ("-" * 80 + noise() if i % 3 == 0 else "")) for i in range(n)]


def test_hot_triggers_split(spark):
    docs = passages(random.Random(21), 120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((d, n, tuple(s), k) for d, n, s, k in brute.repeats(docs))
    for hot in (2, 40, 10**6):
        got = suffix_dedup.remove_repeats(df, 1500, hot).collect()
        assert sorted((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == want


def test_hot_triggers_meet_in_small_groups():
    """A passage in 3,000 surroundings: no bucket gets more of its strings than a few a chunk."""
    docs, chunks, buckets = passages(random.Random(22), 3000), 30, 100_003
    tables = [pa.table({"chunk": pa.array([c] * 100, pa.int32()), "doc_id": [d for d, _ in docs[c::chunks]], "text": [t for _, t in docs[c::chunks]]}) for c in range(chunks)]
    largest = {}
    for hot in (200, 10**9):
        bits = suffix_dedup.repeated(hot)(pa.concat_tables([suffix_dedup.send_triggers(buckets)(t) for t in tables]))
        sent = {}
        for c, t in enumerate(tables):
            out = suffix_dedup.send_phrases(buckets)(t, bits.filter(pc.equal(bits["chunk"], c)))
            for kind, bucket, data in zip(out["kind"].to_pylist(), out["bucket"].to_pylist(), out["data"].to_pylist()):
                if kind == 0:
                    sent[bucket] = sent.get(bucket, 0) + len(suffix_dedup.unpack(data))
        largest[hot] = max(sent.values())
    # 33 documents of a chunk have dashes; the smallest of them sends each of its repeats
    assert largest[200] <= 40 * chunks and largest[10**9] > 2500, largest
