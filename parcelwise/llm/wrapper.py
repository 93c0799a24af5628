"""Operator 12: main text of web pages by wrapper induction over the pages of a host.

A page becomes a tree of its block elements. Siblings with one label (tag, class words, id, role) are one node, so a list of
any length is one place, and the tree of a page grows with its kinds of elements and not with its text. Its shape is that
tree without texts. The most frequent shapes of a host (``REFERENCES``) are its wrappers; every other shape of the
host is aligned with each of them by simple tree matching (the heaviest order-keeping matching of equal labels, from the
root down) and takes the best. Nodes that match nothing are places of their own shape.

Evidence is counted over all pages of a host, each different content once: a text that stands in one place in at least
``CONSTANT`` of the pages that have the place, and in ``LEAST`` of them, is a constant and belongs to the template; what
varies is content. Places are left out as a whole if their labels say menu, header, footer, sidebar, notice, advert, form or
comments, or if most of their characters over all pages are links. If a page has texts in ``main`` or ``article``, the
result is those.

Counts and joins are keyed by (host, shape, place, text), so no task holds a host: a large host is spread by its texts,
and pages meet the one row of their shape through ``join_per_key``, or by a broadcast if all rules together count at most
``SENT`` places and constants. Trees are matched once per (host, shape), not per page. The parsed pages are saved once.

A null or empty page has no text. Pages without a host are judged by their labels only. Repeated rows get equal texts and
count once as evidence. Equally frequent shapes rank by their hash, equally good wrappers by their rank. Elements nested
deeper than ``DEEPEST`` are siblings there; nothing of their text is lost. Extra columns are left out unless asked for.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import shared as sh
from parcelwise.operators.joins import join_per_key, top_per_key

REFERENCES = 3
CONSTANT = 0.9
LEAST = 3
LINKS = 0.5
DEEPEST = 150
#: So many places and constants (some 20 bytes each) are broadcast at most.
SENT = 500_000

# ---- page to blocks ----------------------------------------------------------------------------------

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
HEADS = {f"h{i}" for i in range(1, 7)}
#: Elements that end an open paragraph.
ENDS_P = HEADS | set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header "
    "hgroup hr li main menu nav ol p pre search section summary table ul".split())
BLOCKS = ENDS_P | set("caption head legend optgroup tbody tfoot thead tr".split())
#: What may stay open only inside its list or table: element -> (elements it ends, elements that hold it).
PEERS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Text up to the end tag is no markup, and none of it is content.
RAW = set("iframe noembed noframes noscript script style template textarea title xmp".split())
HIDDEN_INLINE = set("audio button canvas datalist object select svg video".split())
APART = set("br td th img wbr input embed".split()) - {"wbr"}

#: Words of class, id and role that mark what is not the main text.
NOISE = set(
    "ad ads advert advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disqus dialog footer form hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion recommended related replies respond search share "
    "sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
NOISE_TAGS = set("aside dialog footer form head menu nav search".split())
#: With one of these words beside it, "header" names the head of the article.
OWN = set("article entry post story content main page".split())
MAIN_TAGS = {"main", "article"}


class Node:
    __slots__ = ("label", "kids", "tag", "at", "up")

    def __init__(self, label: str, tag: str, up: Node | None):
        self.label, self.tag, self.up, self.kids, self.at = label, tag, up, {}, 0


def label_of(tag: str, attrs: str) -> str:
    """Tag and the words of class, id and role without digits, and whether the element is hidden."""
    if "=" not in attrs and "hidden" not in attrs:
        return tag
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)]
    words = set()
    for name, value in found:
        if name in ("class", "id", "role"):
            words.update(w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            words.add("hidden")
    return " ".join([tag, *sorted(words)])


@lru_cache(65536)
def noisy(label: str) -> bool:
    """Whether an element with this label, and all in it, is no main text."""
    tag, *words = label.split(" ")
    words = set(words)
    if tag in NOISE_TAGS or "hidden" in words:
        return True
    if tag in ("html", "body", "main") or (tag == "article" and not words & {"comment", "comments", "related", "ad", "promo"}):
        return False
    if words & NOISE:
        return not (tag in HEADS or (words & OWN and words & NOISE <= {"banner", "related", "form", "search", "social"} and len(words & OWN) > 1))
    return "header" in words and not words & OWN


class Page:
    """Blocks and shape of one page, read once from left to right."""

    def __init__(self, html: str):
        self.root = Node("", "", None)
        self.stack, self.blocks, self.text, self.links = [self.root], [], [], 0
        self.inlink: Node | None = None
        self.skip, self.skipped = "", 0
        self.read(html)
        self.flush()

    def read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = TOKEN.search(html, at)
            self.say(html[at : m.start() if m else size])
            if not m:
                return
            at = m.end()
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                self.close(tag)
            elif tag in RAW:
                if not m["attrs"].endswith("/") or tag not in ("iframe",):
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
                    at = end.end() if end else size
            else:
                self.open(tag, m["attrs"])

    def say(self, text: str) -> None:
        if self.skip or not text:
            return
        if "&" in text:
            text = entities.unescape(text)
        if self.stack[-1].tag == "head":
            if not text.strip():
                return
            self.pop(self.stack[-1])
        self.text.append(text)
        if self.inlink is not None:
            self.links += len(text.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.stack[-1], text, min(self.links, len(text))))
        self.text, self.links = [], 0

    def pop(self, node: Node) -> None:
        """End ``node`` and all that is open in it."""
        self.flush()
        k = len(self.stack) - 1
        while self.stack[k] is not node:
            k -= 1
        if self.inlink is not None and self.inlink in self.stack[k:]:
            self.inlink = None
        del self.stack[k:]

    def opened(self, tags: set[str], barrier: set[str]) -> Node | None:
        for node in reversed(self.stack):
            if node.tag in tags:
                return node
            if node.tag in barrier:
                return None
        return None

    def open(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self.skip = ""
            if self.stack[-1].tag == "head" and tag != "head":
                self.pop(self.stack[-1])
            if tag in PEERS:
                node = self.opened(*PEERS[tag])
                if node:
                    self.pop(node)
            if tag in ENDS_P:
                node = self.opened({"p"}, {"table", "caption"})
                if node:
                    self.pop(node)
                if tag in HEADS and self.stack[-1].tag in HEADS:
                    self.pop(self.stack[-1])
            self.flush()
            if tag == "hr":
                return
            self.push(tag, label_of(tag, attrs))
        elif self.skip:
            self.skipped += tag == self.skip
        elif tag in ("html", "body"):
            if self.stack[-1].tag == "head":
                self.pop(self.stack[-1])
        elif tag in APART:
            self.text.append(" ")
        elif tag in HIDDEN_INLINE or ("=" in attrs or "hidden" in attrs) and noisy(label_of(tag, attrs)):
            if not attrs.rstrip().endswith("/"):
                self.skip, self.skipped = tag, 1
        elif tag == "a":
            self.inlink = self.stack[-1]

    def push(self, tag: str, label: str) -> None:
        up = self.stack[-1]
        if len(self.stack) > DEEPEST:
            up = self.stack[DEEPEST - 1]
        node = up.kids.get(label)
        if node is None:
            node = up.kids[label] = Node(label, tag, up)
        self.stack.append(node)

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.skip = ""
            node = self.opened(HEADS if tag in HEADS else {tag}, {"table"} - {tag} if tag not in ("div", "section", "article", "main", "body") else set())
            if node:
                self.pop(node)
        elif self.skip:
            self.skipped -= tag == self.skip
            if not self.skipped:
                self.skip = ""
        elif tag == "a":
            self.inlink = None
        elif tag in ("td", "th"):
            self.text.append(" ")

    def shape(self) -> str:
        """Nodes in tree order as lines of depth and label; numbers the nodes."""
        lines, todo = [], [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            node.at = len(lines)
            lines.append(f"{depth} {node.label}")
            todo.extend((k, depth + 1) for k in reversed(node.kids.values()))
        return "\n".join(lines)


BLOCK_TYPE = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("t", pa.string())]))


def parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, host, shape, and the blocks: place n, hash h, characters c, those in links l, text t."""
    sh.ship(pages.sparkSession)
    keep = [c for c in keep if c not in ("host__", "shape__", "blocks__")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    source = pages.select(*[f"`{c}`" for c in keep], host.alias("host__"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html__"))
    kept = pages.select(*[f"`{c}`" for c in keep]).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "host__ string, shape__ string, blocks__ array<struct<n: int, h: bigint, c: int, l: int, t: string>>"])

    def run(batches):
        for batch in batches:
            _, at = sh.packed(batch.column(batch.num_columns - 1))
            for i, j in sh.pieces(at):
                part = batch.slice(i, j - i)
                shapes, blocks = [], []
                for value in part.column(part.num_columns - 1):
                    page = Page(value.as_py())
                    shapes.append(page.shape())
                    blocks.append([{"n": n.at, "h": xxhash.xxh3_64_intdigest(t, c) - (1 << 63), "c": len(t), "l": c, "t": t} for n, t, c in page.blocks])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shapes, pa.string()), pa.array(blocks, BLOCK_TYPE)], names=[*keep, "host__", "shape__", "blocks__"])

    return source.mapInArrow(run, schema).withColumn("shape_id__", F.xxhash64("shape__"))


# ---- alignment of shapes -----------------------------------------------------------------------------


class Shape:
    """Labels, children by label and parents of the nodes of a shape."""

    def __init__(self, text: str):
        self.labels, self.kids, self.up, path = [], [], [], []
        for i, line in enumerate(text.split("\n")):
            depth, label = line.split(" ", 1)
            del path[int(depth) :]
            self.labels.append(label)
            self.kids.append({})
            self.up.append(path[-1] if path else -1)
            if path:
                self.kids[path[-1]][label] = i
            path.append(i)

    def roles(self) -> np.ndarray:
        """0: text, 1: left out by its labels, 2: in the main element."""
        out = np.zeros(len(self.labels), np.int32)
        for i, label in enumerate(self.labels):
            above = out[self.up[i]] if i else 0
            tag, *words = label.split(" ")
            main = tag in MAIN_TAGS or ("main" in words and "role" not in words and tag in ("div", "section") and len(words) == 1)
            out[i] = 1 if above == 1 or noisy(label) else 2 if above == 2 or main else 0
        return out


@lru_cache(4096)
def shape_of(text: str) -> Shape:
    return Shape(text)


def matching(a: Shape, b: Shape) -> tuple[int, np.ndarray]:
    """Simple tree matching: number of matched nodes and for each node of ``a`` its match in ``b``, or -1.

    Children of two matched nodes are matched by equal label, keeping their order, with the heaviest total. A label occurs
    once among siblings, so the pairs are given and the heaviest rising run of them is found with a table of best totals.
    """
    weight: dict[int, int] = {}
    chosen: dict[int, list[tuple[int, int]]] = {}
    todo = [(0, 0, False)]
    while todo:
        x, y, ready = todo.pop()
        pairs = [(i, b.kids[y][label]) for label, i in a.kids[x].items() if label in b.kids[y]]
        if not ready:
            todo.append((x, y, True))
            todo.extend((i, j, False) for i, j in pairs)
            continue
        ends: list[tuple[int, int, int]] = []  # (place in b, best total ending there or before, index of the pair), totals rising
        back = []
        for k, (i, j) in enumerate(pairs):
            p = bisect_left(ends, (j,))
            total = weight[i] + (ends[p - 1][1] if p else 0)
            back.append(ends[p - 1][2] if p else -1)
            q = p
            while q < len(ends) and ends[q][1] <= total:
                q += 1
            ends[p:q] = [(j, total, k)]
        picked, k = [], ends[-1][2] if ends else -1
        while k >= 0:
            picked.append(pairs[k])
            k = back[k]
        weight[x], chosen[x] = 1 + (ends[-1][1] if ends else 0), picked
    found = np.full(len(a.labels), -1, np.int64)
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        found[x] = y
        todo.extend(chosen[x])
    return weight[0], found


def aligned(shapes: DataFrame, references: int) -> DataFrame:
    """(host, shape, contents) -> (host, shape id, contents, nodes: place number, wrapper and node it matches, role)."""
    ranked = top_per_key(shapes, ["host__"], references, F.desc("contents__"), F.asc("shape_id__"), name="order__")
    # at most ``references`` shapes in a list
    wrappers = ranked.groupBy("host__").agg(F.sort_array(F.collect_list(F.struct("order__", "shape_id__", "shape__"))).alias("wrappers__"))
    source = join_per_key(shapes, wrappers, ["host__"]).select("host__", "shape_id__", "contents__", "shape__", "wrappers__")

    def run(batches):
        for batch in batches:
            nodes = []
            for own, text, wraps in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                shape, best = Shape(text), (0.0, own, None)
                for w in wraps or []:
                    model = shape_of(w["shape__"])
                    n, found = matching(shape, model)
                    score = 2 * n / (len(shape.labels) + len(model.labels))
                    if score > best[0]:
                        best = (score, w["shape_id__"], found)
                found = best[2] if best[2] is not None else np.arange(len(shape.labels))
                nodes.append([{"n": i, "ref": best[1] if m >= 0 else own, "slot": int(m) if m >= 0 else i, "role": int(r)}
                              for i, (m, r) in enumerate(zip(found, shape.roles()))])
            kind = pa.list_(pa.struct([("n", pa.int32()), ("ref", pa.int64()), ("slot", pa.int32()), ("role", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, kind)], names=["host__", "shape_id__", "contents__", "nodes__"])

    return source.mapInArrow(run, "host__ string, shape_id__ long, contents__ long, nodes__ array<struct<n: int, ref: bigint, slot: int, role: int>>")


# ---- evidence ----------------------------------------------------------------------------------------


def wrapper_rules(pages: DataFrame, references: int = REFERENCES, constant: float = CONSTANT, least: int = LEAST, links: float = LINKS) -> DataFrame:
    """(host, shape id, rules): for each place of a shape its role, and the hashes of its constant texts."""
    marks = F.array_distinct(F.transform("blocks__", lambda b: F.struct(b["n"].alias("n"), b["h"].alias("h"), b["c"].alias("c"), b["l"].alias("l"))))
    contents = pages.select("host__", "shape_id__", "shape__", marks.alias("marks__")).withColumn("content__", F.xxhash64("marks__"))
    contents = contents.groupBy("host__", "shape_id__", "content__").agg(F.first("marks__").alias("marks__"), F.first("shape__").alias("shape__"))
    contents = sh.save(contents, "wrapper-contents")
    shapes = contents.groupBy("host__", "shape_id__").agg(F.first("shape__").alias("shape__"), F.count("*").alias("contents__"))
    wraps = sh.save(aligned(shapes, references), "wrapper-shapes")
    places = wraps.select("host__", "shape_id__", "contents__", F.inline("nodes__"))

    seen = contents.where("host__ <> ''").select("host__", "shape_id__", F.inline("marks__"))
    seen = seen.groupBy("host__", "shape_id__", "n", "h").agg(F.count("*").alias("pages"), F.sum("c").alias("c"), F.sum("l").alias("l"))
    one = wraps.select("host__", "shape_id__", "nodes__")
    slotted = join_per_key(seen, one, ["host__", "shape_id__"], "inner").select(
        "host__", F.expr("nodes__[n].ref").alias("ref"), F.expr("nodes__[n].slot").alias("slot"), "h", "pages", "c", "l")
    texts = sh.save(slotted.groupBy("host__", "ref", "slot", "h").agg(*[F.sum(x).alias(x) for x in ("pages", "c", "l")]), "wrapper-texts")

    key = ["host__", "ref", "slot"]
    have = places.groupBy(*key).agg(F.sum("contents__").alias("have"))
    linked = texts.groupBy(*key).agg((F.sum("l") >= links * F.sum("c")).alias("linked"))
    fixed = join_per_key(texts.where(F.col("pages") >= least), have, key, "inner").where(F.col("pages") >= constant * F.col("have"))
    # a place holds few constants: their pages add up to at least ``constant`` times its pages each
    fixed = fixed.groupBy(*key).agg(F.collect_list("h").alias("fixed"))
    slots = have.join(linked, key, "left").join(fixed, key, "left").drop("have")
    rule = F.struct("n", F.when((F.col("role") == 0) & F.coalesce("linked", F.lit(False)), 1).otherwise(F.col("role")).alias("role"), F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"))
    return join_per_key(places, slots, key).groupBy("host__", "shape_id__").agg(F.sort_array(F.collect_list(rule)).alias("rules__"))


def extract(pages: DataFrame, keep: list[str], references: int = REFERENCES, constant: float = CONSTANT, least: int = LEAST, links: float = LINKS) -> DataFrame:
    """``keep`` columns and the main ``text`` of every page; see the top of the module for odd cases."""
    keep = [c for c in keep if c != "text"]
    read = sh.save(parsed(pages, keep), "wrapper-pages")
    rules = sh.save(wrapper_rules(read, references, constant, least, links), "wrapper-rules")
    # Few rules go to the pages; more of them are met by key, with the pages of a shape spread.
    size = rules.agg(F.sum(F.aggregate("rules__", F.lit(0), lambda n, r: n + 1 + F.size(r["fixed"])))).first()[0] or 0
    key = ["host__", "shape_id__"]
    joined = read.drop("shape__").join(F.broadcast(rules), key, "left") if size <= SENT else join_per_key(read.drop("shape__"), rules, key)
    role = lambda b: F.expr("1") if b is None else F.get("rules__", b["n"])["role"]
    varying = lambda b: (role(b) != 1) & ~F.array_contains(F.get("rules__", b["n"])["fixed"], b["h"])
    joined = joined.withColumn("blocks__", F.filter("blocks__", varying)).withColumn("main__", F.filter("blocks__", lambda b: role(b) == 2))
    chosen = F.when(F.size("main__") > 0, F.col("main__")).otherwise(F.col("blocks__"))
    return joined.withColumn("text__", F.array_join(F.transform(chosen, lambda b: b["t"]), "\n\n")).select(*[f"`{c}`" for c in keep], F.col("text__").alias("text"))


def digest(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
