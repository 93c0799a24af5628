"""Point in polygon, overlap areas and area assignment over a grid.

Points meet a cover of the polygons cell by cell (``cover``), so a polygon is spread over its cells and no join carries its
rings; the points of a cell are spread too. Overlap areas are sums over strips of x (``overlap_shares``), in which only
edges that share a strip meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.operators.joins import first_per_key, join_per_key

# Polygon tables: area_id, area_order, parts = array of polygons, each an array of rings (outer ring first,
# then holes), each ring an array of [x, y].


def _coordinates(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Odd number of edges crossed by the ray to the right of the point."""
    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))  # previous corner, closing the ring
        spans = (p[1] > y) != (q[1] > y)
        return spans & (x < F.try_divide((q[0] - p[0]) * (y - p[1]), q[1] - p[1]) + p[0])

    return F.size(F.filter(ring, lambda p, i: F.coalesce(crosses(p, i), F.lit(False)))) % 2 == 1


def polygon_contains(parts: Column, x: Column, y: Column) -> Column:
    """In an outer ring and in none of its holes, for any part."""
    def part_contains(rings: Column) -> Column:
        holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
        return ring_contains(F.element_at(rings, 1), x, y) & ~F.exists(holes, lambda h: ring_contains(h, x, y))

    return F.exists(parts, lambda rings: (F.size(rings) > 0) & part_contains(rings))


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def box(polygons: DataFrame) -> DataFrame:
    pts = _coordinates(F.col("parts"))
    xs, ys = F.transform(pts, lambda p: p[0]), F.transform(pts, lambda p: p[1])
    return polygons.select(
        "*", F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"),
        F.array_max(ys).alias("y_max"))


BOX = ("x_min", "x_max", "y_min", "y_max")


def on_grid(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """Key and box of each polygon, repeated for the grid cells of the box; the rings stay behind."""
    return (
        box(polygons.select(key, "parts")).drop("parts").where("x_min is not null")
        .withColumn("_cx", F.explode(F.sequence(_cell(F.col("x_min"), size), _cell(F.col("x_max"), size))))
        .withColumn("_cy", F.explode(F.sequence(_cell(F.col("y_min"), size), _cell(F.col("y_max"), size))))
    )


#: A dense cell is split into SPLIT x SPLIT smaller ones.
SPLIT = 8


def part_edges(polygons: DataFrame, key: str) -> DataFrame:
    """(key, part, px, py, qx, qy): the edges of each part, holes included, one row each."""
    rings = polygons.select(key, F.posexplode("parts").alias("part", "rings")).select(key, "part", F.explode("rings").alias("ring"))
    before = lambda i: F.element_at("ring", F.when(i == 0, F.size("ring")).otherwise(i))
    edge = F.transform("ring", lambda p, i: F.struct(p[0].alias("px"), p[1].alias("py"), before(i)[0].alias("qx"), before(i)[1].alias("qy")))
    return rings.select(key, "part", F.inline(edge))


def cells_crossed(edges: DataFrame, key: str, size: float) -> DataFrame:
    """Edges by the cells of their way: for each row of cells only the columns that the edge passes there (and one more on
    each side, against rounding)."""
    low, high = F.least("py", "qy"), F.greatest("py", "qy")
    rows = edges.withColumn("_cy", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    at = lambda y: F.when(F.col("py") == F.col("qy"), F.col("px")).otherwise(F.col("px") + (F.col("qx") - F.col("px")) * (y - F.col("py")) / F.nullif(F.col("qy") - F.col("py"), F.lit(0.0)))
    bottom, top = F.greatest(F.col("_cy") * size, low), F.least((F.col("_cy") + 1) * size, high)
    flat = F.col("py") == F.col("qy")
    ends = [F.when(flat, F.col(c)).otherwise(at(y)) for c, y in (("px", bottom), ("qx", top))]
    left, right = _cell(F.least(*ends), size), _cell(F.greatest(*ends), size)
    least, most = _cell(F.least("px", "qx"), size), _cell(F.greatest("px", "qx"), size)
    return rows.withColumn("_cx", F.explode(F.sequence(F.greatest(left - 1, least), F.least(right + 1, most))))


def cover(edges: DataFrame, key: str, size: float) -> DataFrame:
    """(key, part, _cx, _cy, inside, edges): the cells a part touches. ``inside``: whether its upper right corner lies in
    the part; ``edges``: those that pass the cell, none for a cell wholly inside.

    The state of a corner is the parity of the edges that cross the cell's upper line to the right of it, from one running
    sum per line; nothing but that sum looks beyond the cell. Holes lie in their part and don't overlap each other.
    """
    passed = cells_crossed(edges, key, size).groupBy(key, "part", "_cx", "_cy").agg(F.collect_list(F.struct("px", "py", "qx", "qy")).alias("edges"))
    # crossings of the line above each row of cells, by the cell whose right end is the last one not beyond them
    line = edges.withColumn("_cy", F.explode(F.sequence(_cell(F.least("py", "qy"), size) - 1, _cell(F.greatest("py", "qy"), size))))
    y = (F.col("_cy") + 1) * size
    line = line.where((F.col("py") > y) != (F.col("qy") > y))
    x = (F.col("qx") - F.col("px")) * (y - F.col("py")) / (F.col("qy") - F.col("py")) + F.col("px")
    crossed = line.select(key, "part", "_cy", _cell(x, size).alias("_cx")).groupBy(key, "part", "_cy", "_cx").agg(F.count("*").alias("n"))
    spans = edges.groupBy(key, "part").agg(*[f(F.col(c)).alias(n) for n, f, c in (
        ("x0", F.min, "px"), ("x1", F.max, "px"), ("y0", F.min, "py"), ("y1", F.max, "py"))])
    box_ = spans.withColumn("_cy", F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size)))).withColumn(
        "_cx", F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size)))).drop("x0", "x1", "y0", "y1")
    keys = [key, "part", "_cy", "_cx"]
    right = Window.partitionBy(key, "part", "_cy").orderBy(F.desc("_cx")).rowsBetween(Window.unboundedPreceding, -1)
    cells = box_.join(crossed, keys, "left").withColumn("inside", F.coalesce(F.sum("n").over(right), F.lit(0)) % 2 == 1).drop("n")
    cells = cells.join(passed, keys, "left").withColumn("edges", F.coalesce("edges", F.array().cast(passed.schema["edges"].dataType)))
    return cells.where(F.col("inside") | (F.size("edges") > 0))


def in_cell(x: Column, y: Column, inside: Column, edges: Column, right: Column, top: Column) -> Column:
    """Whether a point of a cell lies in the part: from the point to the right end of its cell and up to the corner, each
    edge on the way changes the side."""
    def changes(e: Column) -> Column:
        px, py, qx, qy = (e[c] for c in ("px", "py", "qx", "qy"))
        at_y = F.when((py > y) != (qy > y), F.try_divide((px - qx) * (y - qy), py - qy) + qx)
        at_x = F.when((px >= right) != (qx >= right), F.try_divide((py - qy) * (right - qx), px - qx) + qy)
        across = F.coalesce((x < at_y) & (at_y < right), F.lit(False))
        return across != F.coalesce((y < at_x) & (at_x <= top), F.lit(False))

    return inside != (F.size(F.filter(edges, changes)) % 2 == 1)


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, key: str = "area_id", dense: int | None = None) -> DataFrame:
    """(point, area) pairs where the area contains the point. ``points``: x, y and any id columns; ``key`` is unique
    among the polygons, whose other columns come along. Cells with more than ``dense`` edges (a size at which the edges of
    one cell should not be gone through for each point) are split one level down.

    One row per cell holds the parts that touch it; points meet it through ``join_per_key``, so neither a large polygon nor
    a cell with many points is one task.
    """
    edges = part_edges(polygons, key)
    packed = ["part", "inside", "edges"]
    cells = cover(edges, key, size)
    levels = cells.select(F.lit(0).alias("_level"), "_cx", "_cy", key, *packed)
    if dense is not None:
        # the edges of parts with a dense cell; a finer cell is taken only inside such a cell
        crowded = cells.where(F.size("edges") > dense).select(key, "part", F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"))
        fine = cover(edges.join(crowded.select(key, "part").distinct(), [key, "part"]), key, size / SPLIT)
        owner = {o: F.floor(F.col(c) / SPLIT).cast("bigint") for o, c in (("_ox", "_cx"), ("_oy", "_cy"))}
        fine = fine.withColumns(owner).join(crowded, [key, "part", "_ox", "_oy"], "left_semi")
        levels = levels.where(F.size("edges") <= dense).unionByName(fine.select(F.lit(1).alias("_level"), "_cx", "_cy", key, *packed))
    per_cell = levels.groupBy("_level", "_cx", "_cy").agg(F.collect_list(F.struct(key, *packed)).alias("_held"))
    sized = points.withColumn("_level", F.lit(0) if dense is None else F.explode(F.lit([0, 1])))
    sized = sized.withColumn("_size", F.when(F.col("_level") == 0, float(size)).otherwise(size / SPLIT))
    p = sized.withColumns({c: F.floor(F.col(v) / F.col("_size")).cast("bigint") for c, v in (("_cx", "x"), ("_cy", "y"))})
    met = join_per_key(p, per_cell, ["_level", "_cx", "_cy"], "inner")
    here = F.filter("_held", lambda h: in_cell(F.col("x"), F.col("y"), h["inside"], h["edges"], (F.col("_cx") + 1) * F.col("_size"), (F.col("_cy") + 1) * F.col("_size")))
    # overlapping parts of an area count once
    areas = F.array_distinct(F.transform(here, lambda h: h[key]))
    found = met.withColumn(key, F.explode(areas)).drop("_level", "_size", "_cx", "_cy", "_held")
    return found.join(polygons.drop("parts"), key) if len(polygons.columns) > 2 else found


def signed_edges(parts: Column) -> Column:
    """Edges (x1, y1, x2, y2 with x1 < x2, sign) of all rings. A polygon is the sum of the areas under its edges, each
    times its sign: against the direction of the edge, turned for clockwise rings and again for holes."""
    def turned(ring: Column, hole: Column) -> Column:
        before = lambda i: F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))
        twice = F.aggregate(F.transform(ring, lambda p, i: before(i)[0] * p[1] - p[0] * before(i)[1]), F.lit(0.0), lambda a, x: a + x)
        return F.struct(ring.alias("ring"), (F.signum(twice) * F.when(hole, -1.0).otherwise(1.0)).alias("turn"))

    def of_ring(r: Column) -> Column:
        ring, turn = r["ring"], r["turn"]

        def edge(p: Column, i: Column) -> Column:
            q = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))
            right = p[0] > q[0]
            side = lambda k, first: F.when(right == F.lit(first), q[k]).otherwise(p[k])
            return F.struct(side(0, True).alias("x1"), side(1, True).alias("y1"), side(0, False).alias("x2"), side(1, False).alias("y2"),
                            (-F.signum(p[0] - q[0]) * turn).alias("sign"))

        return F.filter(F.transform(ring, edge), lambda e: e["sign"] != 0)

    # the direction of a ring is found once, before its edges
    return F.flatten(F.transform(parts, lambda rings: F.flatten(F.transform(F.transform(rings, lambda ring, i: turned(ring, i > 0)), of_ring))))


def polygon_area(edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["sign"] * (e["x2"] - e["x1"]) * (e["y1"] + e["y2"]) / 2)


def under_both(e: str, g: str) -> Column:
    """Signed area under the lower of two edges (struct columns) over the x range ``lo`` to ``hi`` that both have."""
    at = lambda s, x: F.col(f"{s}.y1") + (F.col(f"{s}.y2") - F.col(f"{s}.y1")) * (x - F.col(f"{s}.x1")) / (F.col(f"{s}.x2") - F.col(f"{s}.x1"))
    a, b = F.col("lo"), F.col("hi")
    ea, eb, ga, gb = at(e, a), at(e, b), at(g, a), at(g, b)
    da, db = ea - ga, eb - gb
    t = F.try_divide(da, da - db)
    c, yc = a + t * (b - a), ea + t * (eb - ea)
    low_a, low_b = F.least(ea, ga), F.least(eb, gb)
    area = F.when(da * db < 0, (low_a + yc) / 2 * (c - a) + (yc + low_b) / 2 * (b - c)).otherwise((low_a + low_b) / 2 * (b - a))
    return F.col(f"{e}.sign") * F.col(f"{g}.sign") * area


def overlap_areas(pairs: DataFrame, ids: list[str], left: str, right: str) -> DataFrame:
    """``ids`` and the ``shared`` area of two polygons given by their signed edges (array columns), exactly.

    The x range that both have is cut into strips, one for every four edges, fewer if the edges together cover the range
    many times. Edges are cut at strips, and only pieces of one strip meet, so the cost is about edges plus crossings;
    polygons whose every edge spans the whole range fall back to one strip. A pair of detailed polygons is spread over
    tasks by its strips.
    """
    ends = lambda c, f, e: f(F.transform(c, lambda x: x[e]))
    lo, hi = (F.greatest(ends(left, F.array_min, "x1"), ends(right, F.array_min, "x1")), F.least(ends(left, F.array_max, "x2"), ends(right, F.array_max, "x2")))
    ranged = pairs.select(*ids, left, right, lo.alias("from"), hi.alias("to")).where("from < to")
    width = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + F.greatest(F.least(e["x2"], F.col("to")) - F.greatest(e["x1"], F.col("from")), F.lit(0.0)))
    turns = (width(left) + width(right)) / (F.col("to") - F.col("from"))
    strips = F.ceil((F.size(left) + F.size(right)) / F.greatest(F.lit(4.0), turns)).cast("int")
    ranged = ranged.withColumn("strips", strips).withColumn("wide", (F.col("to") - F.col("from")) / F.col("strips"))

    def pieces(column: str, name: str) -> DataFrame:
        one = ranged.select(*ids, "from", "to", "strips", "wide", F.explode(column).alias(name)).where(
            (F.col(f"{name}.x1") < F.col("to")) & (F.col(f"{name}.x2") > F.col("from")))
        place = lambda x: F.least(F.greatest(F.floor((x - F.col("from")) / F.col("wide")), F.lit(0)), F.col("strips") - 1).cast("int")
        return one.withColumn("strip", F.explode(F.sequence(place(F.col(f"{name}.x1")), place(F.col(f"{name}.x2")))))

    mine = pieces(left, "e")
    met = mine.join(pieces(right, "g").select(*ids, "strip", "g"), [*ids, "strip"])
    start, end = F.col("from") + F.col("strip") * F.col("wide"), F.when(F.col("strip") == F.col("strips") - 1, F.col("to")).otherwise(F.col("from") + (F.col("strip") + 1) * F.col("wide"))
    met = met.withColumn("lo", F.greatest(F.col("e.x1"), F.col("g.x1"), start)).withColumn("hi", F.least(F.col("e.x2"), F.col("g.x2"), end)).where("lo < hi")
    return met.groupBy(*ids).agg(F.sum(under_both("e", "g")).alias("shared"))


def overlaps(subjects: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(subject_id, area_id, area_order, share): the share of each subject's own polygon that lies in an area.

    Boxes meet in the first cell that both have, so a pair comes once.
    """
    mine = on_grid(subjects, "subject_id", size).withColumnsRenamed({c: f"s_{c}" for c in BOX})
    met = mine.join(on_grid(polygons, "area_id", size), ["_cx", "_cy"])
    for axis in "xy":
        first = F.greatest(_cell(F.col(f"s_{axis}_min"), size), _cell(F.col(f"{axis}_min"), size))
        met = met.where((F.col(f"_c{axis}") == first) & (F.col(f"s_{axis}_min") < F.col(f"{axis}_max")) & (F.col(f"{axis}_min") < F.col(f"s_{axis}_max")))
    pairs = met.select("subject_id", "area_id")
    pairs = pairs.join(subjects.select("subject_id", signed_edges(F.col("parts")).alias("_s")), "subject_id")
    pairs = pairs.join(polygons.select("area_id", "area_order", signed_edges(F.col("parts")).alias("_a")), "area_id")
    whole = pairs.select("subject_id", "area_id", "area_order", "_s", "_a", polygon_area(F.col("_s")).alias("whole"))
    shared = overlap_areas(whole, ["subject_id", "area_id", "area_order", "whole"], "_s", "_a")
    return shared.select("subject_id", "area_id", "area_order", F.bround(F.try_divide("shared", "whole"), 9).alias("share")).where("share > 0")


def in_bounds(x: Column, y: Column, west: float, east: float, south: float, north: float) -> Column:
    return (x > west) & (x < east) & (y > south) & (y < north)


def assign(subjects: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Area of each subject: the one with its point, else the largest overlap share, else unassigned.

    ``subjects``: subject_id, x, y (its point) and ``parts`` (its own polygon, may be null).
    """
    inside = points_in_polygons(subjects.select("subject_id", "x", "y"), polygons, size)
    by_point = first_per_key(inside, ["subject_id"], F.col("area_order")).select(
        "subject_id", "area_id", F.lit("representative_point").alias("method"), F.lit(1.0).alias("share"))
    rest = subjects.where("parts is not null").join(by_point.select("subject_id"), "subject_id", "left_anti")
    best = first_per_key(overlaps(rest, polygons, size), ["subject_id"], F.desc("share"), F.col("area_order")).select(
        "subject_id", "area_id", F.lit("dominant_overlap").alias("method"), "share")
    found = by_point.unionByName(best)
    out = subjects.select("subject_id").join(found, "subject_id", "left")
    strong = (F.col("share") >= 0.5) | (F.col("method") == "representative_point")
    return out.select(
        F.concat_ws("->", F.col("subject_id").cast("string"), F.coalesce(F.col("area_id").cast("string"), F.lit("unassigned")))
        .alias("assignment_id"),
        "subject_id", "area_id", F.coalesce("method", F.lit("unassigned")).alias("method"),
        F.bround(F.coalesce("share", F.lit(0.0)), 4).alias("share"), F.col("area_id").isNotNull().alias("is_primary"),
        F.when(F.col("area_id").isNull(), "unavailable").when(strong, "strong").otherwise("representative")
        .alias("quality"),
    )


def by_area_name(subjects: DataFrame, column: str, name: str) -> DataFrame:
    """Subjects whose (possibly composite) area name matches, contains or is contained in ``name``."""
    own, target = F.upper(F.coalesce(column, F.lit(""))), name.upper()
    return subjects.where((own == target) | own.contains(target) | F.lit(target).contains(own))


def layer_rows(features: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Features with key, join method and confidence, and the review rows for what is wrong with them.

    ``features``: ``order`` (input position), ``key`` and ``parts``. Features without geometry go to review
    only; a missing or repeated key is reported and the feature stays.
    """
    has_shape = F.coalesce(F.size(F.flatten(F.flatten("parts"))) > 0, F.lit(False))
    good = features.where(has_shape)
    firsts = good.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("prior"))
    tagged = join_per_key(good, firsts, [key], "left")
    repeat = F.col("prior").isNotNull() & (F.col(order) != F.col("prior"))
    layer = tagged.select(
        order, key, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("index:"), F.col(order).cast("string")))
        .alias("feature_id"),
        F.when(F.col(key).isNull(), "unmatched").otherwise("key").alias("join_method"),
        F.when(F.col(key).isNull(), "none").otherwise("high").alias("join_confidence"))
    review = (
        features.where(~has_shape).select(order, key, F.lit("empty_or_missing_geometry").alias("kind"))
        .unionByName(tagged.where(F.col(key).isNull()).select(order, key, F.lit("missing_key").alias("kind")))
        .unionByName(tagged.where(repeat).select(order, key, F.lit("duplicate_key").alias("kind")))
    )
    return layer, review


def roll_up(polygons: DataFrame, group: str) -> DataFrame:
    """Count and bounding box of the areas of each group."""
    return box(polygons).groupBy(group).agg(
        F.count("*").alias("areas"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
        F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
