"""Points, polygons and area assignment; shapes are derived from keys by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import spatial, snapshot
from parcelwise.plans.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

GRID = 10.0


def _pt(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def polygons(spark, sf) -> DataFrame:
    """A five-sided area per nation on a grid; some overlap, some have a hole, some a second part."""
    n = F.col("n_nationkey")
    x, y, w = (n % 5) * 10, F.floor(n / 5) * 10, (n % 3) * 2 + 8
    outer = F.array(_pt(x, y), _pt(x + w, y), _pt(x + w, y + 6), _pt(x + w / 2, y + 9), _pt(x, y + 6))
    hole = F.array(_pt(x + 3, y + 3), _pt(x + 5, y + 3), _pt(x + 4, y + 5))
    second = F.array(_pt(x + 60, y), _pt(x + 64, y), _pt(x + 62, y + 5))
    first = F.when(n % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    parts = F.when(n % 7 == 0, F.array(first, F.array(second))).otherwise(F.array(first))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_nationkey").alias("area_order"), parts.alias("parts"), "n_regionkey")


def points(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("subject_id"), ((k * 37 % 7000) / 100 + 0.003).alias("x"), ((k * 91 % 5000) / 100 + 0.003).alias("y"))


_SHAPES = """
    nat as (select n_nationkey as a, n_regionkey, (n_nationkey % 5) * 10.0::double as x, (n_nationkey // 5) * 10.0::double as y, (n_nationkey % 3) * 2.0::double + 8 as w from nation),
    rings as (
      select a, 0 as part, 0 as ring, [[x, y], [x + w, y], [x + w, y + 6], [x + w / 2, y + 9], [x, y + 6]] as pts from nat
      union all select a, 0, 1, [[x + 3, y + 3], [x + 5, y + 3], [x + 4, y + 5]] from nat where a % 2 = 0
      union all select a, 1, 0, [[x + 60, y], [x + 64, y], [x + 62, y + 5]] from nat where a % 7 = 0),
    edges as (select a, part, ring, pts[i] as p, pts[case when i = 1 then len(pts) else i - 1 end] as q
              from (select *, unnest(range(1, len(pts) + 1)) as i from rings)),
    pts as (select c_custkey as s, (c_custkey * 37 % 7000) / 100 + 0.003 as px, (c_custkey * 91 % 5000) / 100 + 0.003 as py from customer)"""


def _inside(src: str, ids: str) -> str:
    """(ids, a) pairs with the point inside area a, for a subquery with ids, px, py."""
    return f"""select distinct {ids}, a from (
        select {ids}, a, part, bool_or(odd) filter (where ring = 0) as o, coalesce(bool_or(odd) filter (where ring > 0), false) as h from (
          select {ids}, a, part, ring, count(*) filter (where (p[2] > py) <> (q[2] > py) and px < (q[1] - p[1]) * (py - p[2]) / (q[2] - p[2]) + p[1]) % 2 = 1 as odd
          from {src}, edges group by all) group by all) where o and not h"""


@R.add("q_point_in_polygon", f"with {_SHAPES} select s as subject_id, a as area_id from ({_inside('(select s, px, py from pts)', 's, px, py')})")
def _(spark, sf):
    return spatial.points_in_polygons(points(spark, sf), polygons(spark, sf), GRID).select("subject_id", "area_id")


def shaped_subjects(spark, sf) -> DataFrame:
    """Suppliers with a point and a square of their own beside it."""
    k = F.col("s_suppkey")
    x, y = (k * 53 % 6600) / 100 + 0.003, (k * 71 % 5600) / 100 + 0.003
    square = F.array(_pt(x - 1, y - 3), _pt(x + 5, y - 3), _pt(x + 5, y + 3), _pt(x - 1, y + 3))
    return table(spark, sf, "supplier").select(k.alias("subject_id"), x.alias("x"), y.alias("y"), F.when(k % 4 != 0, F.array(F.array(square))).alias("parts"))


@R.add("q_assign_area", f"""with {_SHAPES},
    sup as (select s_suppkey as s, (s_suppkey * 53 % 6600) / 100 + 0.003 as px, (s_suppkey * 71 % 5600) / 100 + 0.003 as py from supplier),
    direct as (select s, min(a) as a from ({_inside('sup', 's, px, py')}) group by 1),
    turned as (select *, sum(q[1] * p[2] - p[1] * q[2]) over (partition by a, part, ring) as twice from edges),
    ae as (select a, least(p[1], q[1]) as x1, greatest(p[1], q[1]) as x2, case when q[1] < p[1] then q[2] else p[2] end as y1, case when q[1] < p[1] then p[2] else q[2] end as y2,
                  -sign(p[1] - q[1]) * sign(twice) * case when ring > 0 then -1 else 1 end as sg from turned where p[1] <> q[1]),
    se as (select s, px - 1 as x1, px + 5 as x2, py + d as y, sign(d) as sg from sup, (select unnest([-3.0, 3.0]::double[]) as d)
           where s % 4 <> 0 and s not in (select s from direct)),
    lines as (select s, a, se.sg * ae.sg as sg, greatest(se.x1, ae.x1) as l, least(se.x2, ae.x2) as r, y, y1 + (y2 - y1) * (greatest(se.x1, ae.x1) - ae.x1) / (ae.x2 - ae.x1) as gl,
                     y1 + (y2 - y1) * (least(se.x2, ae.x2) - ae.x1) / (ae.x2 - ae.x1) as gr from se, ae where greatest(se.x1, ae.x1) < least(se.x2, ae.x2)),
    overlap as (select s, a, round_even(sum(sg * case when (y - gl) * (y - gr) < 0
             then (least(y, gl) + y) / 2 * (r - l) * (y - gl) / (gr - gl) + (y + least(y, gr)) / 2 * (r - l) * (1 - (y - gl) / (gr - gl))
             else (least(y, gl) + least(y, gr)) / 2 * (r - l) end) / 36, 9) as share
      from lines group by 1, 2 having round_even(sum(sg * case when (y - gl) * (y - gr) < 0
             then (least(y, gl) + y) / 2 * (r - l) * (y - gl) / (gr - gl) + (y + least(y, gr)) / 2 * (r - l) * (1 - (y - gl) / (gr - gl))
             else (least(y, gl) + least(y, gr)) / 2 * (r - l) end) / 36, 9) > 0
      qualify row_number() over (partition by s order by share desc, a) = 1)
    select sup.s as subject_id, coalesce(d.a, o.a) as area_id,
      case when d.a is not null then 'representative_point' when o.a is not null then 'dominant_overlap' else 'unassigned' end as method,
      round_even(case when d.a is not null then 1 else coalesce(o.share, 0) end, 4) as share,
      case when d.a is null and o.a is null then 'unavailable' when d.a is not null or o.share >= 0.5 then 'strong' else 'representative' end as quality
    from sup left join direct d on d.s = sup.s left join overlap o on o.s = sup.s""")
def _(spark, sf):
    return spatial.assign(shaped_subjects(spark, sf), polygons(spark, sf), GRID).select("subject_id", "area_id", "method", "share", "quality")


@R.add("q_subjects_in_area", f"""with {_SHAPES}, u as (select o_custkey as s, count(*) as n from orders group by 1),
    hits as (select 'name' as kind, c_custkey as s from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name in ('ASIA')
      union all select 'zip', c_custkey from customer where c_nationkey = 7
      union all select 'shape', s from ({_inside('(select s, px, py from pts)', 's, px, py')}) where a = 3)
    select kind, count(*) as subjects, sum(coalesce(n, 0))::bigint as units from hits left join u using (s) group by 1""")
def _(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    by_name = spatial.by_area_name(named, "r_name", "Asia").select(F.lit("name").alias("kind"), F.col("c_custkey").alias("s"))
    by_zip = c.where("c_nationkey = 7").select(F.lit("zip").alias("kind"), F.col("c_custkey").alias("s"))
    shape = polygons(spark, sf).where("area_id = 3")
    by_shape = spatial.points_in_polygons(points(spark, sf), shape, GRID).select(F.lit("shape").alias("kind"), F.col("subject_id").alias("s"))
    units = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("s")).agg(F.count("*").alias("n"))
    return by_name.unionByName(by_zip).unionByName(by_shape).join(units, "s", "left").groupBy("kind").agg(
        F.count("*").alias("subjects"), F.sum(F.coalesce("n", F.lit(0))).alias("units"))


@R.add("q_bounds_check", "select c_custkey as subject_id from customer where (c_custkey * 37 % 7000) / 100 + 0.003 < 20 and (c_custkey * 91 % 5000) / 100 + 0.003 > 40")
def _(spark, sf):
    return points(spark, sf).where(spatial.in_bounds(F.col("x"), F.col("y"), -1, 20, 40, 60)).select("subject_id")


def features(spark, sf) -> DataFrame:
    n = F.col("area_id")
    return polygons(spark, sf).select(
        n.alias("feature_index"), F.when(n % 6 == 1, F.lit(None)).when(n % 5 == 0, "dup").otherwise(n.cast("string")).alias("key"),
        F.when(n % 9 == 4, F.lit(None)).otherwise(F.col("parts")).alias("parts"))


@R.add("q_layer_rows", """
    select n_nationkey as feature_index, case when n_nationkey % 6 = 1 then 'index:' || n_nationkey when n_nationkey % 5 = 0 then 'dup' else n_nationkey::varchar end as feature_id,
           case when n_nationkey % 6 = 1 then 'unmatched' else 'key' end as join_method, case when n_nationkey % 6 = 1 then 'none' else 'high' end as join_confidence
    from nation where n_nationkey % 9 <> 4""")
def _(spark, sf):
    return spatial.layer_rows(features(spark, sf), "key", "feature_index")[0].drop("key")


@R.add("q_layer_review", """
    with f as (select n_nationkey as i, case when n_nationkey % 6 = 1 then null when n_nationkey % 5 = 0 then 'dup' else n_nationkey::varchar end as key from nation)
    select 'areas' as layer, i as feature_index, 'empty_or_missing_geometry' as kind from f where i % 9 = 4
    union all select 'areas', i, 'missing_key' from f where i % 9 <> 4 and key is null
    union all select 'areas', i, 'duplicate_key' from f where i % 9 <> 4 and key = 'dup' and i <> (select min(i) from f where key = 'dup' and i % 9 <> 4)
    union all select 'suppliers', s_suppkey, 'negative_balance' from supplier where s_acctbal < 0""")
def _(spark, sf):
    review = spatial.layer_rows(features(spark, sf), "key", "feature_index")[1].select(F.col("feature_index").cast("bigint"), "kind")
    s = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("feature_index"), F.lit("negative_balance").alias("kind"))
    return snapshot.tagged_union({"areas": review, "suppliers": s})


@R.add("q_rollup_area", f"""with {_SHAPES}, c as (select a, unnest(pts) as p from rings)
    select n_regionkey, count(distinct c.a) as areas, min(p[1]) as x_min, max(p[1]) as x_max, min(p[2]) as y_min, max(p[2]) as y_max from c join nat on nat.a = c.a group by 1""")
def _(spark, sf):
    return spatial.roll_up(polygons(spark, sf), "n_regionkey")
