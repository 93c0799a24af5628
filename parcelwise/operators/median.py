"""Weighted medians and their replicate-weight uncertainty, exact at any group size.

A group may hold a third of all rows and all its values may lie close together, so no step puts a group into one task, and
no step sends a row once per weight. It is a radix selection on the 64-bit order of the value (``with_order``):

1. rows are reduced to one row per (group, bucket) with all weights summed side by side, before any group list is taken
   apart; a bucket is a fixed run of 2 ** ``LOW_BITS`` neighbouring doubles. Running sums of all weights over the buckets
   find for each weight the bucket that holds its middle;
2. the rows of the buckets found are reduced once more to ``BINS`` even bins between the smallest and the largest value that
   a group found there, again with all weights side by side and before group lists are taken apart, and the running sums
   go on inside it;
3. the bins found hold at most 2 ** 29 neighbouring doubles each (a hundred-millionth of the value) and far fewer that
   occur; the last pass tells those apart, weights still side by side.

Shuffled rows are bins, at most ``BINS`` for a bucket and block of weights, whatever the number of rows. Rows meet the buckets
found by a broadcast, so only rows between the bins found move before they are summed, in the last pass, by group and bin.
Weights that have their middle in one bin share it: replicates lie close together, so a row moves once and not once per weight.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.functions.typed import finite
from parcelwise.session import ensure_checkpoint_dir

EXACT = "decimal(20,8)"  # survey weights with eight decimals; ties at half the weight stay exact
WHOLE = "bigint"  # whole-number weights: long sums, faster
LOW_BITS = 44  # a first bucket is a run of so many bits' worth of neighbouring doubles, about 0.4 percent wide
BINS = 1 << 15  # even bins of a bucket
BLOCK = 16  # weights summed side by side in one row; more weights make more rows, not wider generated code


def with_order(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the place of a finite double among all doubles: its bits as a number, negative ones mirrored, both
    zeros 0. Each step is a column of its own, so it is computed once."""
    a = F.abs(F.col(value))
    rows = rows.withColumn("_e", F.floor(F.log2(a)).cast("int"))
    # a / 2 ** e, exact since powers of two are; the logarithm may be one off
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    half = F.floor(F.col("_e") / 2).cast("int")
    common = F.col("_e").between(0, 62)
    rows = rows.withColumn("_s", F.when(common, a / F.expr("shiftleft(1L, _e)").cast("double")).otherwise(a * two(-half) * two(half - F.col("_e"))))
    low, high = F.col("_s") < 1, F.col("_s") >= 2
    part = F.when(low, F.col("_s") * 2).when(high, F.col("_s") / 2).otherwise(F.col("_s"))
    bits = F.shiftleft((F.col("_e") + F.when(low, 1022).when(high, 1024).otherwise(1023)).cast("bigint"), 52) + ((part - 1) * float(2**52)).cast("bigint")
    tiny = (a * float(2.0**537) * float(2.0**537)).cast("bigint")
    # never null, so the joins on it add no filter and the plan branches stay equal
    order = F.coalesce(F.when(a >= 2.0**-1022, bits).otherwise(tiny), F.lit(0).cast("bigint"))
    return rows.withColumn(name, order).withColumn(name, F.when(F.col(value) < 0, -F.col(name)).otherwise(F.col(name))).drop("_e", "_s")


def usable_weight(weight: Column, kind: str) -> Column:
    """The weight in its exact type; zero when it is missing, not finite or not positive."""
    w = weight.try_cast("double")
    return F.when((w > 0) & (w < float("inf")), w.cast(kind)).otherwise(F.lit(0).cast(kind))


def block_width(n: int) -> int:
    """Equal block width for ``n`` weights, at most ``BLOCK``."""
    return -(-n // -(-n // BLOCK))


# replicate number (from 1) -> weight. Numbers rather than an array, so that the expression stays in generated
# code whether the weights are columns or computed.
Weights = Callable[[Column], Column]


def numbered(replicates: Column | Weights) -> Weights:
    """Replicate weights by number; an array column is read by position."""
    return (lambda i: F.get(replicates, i - 1)) if isinstance(replicates, Column) else replicates


@dataclass(frozen=True)
class Weighted:
    """Rows with a value ``_v`` and numbered weights: 0 is the full-sample weight, the replicates follow.

    Group columns named in ``explode`` stand for several groups, listed by the expression beside the name; a row counts in
    each of them.
    """

    rows: DataFrame
    weight: Column
    replicates: Column | Weights | None = None
    n_replicates: int = 0
    kind: str = EXACT
    explode: Mapping[str, Column] = field(default_factory=dict)

    def at(self, k: Column) -> Column:
        if not self.n_replicates:
            return self.weight
        return F.when(k == 0, self.weight).otherwise(numbered(self.replicates)(k))


def weighted_rows(
    rows: DataFrame, value: Column, weight: Column, replicates: Column | Weights | None = None,
    n_replicates: int = 0, kind: str = EXACT, explode: Sequence[str] | Mapping[str, Column] = (),
) -> Weighted:
    """Rows ready for ``medians``; ``value`` must not be null. Columns to ``explode`` that come without an expression are lists."""
    ordered = with_order(rows.withColumn("_v", value.cast("double")), "_v", "_o").withColumn("_k", F.shiftright("_o", LOW_BITS))
    return Weighted(ordered, weight, replicates, n_replicates, kind, explode if isinstance(explode, Mapping) else {d: F.col(d) for d in explode})


def sum_by_bin(w: Weighted, by: Sequence[str], bins: Sequence[str]) -> DataFrame:
    """One row per (group, bins, weight block): summed weights ``_w0..``, ``_bad``, the invalid rows, and the range of the
    values.

    A row is invalid when one of its replicate weights is missing, not finite or negative. Lists of groups are
    part of the key until the rows are reduced. The code per weight is kept short: a generated method over 8 kB is
    never compiled by the JVM and runs ten times slower.
    """
    n = w.n_replicates + 1
    width = block_width(n)
    blocks = -(-n // width)
    slim = w.rows.withColumn("_blk", F.explode(F.lit(list(range(blocks)))) if blocks > 1 else F.lit(0))
    cells = []
    for i in range(width):
        k = F.col("_blk") * width + i if blocks > 1 else F.lit(i)
        x = w.weight if n == 1 else numbered(w.replicates)(k)
        if i == 0 and n > 1:
            x = F.when(k == 0, w.weight).otherwise(x)
        if n > 1 and (blocks - 1) * width + i >= n:  # the last block may be shorter
            x = F.when(k < n, x).otherwise(0)
        cells.append(x.try_cast("double").alias(f"_x{i}"))
    slim = slim.select(*by, *bins, "_blk", "_v", "_o", *cells)
    xs = [F.col(f"_x{i}") for i in range(width)]
    bad = F.lit(False)
    if w.n_replicates:
        # a missing, NaN or infinite weight shows in the total
        total = xs[0]
        for x in xs[1:]:
            total = total + x
        low = F.least(*xs) if width > 1 else xs[0]
        bad = F.coalesce(~((total < float("inf")) & (low >= 0)), F.lit(True))
    ws = [f"_w{i}" for i in range(width)]
    key = [*by, *bins, "_blk"]
    out = slim.groupBy(*key).agg(
        *[F.sum(usable_weight(x, w.kind)).alias(name) for x, name in zip(xs, ws, strict=True)],
        F.count_if(bad).alias("_bad"), F.min("_v").alias("_lo"), F.min("_o").alias("_first_o"), F.max("_o").alias("_last_o"))
    if not w.explode:
        return out
    for d, groups in w.explode.items():
        out = out.withColumn(d, F.explode(groups))
    return out.groupBy(*key).agg(
        *[F.sum(x).alias(x) for x in ws], F.sum("_bad").alias("_bad"), F.min("_lo").alias("_lo"), F.min("_first_o").alias("_first_o"), F.max("_last_o").alias("_last_o"))


def same_groups(by: Sequence[str], prefix: str) -> Column:
    """Groups match null-safe: a missing group is a group."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return same


def middles(bins: DataFrame, by: Sequence[str], path: Sequence[str], bin_: str, kind: str) -> DataFrame:
    """For each weight number ``_r`` the bins (one, or two at exactly half) that its running sum crosses half in.

    Without ``path`` the bins are the whole group; below that they start from ``_start`` and cross half of ``_totals``, lists
    by weight number that are null where a weight has its middle elsewhere. All weights of a row run in one window.
    """
    big = "decimal(34,8)" if kind == EXACT else kind
    ws = [c for c in bins.columns if c.startswith("_w")]
    window = f"over (partition by {', '.join(f'`{c}`' for c in [*by, *path, '_blk'])} order by {bin_} rows between unbounded preceding and"
    sums = [f"cast(sum({x}) {window} current row) as {big}) as _run{i}" for i, x in enumerate(ws)]
    if not path:
        sums += [f"cast(sum({x}) {window} unbounded following) as {big}) as _all{i}" for i, x in enumerate(ws)]
        sums.append(f"sum(_bad) {window} unbounded following) as _invalid")

    def reach(i: int) -> str:
        number = f"cast(_blk * {len(ws)} + {i} as int)"
        start, total = (f"get(_start, {number})", f"get(_totals, {number})") if path else ("0", f"_all{i}")
        return f"named_struct('_r', {number}, '_w', cast({ws[i]} as {big}), '_before', cast({start} + _run{i} - {ws[i]} as {big}), '_total', {total})"

    crossing = f"filter(array({', '.join(map(reach, range(len(ws))))}), x -> x._w > 0 and (x._before + x._w) * 2 >= x._total and x._before * 2 <= x._total)"
    return bins.selectExpr("*", *sums).selectExpr(*[f"`{c}`" for c in dict.fromkeys([*by, *path, bin_])], "_first_o", "_last_o", "_lo", "_invalid", f"inline({crossing})")


def saved(hits: DataFrame) -> DataFrame:
    """The bins found, saved: a few rows a group that the next pass needs at three places. Planned anew at each of them they
    would read all rows each time."""
    ensure_checkpoint_dir(hits.sparkSession)
    return hits.checkpoint(eager=True)


def in_span(rows: DataFrame, hits: DataFrame, low: str, high: str) -> DataFrame:
    """Rows between the first and the last value that any group found in their bucket, with both.

    One row per bucket, and there are 2 ** (64 - ``LOW_BITS``) at most, so it can be broadcast and no row moves.
    """
    span = hits.groupBy("_k").agg(F.min("_first_o").alias(low), F.max("_last_o").alias(high))
    return rows.join(F.broadcast(span), "_k").where(F.col("_o").between(F.col(low), F.col(high)))


def with_totals(bins: DataFrame, hits: DataFrame, by: Sequence[str], path: Sequence[str], n: int) -> DataFrame:
    """Bins below the ones found, with start and total of the weights that have their middle in it; other bins go."""
    keys = [*by, *path]
    at = F.map_from_entries(F.collect_list(F.struct("_r", F.struct("_before", "_total"))))
    found = hits.groupBy(*[F.col(c).alias(f"_m_{c}") for c in keys]).agg(F.max("_invalid").alias("_invalid"), at.alias("_at"))
    listed = lambda f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.try_element_at("_at", r)[f])
    found = found.select(*[f"_m_{c}" for c in keys], "_invalid", listed("_before").alias("_start"), listed("_total").alias("_totals"))
    return bins.join(found, same_groups(keys, "_m_")).drop(*[f"_m_{c}" for c in keys])


def medians(w: Weighted, by: Sequence[str]) -> DataFrame:
    """Weighted median per group and weight number.

    ``_m`` is the median (the mean of this and the next value when the running weight hits exactly half),
    ``_first`` the first value that reaches half. Other columns: ``by``, ``_r`` (weight number), ``_bad``.
    """
    by, n = list(by), w.n_replicates + 1
    hits = saved(middles(sum_by_bin(w, by, ["_k"]), by, [], "_k", w.kind))
    # integer arithmetic, at most 2 ** LOW_BITS times BINS
    met = in_span(w.rows, hits, "_from", "_to").withColumn("_p", F.expr(f"(_o - _from) * {BINS} div (_to - _from + 1)"))
    bins = sum_by_bin(replace(w, rows=met), by, ["_k", "_p"])
    hits = saved(middles(with_totals(bins, hits, by, ["_k"], n), by, ["_k"], "_p", w.kind))
    near = in_span(met, hits, "_low", "_high")
    for d, groups in w.explode.items():
        near = near.withColumn(d, F.explode(groups))
    keys = hits.select(*[F.col(c).alias(f"_m_{c}") for c in [*by, "_k", "_p"]]).distinct()
    near = near.join(keys, same_groups([*by, "_k", "_p"], "_m_"), "left_semi").withColumn("_d", F.col("_o"))
    bins = sum_by_bin(replace(w, rows=near, explode={}), by, ["_k", "_p", "_d"])
    hits = middles(with_totals(bins, hits, by, ["_k", "_p"], n), by, ["_k", "_p"], "_d", w.kind)
    # bins are values now: one that reaches half, and the next one at exactly half
    return hits.groupBy(*by, "_r").agg(
        F.min_by((F.col("_before") + F.col("_w")) * 2 == F.col("_total"), "_first_o").alias("_half"),
        F.min("_lo").alias("_first"), F.max("_lo").alias("_next"), F.max("_invalid").alias("_bad"),
    ).withColumn("_m", F.when(F.col("_half"), (F.col("_first") + F.col("_next")) / 2).otherwise(F.col("_first"))).drop("_half", "_next")


def weighted_median(
    rows: DataFrame, by: Sequence[str], value: str, weight: str, *, midpoint: bool = True, kind: str = EXACT,
    name: str = "median",
) -> DataFrame:
    """Weighted median per group; groups without a usable row do not appear."""
    by, rows, drop = _grouped(rows, by)
    v = finite(F.col(value))
    out = medians(weighted_rows(rows.where(v.isNotNull()), v, F.col(weight), kind=kind), by)
    return out.select(*by, F.col("_m" if midpoint else "_first").alias(name)).drop(*drop)


def median(rows: DataFrame, by: Sequence[str], value: str, *, name: str = "median") -> DataFrame:
    """Plain median, every row once."""
    return weighted_median(rows.withColumn("_one", F.lit(1)), by, value, "_one", kind=WHOLE, name=name)


def _grouped(rows: DataFrame, by: Sequence[str]) -> tuple[list[str], DataFrame, list[str]]:
    if by:
        return list(by), rows, []
    return ["_all"], rows.withColumn("_all", F.lit(0)), ["_all"]


def sdr_variance(point: Column, replicates: Column, multiplier: float) -> Column:
    """Successive-difference variance: multiplier times the sum of squared distances to the point."""
    return F.lit(float(multiplier)) * F.aggregate(
        replicates, F.lit(0.0), lambda acc, x: acc + (x - point) * (x - point))


def uncertainty_columns(point: Column, variance: Column, critical: float) -> dict[str, Column]:
    se = F.sqrt(variance)
    margin = F.lit(float(critical)) * se
    return {
        "variance": variance, "standard_error": se, "margin_of_error": margin,
        "ci_lower": point - margin, "ci_upper": point + margin, "cv": F.try_divide(se, point),
    }


UNCERTAINTY = ("variance", "standard_error", "margin_of_error", "ci_lower", "ci_upper", "cv")


def median_uncertainty(
    rows: DataFrame, by: Sequence[str], value: str, weight: str, replicates: Column | Weights, n_replicates: int, *,
    multiplier: float, critical: float, kind: str = EXACT,
) -> DataFrame:
    """Median with variance, standard error, margin, interval and coefficient of variation per group.

    ``replicates`` is the array of replicate weights, or an expression of their number. Rows count when value and full-sample weight are positive. Any invalid replicate weight, or a replicate
    without a median, leaves the point and gives no uncertainty.
    """
    by, rows, drop = _grouped(rows, by)
    usable = rows.where((finite(F.col(value)) > 0) & (finite(F.col(weight)) > 0))
    ready = weighted_rows(usable, finite(F.col(value)), F.col(weight), replicates, n_replicates, kind)
    return uncertainty(ready, by, n_replicates, multiplier, critical).drop(*drop)


def uncertainty(
    w: Weighted, by: Sequence[str], n_replicates: int, multiplier: float, critical: float
) -> DataFrame:
    if multiplier <= 0 or critical <= 0:
        raise ValueError("multiplier and critical value must be positive")
    meds = medians(w, by).where(F.col("_r") <= n_replicates)
    # at most n_replicates + 1 entries per group
    packed = meds.groupBy(*by).agg(
        F.max(F.when(F.col("_r") == 0, F.col("_m"))).alias("point"),
        F.sort_array(F.collect_list(F.when(F.col("_r") > 0, F.struct("_r", "_m")))).alias("_reps"),
        F.max("_bad").alias("_bad"),
    )
    ok = (F.col("_bad") == 0) & (F.size("_reps") == n_replicates) & F.lit(n_replicates > 0)
    variance = F.when(ok, sdr_variance(F.col("point"), F.transform("_reps", lambda x: x["_m"]), multiplier))
    cols = uncertainty_columns(F.col("point"), F.col("variance"), critical)
    out = packed.withColumn("variance", variance)
    return out.select(
        *by, "point", F.when(ok, n_replicates).otherwise(0).alias("replicates_used"), "variance",
        *[cols[c].alias(c) for c in UNCERTAINTY[1:]],
    )
