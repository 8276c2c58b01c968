"""Joins and windows on half-open intervals [start, end), by equi-joins on bins rather than nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written
from . import scans

#: Rows of a right side that are few enough for Spark to send them to all tasks.
FEW = 10_000


def _bins(frame: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row for each bin that an interval touches; empty intervals touch none."""
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return frame.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _paired(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows of _bins() that overlap, each in the bin where its overlap begins."""
    ls, le = left_span
    rs, re = right_span
    here = F.col("_bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width)
    return left.join(right, [*on, "_bin"]).where((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & here).drop("_bin")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int, how: str = "inner") -> DataFrame:
    """All pairs with equal `on` whose intervals overlap; how: inner, left_semi or left_anti.

    Both sides are cut into bins of `width` and joined on (on, bin). A pair is taken only in the bin where its overlap
    begins, so no pair comes twice and nothing has to be made distinct. `width` near the usual length keeps rows few.
    Columns of the right side besides `on` must have names of their own. Rows with a null in `on` or their span join with nothing.
    """
    ls, le = left_span
    rs, re = right_span
    if how == "inner":
        return _paired(_bins(left, ls, le, width), _bins(right, rs, re, width), on, left_span, right_span, width)
    meets = (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"how can't be {how}")
    keys = list(dict.fromkeys([*on, ls, le]))
    spans = left.select(*keys).distinct()
    hits = _bins(spans, ls, le, width).join(_bins(right.select(*on, rs, re), rs, re, width), [*on, "_bin"]).where(meets).select(*keys).distinct()
    return left.join(hits, keys, how)


def best_overlap(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int, key: list[str], tie: list[str]) -> DataFrame:
    """For each `key` of the left side the right row of largest overlap, then of largest `tie`; left rows without any have nulls.

    The left side is written first, so that it is computed once and its rows are counted: bins, pairs and keys are dealt to tasks that grow in number with them.
    """
    left = written(left, "spans")
    n = left.count()
    ours, theirs = _bins(left, *left_span, width), _bins(right, *right_span, width)
    if n > scans.ROWS and (few := right.count()) > FEW:
        most = max(n, few)
        ours, theirs = (scans.dealt(side, [*on, "_bin"], most) for side in (ours, theirs))
    pairs = _paired(ours, theirs, on, left_span, right_span, width)
    shared = F.least(left_span[1], right_span[1]) - F.greatest(left_span[0], right_span[0])
    extra = [c for c in right.columns if c not in on]
    best = scans.dealt(pairs, key, n).groupBy(*key).agg(F.max(F.struct(shared.alias("_overlap"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(tie)), *(F.col(c) for c in extra if c not in tie))).alias("_best"))
    named = [F.col(f"_best.t{tie.index(c)}").alias(c) if c in tie else F.col(f"_best.{c}") for c in extra]
    return scans.dealt(left, key, n).join(best.select(*key, F.col("_best._overlap").alias("overlap"), *named), key, "left")


def containing_interval(points: DataFrame, spans: DataFrame, on: list[str], point: str, span: tuple[str, str], width: int) -> DataFrame:
    """For each point the interval around it that starts last; points without one are kept with nulls."""
    start, end = span
    places = points.select(*on, point).distinct().withColumn("_bin", F.floor(F.col(point) / width).cast("long"))
    inside = places.join(_bins(spans, start, end, width), [*on, "_bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
    extra = [c for c in spans.columns if c not in on and c not in span]
    best = inside.groupBy(*on, point).agg(F.max(F.struct(start, end, *extra)).alias("_best"))
    return points.join(best, [*on, point], "left").select(*points.columns, *(F.col(f"_best.{c}").alias(c) for c in (start, end, *extra)))


def last_before(points: DataFrame, marks: DataFrame, on: list[str], point: str, mark: str, carry: list[str]) -> DataFrame:
    """Points with the `carry` columns of the last mark at or before them: both sides sorted together in stretches (scans.py), no join of ranges.

    A point without a place has no mark; of marks at one place any one is taken. Nulls in `on` are a group like others.
    """
    marked = marks.where(F.col(mark).isNotNull()).select(*on, F.col(mark).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(mark), *carry).alias("_mark"))
    asked = points.select(*on, F.col(point).alias("_at"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_point"))
    both = scans.in_stretches(marked.unionByName(asked, allowMissingColumns=True), "_at")
    out = scans.scan(both, on, ["_at", "_side"], {"_last": scans.running_last(F.col("_mark"), F.col("_at"))}).where("_side = 1")
    return out.select("_point.*", F.col(f"_last.{mark}").alias(mark), *(F.col(f"_last.{c}").alias(c) for c in carry))


def nearest_ends(points: DataFrame, ends: DataFrame, on: list[str], point: str, strand: str, end: str) -> DataFrame:
    """Points with the nearest of their group's transcript ends at or beyond them in the direction of their strand; null where there is none, or no place or strand.

    As-of lookups, forward points with both sides negated: no group's ends are gathered for its points.
    """
    sides = []
    for sign, own in ((-1, F.col(strand) == "+"), (1, F.coalesce(F.col(strand) != "+", F.lit(True)))):
        asked = points.where(own).withColumn("_place", F.when(F.col(strand).isNotNull(), sign * F.col(point)))
        marks = ends.select(*on, (sign * F.col(end)).alias("_mark_at")).distinct()
        found = last_before(asked, marks, on, "_place", "_mark_at", [])
        sides.append(found.select(*points.columns, (sign * F.col("_mark_at")).alias("nearest_end")))
    return sides[0].unionByName(sides[1])


def merge_intervals(spans: DataFrame, on: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap, touch, or lie at most `gap` apart."""
    w = Window.partitionBy(*on).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    isles = marked.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy(*on, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isle")


def introns(exons: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """The gaps between a transcript's neighbouring exons."""
    after = F.lead(start).over(Window.partitionBy(*on).orderBy(start, end))
    return exons.select(*on, F.col(end).alias("intron_start"), after.alias("intron_end")).where("intron_end > intron_start")


def exon_offsets(exons: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """Exons with their offset along the transcript and its length."""
    size = F.col(end) - F.col(start)
    w = Window.partitionBy(*on)
    before = w.orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("length", F.sum(size).over(w))


def depth_steps(spans: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """Coverage as steps: [from_pos, to_pos) and the number of intervals over it; steps of depth 0 are left out.

    Ends are summed by position first; the running sum over places where coverage may change is a scan in stretches, so one deep gene or contig is many tasks' work.
    """
    ends = spans.select(*on, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("change")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("change")))).alias("_e")).select(*on, "_e.*")
    changes = scans.in_stretches(ends.groupBy(*on, "pos").agg(F.sum("change").alias("change")), "pos")
    steps = scans.scan(changes, on, ["pos"], {"depth": scans.running_sum(F.col("change")), "to_pos": scans.following(F.col("pos"))})
    return steps.where("depth > 0").select(*on, F.col("pos").alias("from_pos"), "to_pos", "depth")


def depth_grid(steps: DataFrame, on: list[str]) -> DataFrame:
    """One row for each covered position of depth_steps()."""
    return steps.select(*on, F.explode(F.sequence("from_pos", F.col("to_pos") - 1)).alias("pos"), "depth")


def covered_share(steps: DataFrame, on: list[str], length: Column, least: int = 1) -> Column:
    """Aggregate for steps: the share of `length` covered at least `least` deep."""
    return F.sum(F.when(F.col("depth") >= least, F.col("to_pos") - F.col("from_pos")).otherwise(0)) / F.max(length)


def moving_mean(rows: DataFrame, on: list[str], order: str, value: str, half: int = 12) -> Column:
    """Centred mean over the rows `half` before to `half` after."""
    return F.avg(value).over(Window.partitionBy(*on).orderBy(order).rowsBetween(-half, half))


def densest_window(starts: DataFrame, on: list[str], pos: str, width: int = 300) -> DataFrame:
    """The most reads that start within `width` positions, for each group, and their share of the group."""
    counts = starts.groupBy(*on, pos).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*on).orderBy(pos)
    inside = counts.withColumn("_in", F.sum("_n").over(w.rangeBetween(-(width - 1), 0)))
    return inside.groupBy(*on).agg(F.max("_in").alias("densest"), F.sum("_n").alias("reads")).withColumn("densest_share", F.col("densest") / F.col("reads"))


def bin_of(index: Column, length: Column, bins: int) -> Column:
    """Bin of equal width of a 0-based index in a vector of `length`."""
    return F.least(F.floor(index * bins / length), F.lit(bins - 1)).cast("int")


def balance(position: Column, coverage: Column) -> Column:
    """Aggregate: twice the centre of mass of coverage over positions from 0 to 1; 1 is even."""
    return F.when(F.sum(coverage) != 0, 2 * F.sum(position * coverage) / F.sum(coverage))


def peaks(depth: DataFrame, on: list[str], pos: str, value: str, median: str, fold: float = 5, width: int = 150) -> DataFrame:
    """How many sharp peaks each group has. Rows are covered positions; a position without a row has a depth of 0.

    A peak's top has `fold` times the group's median or more, no less than the position before and more than the one after, and lies inside
    the group's first and last position; the stretch around it of at least half its depth spans less than `width`, and it lies `width` or more from the
    last peak counted. The last rule goes by the order of peaks, so a group's covered positions are one task's rows.
    """
    import numpy as np
    import pandas as pd

    schema = ", ".join(f"`{c}` {depth.schema[c].dataType.simpleString()}" for c in on) + ", n_peaks long"

    def stretch(at: np.ndarray, d: np.ndarray, k: int, step: int) -> int:
        """Positions next to row k, on one side, that are joined with it at half its depth: `width` at most."""
        side = slice(k + 1, k + 1 + width) if step > 0 else slice(k - 1 if k else None, k - 1 - width if k > width else None, -1)
        rows, levels = (at[side], d[side]) if step > 0 or k else (at[:0], d[:0])
        joined = (np.abs(rows - at[k]) == np.arange(1, len(rows) + 1)) & (2 * levels >= d[k])
        return len(rows) if joined.all() else int(joined.argmin())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        at, d, mid = pdf[pos].to_numpy(np.int64), pdf[value].to_numpy(float), float(pdf[median].iloc[0])
        touching = np.diff(at) == 1
        before = np.concatenate([[0.0], np.where(touching, d[:-1], 0.0)])
        after = np.concatenate([np.where(touching, d[1:], 0.0), [0.0]])
        high = (d >= fold * mid) & (d >= before) & (d > after) & (at > at[0]) & (at < at[-1]) & (mid > 0)
        sharp = [int(at[k]) for k in np.flatnonzero(high) if stretch(at, d, k, -1) + stretch(at, d, k, 1) < width]
        counted: list[int] = []
        for place in sharp:
            if not counted or place - counted[-1] >= width:
                counted.append(place)
        return pd.DataFrame([[*key, len(counted)]], columns=[*on, "n_peaks"])

    return depth.groupBy(*on).applyInPandas(run, schema)
