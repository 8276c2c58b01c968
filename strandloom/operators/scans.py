"""Running values over rows of any number: prefix scans in stretches rather than one window for a whole key.

The order is cut at quantiles of its first column into stretches of about ROWS rows. A stretch's values are summed up (or its last mark, or its least
value, taken); what came before a stretch is carried into it, and its rows are finished on their own. So a key that holds all rows is the work of many
tasks, and the only window over a whole key sees one row for each of its stretches, MOST_STRETCHES at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows of a stretch, about, and stretches at most.
ROWS = 250_000
MOST_STRETCHES = 4096
STRETCH = "_stretch"


def tasks_for(rows: DataFrame, n: int) -> int:
    """How many tasks `n` rows are dealt to: as many as the session runs at once, and more where a task would get more than ROWS."""
    return max(min(MOST_STRETCHES, -(-n // ROWS)), rows.sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, on: list[str], n: int | None = None) -> DataFrame:
    """`rows` dealt by the columns `on`; few rows are left to the session's settings. Without their number `n` a job counts them.

    A session's number of shuffle partitions is fixed, so what one of its tasks sorts or hashes grows with the table. These tasks grow in number instead.
    """
    n = rows.count() if n is None else n
    return rows if n <= ROWS else rows.repartition(tasks_for(rows, n), *on)


def in_stretches(rows: DataFrame, order: str) -> DataFrame:
    """`rows` with the number of their stretch, which rises with the column `order` (a number, date or time). Rows of one value share a stretch; nulls are in the first.

    Runs a job that counts the rows and, if they need more than one stretch, one for quantiles. The cuts are constants of the plan: the same on every
    retry of a task. Only how evenly rows are dealt depends on them.
    """
    n = rows.where(F.col(order).isNotNull()).count()
    parts = min(MOST_STRETCHES, -(-n // ROWS))
    if parts < 2:
        return rows.withColumn(STRETCH, F.lit(0))
    # as text a cut is exact, but for times with a zone, which are counted in microseconds
    kind = rows.schema[order].dataType.simpleString()
    place, kind = (F.unix_micros(order), "bigint") if kind == "timestamp" else (F.col(order), kind)
    found = rows.agg(F.percentile_approx(place, [k / parts for k in range(1, parts)], 10 * parts).cast("array<string>").alias("cuts")).first().cuts
    cuts = F.array(*(F.lit(c).cast(kind) for c in dict.fromkeys(found)))

    def nearer(state: Column, bit: Column) -> Column:
        """A binary search: how many cuts lie at or below the value, a bit at a time."""
        return F.when(F.get(cuts, state + bit - 1) <= place, state + bit).otherwise(state)

    bits = F.array(*(F.lit(1 << k) for k in range(len(found).bit_length() - 1, -1, -1)))
    return rows.withColumn(STRETCH, F.aggregate(bits, F.lit(0), nearer))


def per_stretch(on: list[str]) -> WindowSpec:
    return Window.partitionBy(*on, STRETCH)


@dataclass(frozen=True)
class Running:
    """A running value: how rows of a stretch get theirs, what a stretch hands on, how that adds up, and how a row takes it in."""

    local: Callable[[WindowSpec], Column]
    total: Column
    carried: Callable[[Column, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]
    backward: bool = False


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def running_sum(value: Column) -> Running:
    return Running(lambda w: F.sum(value).over(_so_far(w)), F.sum(value), lambda t, w: F.sum(t).over(w), lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)))


def running_min(value: Column, backward: bool = False) -> Running:
    return Running(lambda w: F.min(value).over(_so_far(w)), F.min(value), lambda t, w: F.min(t).over(w), F.least, backward)


def running_last(value: Column, order: Column) -> Running:
    """The last value that isn't null; `order` tells which one is a stretch's last."""
    last = F.max_by(value, F.when(value.isNotNull(), order))
    return Running(lambda w: F.last(value, ignorenulls=True).over(_so_far(w)), last, lambda t, w: F.last(t, ignorenulls=True).over(w), lambda own, before: F.coalesce(own, before))


def following(value: Column) -> Running:
    """The value of the next row, for values that rise with the order."""
    return Running(lambda w: F.lag(value).over(w), F.min(value), lambda t, w: F.min(t).over(w), lambda own, after: F.coalesce(own, after), True)


def scan(stretched: DataFrame, on: list[str], order: list[str], values: dict[str, Running], totals: dict[str, Column] | None = None) -> DataFrame:
    """Rows of in_stretches() with running values of each group `on` in an order, and with `totals`, sums over the whole group of given columns.

    The order begins with the column that in_stretches() was given. Nulls in `on` are a group like others. Values that run backward see the rows in the
    opposite order.
    """
    ways = {back: [F.col(c).desc() if back else F.col(c).asc() for c in order] for back in (False, True)}
    whole = Window.partitionBy(*(on or [F.lit(0)]))
    before = {back: whole.orderBy(F.desc(STRETCH) if back else F.asc(STRETCH)).rowsBetween(Window.unboundedPreceding, -1) for back in (False, True)}
    sums = totals or {}
    handed = stretched.groupBy(*on, STRETCH).agg(*(v.total.alias(k) for k, v in values.items()), *(F.sum(c).alias(k) for k, c in sums.items()))
    carried = handed.select(*on, STRETCH, *(v.carried(F.col(k), before[v.backward]).alias(f"_before_{k}") for k, v in values.items()), *(F.sum(k).over(whole).alias(k) for k in sums))
    inside = stretched.select("*", *(v.local(per_stretch(on).orderBy(*ways[v.backward])).alias(k) for k, v in values.items()))
    same = [F.col(f"_row.{c}").eqNullSafe(F.col(f"_carried.{c}")) for c in [*on, STRETCH]]
    both = inside.alias("_row").join(carried.alias("_carried"), same, "left")
    kept = [F.col(f"_row.{c}") for c in stretched.columns]
    return both.select(*kept, *(v.joined(F.col(f"_row.{k}"), F.col(f"_carried._before_{k}")).alias(k) for k, v in values.items()), *(F.col(f"_carried.{k}") for k in sums))
