"""Wide tables put together from several sources: lists of candidates, one row for a sample or a method, and metrics by unit."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidate_lists(rows: DataFrame, lists: Mapping[str, tuple[list[Column], list[Column]]]) -> DataFrame:
    """Rows by the lists whose conditions they all meet: `list` names it and `order` holds the list's sort keys as one struct.

    One pass over the rows, however many lists; a condition that is null isn't met. Sort by list and order to print a list.
    """
    met = []
    for name, (conditions, keys) in lists.items():
        good = reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))
        order = F.struct(*(k.cast("double").alias(f"k{i}") for i, k in enumerate(keys)))
        met.append((name, good, order))
    width = max(len(keys) for _, keys in lists.values())
    wide = lambda order, n: F.struct(*((order[f"k{i}"] if i < n else F.lit(None).cast("double")).alias(f"k{i}") for i in range(width)))
    tagged = F.array(*(F.when(good, F.struct(F.lit(name).alias("list"), wide(order, len(lists[name][1])).alias("order"))) for name, good, order in met))
    return rows.withColumn("_l", F.explode(F.filter(tagged, lambda x: x.isNotNull()))).select(*rows.columns, "_l.list", "_l.order")


def sample_table(samples: DataFrame, key: list[str], sources: Mapping[str, DataFrame], fill: Mapping[str, object] | None = None) -> DataFrame:
    """One wide row for each sample: all columns of all sources by key, named source_column; what is missing is null or `fill`.

    Sources have one row for each key, or the run fails: a second row would double a sample. Each joins on the same key, so one
    partitioning serves all.
    """
    out = samples.select(*key).distinct()
    for name, source in sources.items():
        columns = [c for c in source.columns if c not in key]
        one = source.groupBy(*key).agg(F.count("*").alias("_rows"), *(F.first(c).alias(f"{name}_{c}") for c in columns))
        checked = F.when(F.col("_rows") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{name} has several rows for a sample")))
        out = out.join(one.where(checked).drop("_rows"), key, "left")
    return out.na.fill(dict(fill)) if fill else out


def pivoted(rows: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long rows as one for each key, a column for each of the given names; missing cells are 0."""
    return rows.groupBy(*key).agg(*(F.coalesce(F.sum(F.when(F.col(name) == n, F.col(value))), F.lit(0)).alias(n) for n in names))


def method_summary(parts: Mapping[str, tuple[DataFrame, str]], method: str) -> DataFrame:
    """One row for each method: the mean over its samples of each part's value, and how many samples have one."""
    tables = []
    for name, (rows, value) in parts.items():
        tables.append(rows.groupBy(method).agg(F.avg(value).alias(name), F.count(value).alias(f"{name}_samples")))
    return reduce(lambda a, b: a.join(b, method, "full"), tables)


def unit_metrics(rows: DataFrame, unit: list[str], metrics: Mapping[str, Column], wanted: Mapping[str, str], known: DataFrame | None = None) -> DataFrame:
    """Metrics of each unit as rows of a fixed schema, only for units that `known` rows of that schema don't have yet.

    metrics: aggregates by name. wanted: the type of each. Known rows whose schema differs are of an older make and computed anew.
    """
    schema = {**{c: rows.schema[c].dataType.simpleString() for c in unit}, **wanted}
    fresh = known is not None and {f.name: f.dataType.simpleString() for f in known.schema.fields} == schema
    todo = rows.join(known.select(*unit).distinct(), unit, "left_anti") if fresh else rows
    made = todo.groupBy(*unit).agg(*(m.alias(n) for n, m in metrics.items())).select(*unit, *(F.col(n).cast(t).alias(n) for n, t in wanted.items()))
    return made.unionByName(known) if fresh else made


def deepest_element(seq: Column, elements: list[str], least_part: int = 6) -> Column:
    """struct<reach, partial>: how many of the elements, in their order from the read's 3' side, follow one another, and whether the first
    `least_part` letters or more of the next one are seen behind the last."""
    reach, at, open_ = F.lit(0), F.lit(1), F.lit(True)
    partial = F.lit(False)
    for e in elements:
        here = F.locate(e, F.substring(seq, at, F.length(seq)))
        found = open_ & (here > 0)
        start = F.substring(seq, at, F.length(seq)).contains(e[:least_part])
        partial = F.when(open_ & ~found, start).otherwise(F.when(found, F.lit(False)).otherwise(partial))
        reach = reach + found.cast("int")
        at = F.when(found, at + here - 1 + len(e)).otherwise(at)
        open_ = found
    return F.struct(reach.alias("reach"), partial.alias("partial"))


