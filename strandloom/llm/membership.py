"""A filter of fixed size for the ids that a join will ask for: never drops a wanted row, whatever the number of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 512 rows of 4 KB each, 2 MB in all, for any input.
BITS = 1 << 24
ROW_BITS = 1 << 15


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def possible(frame: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`frame` in two parts: rows whose key may be among those of `wanted` (one column), and rows whose key is not.

    Rows are told apart by a bitmap of hashed keys that is broadcast. With many keys it fills up and lets more rows
    through, so an exact join of the first part must follow.
    """
    place = _place(F.col(wanted.columns[0]))
    rows = wanted.select(place.alias("_member_at")).groupBy(F.expr(f"cast(_member_at div {ROW_BITS} as int)").alias("_member_row"))
    bitmap = rows.agg(F.expr(f"bitmap_construct_agg(_member_at % {ROW_BITS})").alias("_member_bits"))
    at = _place(F.col(key))
    marked = frame.withColumn("_member_at", at).withColumn("_member_row", F.expr(f"cast(_member_at div {ROW_BITS} as int)")).join(F.broadcast(bitmap), "_member_row", "left")
    byte = F.conv(F.hex(F.expr(f"substring(_member_bits, cast((_member_at % {ROW_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn("_member_hit", F.coalesce(F.expr("_member_bits is not null") & (byte.bitwiseAND(F.expr("shiftleft(1, cast(_member_at % 8 as int))")) != 0), F.lit(False)))
    names = frame.columns
    return marked.where("_member_hit").select(*names), marked.where("not _member_hit").select(*names)
