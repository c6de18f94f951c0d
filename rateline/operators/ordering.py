"""Positions and neighbours in an order, without one task holding a whole group.

A plain window puts a group into one task, and an unpartitioned one puts the
whole table there. Here the rows are range-partitioned on the whole key, as a
global sort does it, and written with their *bucket* (the range) and their
*place* in it. However many rows share a group, they are spread over even
ranges. A small table per bucket then carries counts or edge rows across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateline.sources.workspace import materialize

# The row id holds the partition above this bit and the row number below it.
_ROW_BITS = 33


def in_ranges(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Rows with their bucket and 0-based place in it, ``keys`` ascending.

    ``keys`` must be unique. Without ``buckets`` there are as many ranges as
    shuffle partitions, of which adaptive execution joins small neighbours.

    The sorted ranges are written out: what depended on which task held a row
    is data from then on, and the same for every use.
    """
    number = [] if buckets is None else [buckets]
    ranges = df.repartitionByRange(*number, *keys).sortWithinPartitions(*keys)
    rows = materialize(ranges.withColumn("_row", F.monotonically_increasing_id()), "ranges")
    return rows.select(
        *df.columns,
        F.shiftright("_row", _ROW_BITS).alias("_bucket"),
        F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1).alias("_place"),
    )


def ordered_position(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    position: str = "position",
    total: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add the 1-based position in ``order_by`` within ``partition_by``.

    It is the place in the bucket, counted from where the group starts there,
    plus a running sum over the group's row counts in earlier buckets. ``total``
    names a column for the size of the group. ``partition_by`` columns must not
    be NULL.
    """
    groups = list(partition_by)
    keys = [*groups, "_bucket"]
    rows = in_ranges(df, [*groups, *order_by], buckets)
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    added = [(before - F.col("_first") + 1).alias("_offset")]
    if total is not None:
        added.append(F.sum("_rows").over(group).alias(total))
    counts = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
        .select(*keys, *added)
    )
    return (
        rows.join(materialize(counts, "counts"), keys)
        .withColumn(position, F.col("_offset") + F.col("_place"))
        .select(*df.columns, position, *([total] if total is not None else []))
    )


def ordered_neighbours(
    df: DataFrame,
    order_by: Sequence[str],
    value: str,
    partition_by: Sequence[str] = (),
    previous: str | None = "previous",
    following: str | None = "following",
    buckets: int | None = None,
) -> DataFrame:
    """Add the column ``value`` of the row before and after in the order.

    Only the first and last row of a group in a bucket look outside it, in a
    table of such edge rows.
    """
    groups = list(partition_by)
    keys = [*groups, "_bucket"]
    rows = in_ranges(df, [*groups, *order_by], buckets)
    held = F.struct(value)
    across = Window.partitionBy(*groups).orderBy("_bucket")
    edges = (
        rows.groupBy(*keys)
        .agg(F.min_by(held, "_place").alias("_first"), F.max_by(held, "_place").alias("_last"))
        .select(
            *keys,
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
        )
    )
    inside = Window.partitionBy(*keys).orderBy("_place")
    joined = (
        rows.withColumn("_lag", F.lag(held).over(inside))
        .withColumn("_lead", F.lead(held).over(inside))
        .join(materialize(edges, "edges"), keys)
    )
    added = []
    if previous is not None:
        added.append(F.coalesce("_lag", "_before")[value].alias(previous))
    if following is not None:
        added.append(F.coalesce("_lead", "_after")[value].alias(following))
    return joined.select(*df.columns, *added)
