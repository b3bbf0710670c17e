"""Row numbers over a total order of any size: ranges sorted apart, offsets added after."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import cut_lineage

# A row's identifier holds its partition above these bits and its place there below.
PLACE_BITS = 33


def rank_by_ranges(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    name: str = "position",
    keep: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Adds ``name``, the position (from 1) of each row within its group under ``order``.

    Rows are dealt by ranges of group and order, so a large group lies in many partitions;
    rows that tie are dealt by their place in the input and so split as well. Each partition
    is sorted by itself; a group's first row in a partition and the rows it has in earlier
    partitions (counted, one row per partition and group) turn places into positions.
    ``keep`` fixes the sorted rows before they are numbered: a checkpoint, or a written table.
    Nulls of a group column are one group.
    """
    by = [F.col(g) for g in group] + list(order) + [F.col("_tie")]
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_tie")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    rows = keep(ordered).withColumn("_part", F.shiftright("_row", PLACE_BITS))
    counts = rows.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(shifts, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))
