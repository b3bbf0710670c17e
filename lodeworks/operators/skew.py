"""Keyed work where one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows. By counting there
# are at most 1 / HOT_SHARE such keys, so the hot set is always small enough to
# broadcast. Tables under HOT_FLOOR rows need no split.
HOT_SHARE = 0.001
HOT_FLOOR = 2_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, floor: int = HOT_FLOOR):
    """Keys that hold more than ``share`` of the rows; None for a small table.

    At most ``1 / share`` rows come back, whatever the size of the input.
    """
    total = df.count()
    if total < floor:
        return None
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > total * share)
        .drop("_n")
    )


def keyed_lookup(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Left join to a table with one row per key.

    Rows of hot keys meet a broadcast of the (bounded) hot part of ``dim``; all
    other rows take the ordinary shuffled join, so no task gets a hot key whole.
    """
    hot = hot_keys(df.select(key), [key], share, floor)
    if hot is None:
        return df.join(dim, key, "left")
    hot = hot.filter(F.col(key).isNotNull())
    dim_hot = hot.join(dim, key, "left").withColumn("_hot", F.lit(True))
    seen = df.join(F.broadcast(dim_hot), key, "left")
    wide = dim.drop(key).columns
    hot_rows = seen.filter(F.col("_hot")).drop("_hot")
    rest = seen.filter(F.col("_hot").isNull()).drop("_hot", *wide)
    return hot_rows.unionByName(rest.join(dim, key, "left"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_on: str,
    condition=None,
    salts: int = 32,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Inner join that spreads each hot key of ``left`` over several tasks.

    ``left`` rows of a hot key get a salt from ``spread_on``; the partner rows of
    that key, and only those, are copied once per salt. Hot keys are found in
    ``counted`` (default: ``left``).
    """
    keys = list(keys)
    hot = hot_keys((left if counted is None else counted).select(*keys), keys, share, floor)
    if hot is None:
        out = left.join(right, keys)
        return out if condition is None else out.filter(condition)
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    a = left.join(mark, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_on), F.lit(salts)).cast("int")).otherwise(0),
    )
    b = right.join(mark, keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    out = a.drop("_hot").join(b.drop("_hot"), [*keys, "_salt"]).drop("_salt")
    return out if condition is None else out.filter(condition)
