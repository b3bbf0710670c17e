"""Joins and set operations of the table-building work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.exprs import col, nonzero


def amount_multiplier(
    firm_min: Column | str, firm_max: Column | str, want_min: Column | str, want_max: Column | str
) -> Column:
    """Graded overlap of two money ranges: 1.0, 0.7, 0.4 or 0 (out of range).

    A range with neither end passes. Zero acts as a missing end, a missing upper
    end of the firm is unbounded.
    """
    f_min, f_max = col(firm_min), col(firm_max)
    w_min, w_max = col(want_min), col(want_max)
    open_firm = f_min.isNull() & f_max.isNull()
    open_want = w_min.isNull() & w_max.isNull()
    a_min = F.coalesce(nonzero(f_min), F.lit(0)).cast("double")
    a_max = nonzero(f_max).cast("double")
    b_min = F.coalesce(nonzero(w_min), F.lit(0)).cast("double")
    b_max = F.coalesce(nonzero(w_max).cast("double"), b_min)
    overlap = (b_max >= a_min) & (a_max.isNull() | (b_min <= a_max))
    below = F.when(b_max != 0, F.try_divide(a_min, b_max)).otherwise(F.lit(float("inf")))
    above = F.coalesce(F.try_divide(b_min, a_max), F.lit(0.0))
    ratio = F.greatest(below, above)
    return (
        F.when(open_firm | open_want | overlap, 1.0)
        .when(ratio <= 3, 0.7)
        .when(ratio <= 8, 0.4)
        .otherwise(0.0)
    )


def patch_from(
    df: DataFrame, found: DataFrame, key: str, defaults: Mapping[str, object]
) -> DataFrame:
    """Left join; a missing partner gets the default of each patched column."""
    kept = [c for c in df.columns if c not in defaults]
    joined = df.select(*kept).join(found.select(key, *defaults), key, "left")
    return joined.select(*kept, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the completed table."""
    return df.join(done.select(key), key, "left_anti")


def rename_first(
    df: DataFrame, mapping: DataFrame, name: str, order: str
) -> DataFrame:
    """Apply (old, new) pairs: a null new name deletes every row of the name,
    any other renames only the first row in input order."""
    first = (
        df.groupBy(name)
        .agg(F.min(order).alias("_first"))
        .join(mapping.withColumnRenamed("old", name), name)
        .withColumn("_mapped", F.lit(True))
    )
    joined = df.join(first, name, "left")
    doomed = F.col("_mapped").isNotNull() & F.col("new").isNull()
    renamed = F.when(F.col(order) == F.col("_first"), F.coalesce("new", name)).otherwise(F.col(name))
    return joined.filter(~doomed).withColumn(name, renamed).drop("new", "_first", "_mapped")


def apply_verdicts(
    df: DataFrame, verdicts: DataFrame, keys: Sequence[str], batch: str, patched: Sequence[str]
) -> DataFrame:
    """Join verdict rows back to their batch.

    No verdict keeps the original, ``valid = false`` deletes, otherwise each
    non-empty cleaned value overwrites. A batch without any verdict stays as is,
    which the per-row rule already gives.
    """
    renamed = verdicts.select(
        *keys, "valid", *[F.col(c).alias(f"_new_{c}") for c in patched]
    )
    joined = df.join(renamed, list(keys), "left").filter(~F.col("valid").eqNullSafe(F.lit(False)))
    for c in patched:
        new = F.col(f"_new_{c}")
        joined = joined.withColumn(c, F.when(new.isNotNull() & (new != ""), new).otherwise(F.col(c)))
    return joined.drop("valid", *[f"_new_{c}" for c in patched])


def verdict_or_reject(
    df: DataFrame, verdicts: DataFrame, key: str, missing_reason: str
) -> DataFrame:
    """Per-row verdict: a missing one rejects the row with a reason."""
    joined = df.join(verdicts.select(key, "valid", "reason"), key, "left")
    accepted = F.coalesce("valid", F.lit(False))
    return joined.select(
        *df.columns,
        accepted.alias("accepted"),
        F.when(~accepted, F.coalesce("reason", F.lit(missing_reason))).alias("reject_reason"),
    )


def lane_union(lanes: Mapping[str, DataFrame]) -> DataFrame:
    """Bag union of branches, each tagged with its lane."""
    out = None
    for lane, df in lanes.items():
        tagged = df.withColumn("lane", F.lit(lane))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def latest_per(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
