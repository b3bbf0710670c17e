"""Exact interpolated percentiles that never gather a column, or a narrow range of it, in one task.

Ranges that hold a wanted rank are split again and again: first by sign, exponent and two
leading digits (about ninety buckets a factor of ten, the same for all data), then evenly
between the least and the largest value found in the bucket. A pass counts rows per bucket,
combined on the map side, and goes on only with buckets that hold a wanted rank, more than
``FINAL_ROWS`` rows and more than one value. What is left is a few small ranges, whose
values are counted and ranked. A pass divides a range by ``SPLITS``, so a column of doubles
needs five at most, however close its values lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import cut_lineage

SPLITS = 1024
# Rows a range may hold when its values are ranked in one task.
FINAL_ROWS = 100_000
# Groups whose ranges (two per probability at most) are broadcast; more are joined by key.
BROADCAST_GROUPS = 20_000


def radix_bucket(value: Column) -> Column:
    """Order-preserving bucket: sign, decimal exponent and two leading digits."""
    size = F.abs(value)
    exponent = F.floor(F.log10(size))
    lead = F.floor(size / F.pow(F.lit(10.0), exponent - 1))
    code = (exponent + 400) * 100 + lead
    return F.when(value == 0, F.lit(0)).otherwise((F.signum(value) * code).cast("bigint"))


def _with_ranks(buckets: DataFrame, by: list[str], parent: list[str], wanted: Column) -> DataFrame:
    """Buckets that hold a wanted rank, with the rows before them and their wanted ranks."""
    run = Window.partitionBy(*by, *parent).orderBy("_lo")
    placed = buckets.withColumn("_before", F.col("_start") + F.sum("_n").over(run) - F.col("_n"))

    def inside(w: Column) -> Column:
        end = F.col("_before") + F.col("_n")
        return ((w["lo"] >= F.col("_before")) & (w["lo"] < end)) | (
            (w["hi"] >= F.col("_before")) & (w["hi"] < end)
        )

    kept = placed.withColumn("_want", F.filter(wanted, inside)).filter(F.size("_want") > 0)
    return kept.select(*by, F.col("_before").alias("_start"), "_n", "_lo", "_hi", "_want")


def _in_ranges(data: DataFrame, ranges: DataFrame, by: list[str], groups: int, most: int) -> DataFrame:
    """The rows of ``data`` that lie in a range of their group, with that range."""
    listed = ranges.groupBy(*by).agg(F.collect_list(F.struct("_lo", "_hi", "_start")).alias("_ranges"))
    if groups <= BROADCAST_GROUPS:
        listed = F.broadcast(listed)
    # A group has two ranges per probability at most.
    each = [F.get("_ranges", F.lit(i)) for i in range(most)]
    holding = [F.when((F.col("_v") >= r["_lo"]) & (F.col("_v") <= r["_hi"]), r) for r in each]
    return (
        data.join(listed, by)
        .withColumn("_range", F.coalesce(*holding))
        .filter(F.col("_range").isNotNull())
        .select(*by, "_v", "_range")
    )


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), final_rows: int = FINAL_ROWS
) -> DataFrame:
    """Columns: ``by``, ``p``, ``percentile`` with linear interpolation; null values take no part."""
    single = not by
    by = list(by) or ["_all"]
    given = df.withColumn("_all", F.lit(0)) if single else df
    data = given.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # A group is matched by equality, so a null group gets a key that is not null.
    keys = [f"_k{i}" for i in range(len(by))]
    names = [F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by]
    nulls = F.concat(*[F.when(F.col(b).isNull(), "0").otherwise("1") for b in by])
    data = data.select(*by, *[n.alias(k) for n, k in zip(names, keys, strict=True)], nulls.alias("_kn"), "_v")
    keys.append("_kn")

    counted = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first = data.groupBy(*keys, radix_bucket(F.col("_v")).alias("_b")).agg(
        *counted, *[F.first(b).alias(b) for b in by]
    )
    total = F.sum("_n").over(Window.partitionBy(*keys))
    wanted = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.floor(F.lit(float(p)) * (F.col("_total") - 1)).alias("lo"),
                F.ceil(F.lit(float(p)) * (F.col("_total") - 1)).alias("hi"),
                (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"),
            )
            for p in probs
        ]
    )
    buckets = cut_lineage(first.withColumn("_total", total).withColumn("_start", F.lit(0)))
    labels = buckets.groupBy(*keys).agg(*[F.first(b).alias(b) for b in by])
    groups = labels.count()
    spots = cut_lineage(_with_ranks(buckets, keys, [], wanted))
    rows = data.select(*keys, "_v")
    while True:
        split = (F.col("_n") > final_rows) & (F.col("_lo") < F.col("_hi"))
        wide = spots.filter(split)
        if wide.isEmpty():
            break
        at = F.floor((F.col("_v") - F.col("_range._lo")) / (F.col("_range._hi") - F.col("_range._lo")) * SPLITS)
        parts = (
            _in_ranges(rows, wide, keys, groups, 2 * len(probs))
            .groupBy(*keys, F.col("_range._start").alias("_start"), F.least(at, F.lit(SPLITS - 1)).alias("_b"))
            .agg(*counted)
            .join(wide.select(*keys, "_start", "_want"), [*keys, "_start"])
        )
        spots = cut_lineage(
            spots.filter(~split).unionByName(_with_ranks(parts, keys, ["_start"], F.col("_want")))
        )
    values = (
        _in_ranges(rows, spots, keys, groups, 2 * len(probs))
        .groupBy(*keys, F.col("_range._start").alias("_start"), "_v")
        .agg(F.count("*").alias("_c"))
    )
    run = Window.partitionBy(*keys, "_start").orderBy("_v")
    placed = (
        values.withColumn("_e", F.col("_start") + F.sum("_c").over(run))
        .join(spots.select(*keys, "_start", "_want"), [*keys, "_start"])
        .select(*keys, "_v", (F.col("_e") - F.col("_c")).alias("_s"), "_e", F.explode("_want").alias("w"))
    )

    def at_rank(field: str) -> Column:
        rank = F.col(f"w.{field}")
        return F.max(F.when((rank >= F.col("_s")) & (rank < F.col("_e")), F.col("_v")))

    found = placed.groupBy(*keys, F.col("w.p").alias("p")).agg(
        at_rank("lo").alias("_vlo"),
        at_rank("hi").alias("_vhi"),
        F.max(F.col("w.pos") - F.col("w.lo")).alias("_frac"),
    )
    out = found.join(labels, keys).select(
        *by, "p", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("percentile")
    )
    return out.drop("_all") if single else out


def percentile_columns(
    df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """One row (per group) with a column for each named probability."""
    tall = exact_percentiles(df, value, list(dict.fromkeys(named.values())), by)
    return tall.groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("percentile"))).alias(n) for n, p in named.items()]
    )
