"""Data-quality measures: completeness, distributions, percentiles, gaps, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.exprs import all_of, col
from lodeworks.operators.percentile import percentile_columns


def present(df: DataFrame, name: str) -> Column:
    """Null, blank text, empty list and empty map count as absent."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def meaningful(df: DataFrame, name: str, placeholders: Sequence[str]) -> Column:
    """Present, and a list has at least one value that is no placeholder."""
    here = present(df, name)
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return here & F.exists(F.col(name), lambda v: ~F.lower(F.trim(v)).isin(*placeholders))
    return here


def completeness(df: DataFrame, columns: Sequence[str], placeholders: Sequence[str]) -> DataFrame:
    """Present and meaningful counts and percent per column, from one pass."""
    totals = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(present(df, c)).alias(f"p_{c}") for c in columns],
        *[F.count_if(meaningful(df, c, placeholders)).alias(f"m_{c}") for c in columns],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("field"),
                    F.col(f"p_{c}").alias("n_present"),
                    F.col(f"m_{c}").alias("n_meaningful"),
                )
                for c in columns
            ]
        )
    )
    return totals.select("n", rows.alias("r")).select(
        "r.field",
        "r.n_present",
        "r.n_meaningful",
        F.round(100.0 * F.col("r.n_present") / F.col("n"), 1).alias("pct_present"),
        F.round(100.0 * F.col("r.n_meaningful") / F.col("n"), 1).alias("pct_meaningful"),
    )


def value_counts(
    df: DataFrame,
    value: Column | str,
    top: int | None = None,
    drop: Sequence[str] = (),
    name: str = "value",
) -> DataFrame:
    """Counts by value, most common first, ties by value; ``top`` is the report length."""
    rows = df.select(col(value).alias(name)).filter(F.col(name).isNotNull())
    if drop:
        rows = rows.filter(~F.lower(F.trim(name)).isin(*drop))
    out = rows.groupBy(name).agg(F.count("*").alias("n_rows"))
    if top is None:
        return out
    return out.orderBy(F.desc("n_rows"), F.asc(name)).limit(top)


def number_summary(df: DataFrame, value: str) -> DataFrame:
    """count, min, p25, median, p75, p95, max and mean of one column."""
    shape = percentile_columns(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    basic = df.agg(
        F.count(value).alias("n"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
    )
    # Both sides are single aggregate rows.
    return basic.withColumn("_k", F.lit(1)).join(
        F.broadcast(shape.withColumn("_k", F.lit(1))), "_k"
    ).drop("_k")


def histogram(df: DataFrame, value: Column | str, width: int) -> DataFrame:
    bucket = (F.floor(col(value) / width) * width).cast("bigint")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_rows"))


def ratio_distribution(
    df: DataFrame, top: Column, bottom: Column, min_rows: int = 10, tight: float = 1.5
) -> DataFrame:
    """p10-p90 of top/bottom over rows where both are set and bottom > 0.

    The result row is empty when fewer than ``min_rows`` ratios exist; ``tight``
    marks a narrow middle: (p75 - p25) / median below the bound.
    """
    ratios = df.select(F.when((top != 0) & (bottom > 0), top / bottom).alias("ratio"))
    names = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    shape = percentile_columns(ratios, "ratio", names)
    n = ratios.agg(F.count("ratio").alias("n")).filter(F.col("n") >= min_rows)
    out = n.withColumn("_k", F.lit(1)).join(F.broadcast(shape.withColumn("_k", F.lit(1))), "_k")
    spread = F.try_divide(F.col("p75") - F.col("p25"), F.col("median"))
    return out.drop("_k").withColumn("is_tight", spread < tight)


def core_gaps(
    df: DataFrame, core: Mapping[str, Column], fallback: Mapping[str, Column]
) -> DataFrame:
    """Rows with all core fields, gaps per field, and gaps a fallback column could fill."""
    ok = {k: F.coalesce(c, F.lit(False)) for k, c in core.items()}
    aggs = [F.count("*").alias("n_rows"), F.count_if(all_of(ok.values())).alias("n_all_core")]
    for k, c in ok.items():
        aggs.append(F.count_if(~c).alias(f"gap_{k}"))
        if k in fallback:
            aggs.append(
                F.count_if(~c & F.coalesce(fallback[k], F.lit(False))).alias(f"fillable_{k}")
            )
    return df.agg(*aggs)


def grouped_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by each column on its own, from one pass with grouping sets."""
    sets = [[F.col(c)] for c in columns]
    counted = df.groupingSets(sets, *columns).agg(
        F.count("*").alias("n_rows"), F.grouping_id().alias("_g")
    )
    facet, value = None, None
    for i, c in enumerate(columns):
        gid = (2 ** len(columns) - 1) - 2 ** (len(columns) - 1 - i)
        hit = F.col("_g") == gid
        facet = F.when(hit, F.lit(c)) if facet is None else facet.when(hit, F.lit(c))
        text = F.col(c).cast("string")
        value = F.when(hit, text) if value is None else value.when(hit, text)
    return counted.select(facet.alias("facet"), value.alias("value"), "n_rows")


def top_per_facet(counts: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("facet").orderBy(F.desc("n_rows"), F.asc("value"))
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def coverage(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Count and floored percent of rows where each condition holds."""
    totals = df.agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(f"c_{k}") for k, c in fields.items()]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("field"), F.col(f"c_{k}").alias("n_rows"))
                for k in fields
            ]
        )
    )
    return totals.select("n", rows.alias("r")).select(
        "r.field",
        "r.n_rows",
        F.floor(100 * F.col("r.n_rows") / F.col("n")).cast("bigint").alias("pct"),
    )


def score_bands(df: DataFrame, score: str, high: float = 80, low: float = 50) -> DataFrame:
    s = F.col(score)
    return df.agg(
        F.count_if(s >= high).alias("n_high"),
        F.count_if((s >= low) & (s < high)).alias("n_mid"),
        F.count_if(s < low).alias("n_low"),
        F.round(F.avg(s), 4).alias("mean_score"),
    )


def step_bucket(score: Column | str) -> Column:
    """Largest of 0, 25, 50, 75, 100 that is not above the score."""
    return (F.floor(F.least(col(score), F.lit(100)) / 25) * 25).cast("bigint")


def profile_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of several text columns: one unpivot and one shuffle.

    Distinct counts, null counts and top values all read from this small table.
    """
    tall = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        ).alias("r")
    ).select("r.column", "r.value")
    return tall.groupBy("column", "value").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = profile_values(df, columns)
    return counts.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.count("value").alias("n_unique"),
        F.round(
            100.0
            * F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
            / F.sum("n"),
            2,
        ).alias("pct_null"),
    )


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        profile_values(df, columns)
        .filter(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= n)
    )


def meets_targets(counts: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Target table left-joined to the counts; an absent key counts as zero."""
    return targets.join(counts, key, "left").select(
        key,
        "target",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        (F.coalesce("n_rows", F.lit(0)) >= F.col("target")).alias("passed"),
    )


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """N rows per stratum by a seeded hash order: repeatable on any partitioning."""
    w = Window.partitionBy(stratum).orderBy(
        F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)
    )
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")

