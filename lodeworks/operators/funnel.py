"""Outreach items: event folding, history, funnel measures, owner-scoped deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.exprs import col, day_floor, trimmed
from lodeworks.operators.ranking import rank_by_ranges

LAST_STEP = 6


def clamp_step(step: Column | str, last: int = LAST_STEP) -> Column:
    return F.least(F.greatest(F.coalesce(col(step), F.lit(1)), F.lit(1)), F.lit(last)).cast("int")


def new_items(df: DataFrame, company: str, step: str, statuses: Sequence[str]) -> DataFrame:
    """Rows with a non-blank company; step in range, status from the step."""
    clean = df.withColumn(company, trimmed(company)).filter(F.col(company).isNotNull())
    clean = clean.withColumn(step, clamp_step(step, len(statuses)))
    names = F.array(*[F.lit(s) for s in statuses])
    return clean.withColumn("status", F.element_at(names, F.col(step)))


def current_state(events: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], op: str) -> DataFrame:
    """Latest state per item; a last ``delete`` removes the item.

    ``max_by`` combines on the map side, so an item with very many events moves
    one row per task.
    """
    latest = events.groupBy(key).agg(
        F.max_by(F.struct(op, *fields), F.struct(*order)).alias("s"), F.count("*").alias("n_events")
    )
    return latest.filter(F.col(f"s.{op}") != "delete").select(
        key, *[F.col(f"s.{c}").alias(c) for c in fields], "n_events"
    )


def history(events: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Log rows with their position in ``order``; an item, or one busy day of it, may span tasks."""
    return rank_by_ranges(events, order, [key])


def funnel(state: DataFrame, step: str, last: int = LAST_STEP) -> DataFrame:
    """Per step: count, share, rows that reached it, and the advance rate to the next."""
    counts = state.groupBy(step).agg(F.count("*").alias("n_rows"))
    steps = state.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias(step))
    # The step table has six rows; its windows are over those six only.
    full = steps.join(counts, step, "left").select(step, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    down = Window.partitionBy().orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, 0)
    reached = full.withColumn("reached", F.sum("n_rows").over(down))
    total = F.sum("n_rows").over(Window.partitionBy())
    following = F.lead("reached").over(Window.partitionBy().orderBy(step))
    return reached.select(
        step,
        "n_rows",
        "reached",
        F.round(100.0 * F.try_divide(F.col("n_rows"), total), 2).alias("pct"),
        F.round(100.0 * F.try_divide(following, F.col("reached")), 2).alias("advance_pct"),
    )


def funnel_totals(
    state: DataFrame, step: str, updated: str, as_of: Column, last: int = LAST_STEP, stale_days: int = 7
) -> DataFrame:
    open_item = F.col(step) < last
    idle = day_floor(as_of, F.col(updated))
    return state.agg(
        F.count("*").alias("n_total"),
        F.count_if(open_item).alias("n_active"),
        F.count_if(F.col(step) == last).alias("n_done"),
        F.count_if(open_item & (idle >= stale_days)).alias("n_stale"),
    )


def delete_owned(items: DataFrame, requests: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(kept items, outcome per request): a request works only on the owner's item."""
    wanted = requests.select(key, owner).distinct()
    kept = items.join(wanted, [key, owner], "left_anti")
    hit = items.select(key, owner).withColumn("_hit", F.lit(True))
    outcome = wanted.join(hit, [key, owner], "left").select(
        key, owner, F.when(F.col("_hit"), "deleted").otherwise("not_found").alias("outcome")
    )
    return kept, outcome
