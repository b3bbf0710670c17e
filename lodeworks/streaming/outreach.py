"""Item state kept by a stream of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.session import run_dir


def state_changes(stream: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], op: str) -> DataFrame:
    """Running latest state per item; out-of-order rows lose against later ones."""
    return stream.groupBy(key).agg(
        F.max_by(F.struct(op, *fields), F.struct(*order)).alias("s"), F.max(F.struct(*order)).alias("at")
    )


def fold_to_table(stream: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], op: str) -> DataFrame:
    """Fold the available changes and read back the live items.

    Each micro-batch writes its changed items into a folder of its own, so a
    retried batch overwrites itself; the newest row per item is the state.
    """
    spark = stream.sparkSession
    root = run_dir(spark, "outreach")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    changes = state_changes(stream, key, order, fields, op)
    (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    rows = spark.read.parquet(f"{root}/rows")
    latest = rows.groupBy(key).agg(F.max_by("s", "at").alias("s"))
    return latest.filter(F.col(f"s.{op}") != "delete").select(key, *[F.col(f"s.{c}").alias(c) for c in fields])
