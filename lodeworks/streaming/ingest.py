"""Resumable ingest: each run takes the files that are new and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.session import run_dir


def open_stream(
    spark: SparkSession,
    path: str,
    schema,
    pattern: str | None = None,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append_new(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append every unseen input row once; the checkpoint remembers what was read."""
    (
        stream.writeStream.format(fmt)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def write_batches(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Write every unseen batch to a folder of its own and stop; returns the batches written.

    A batch that is run again after a stop has the same number and rows and overwrites its own
    folder, so each row lies there once, also in stores without the commit log of ``append_new``.
    """
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written.append(number)

    (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return len(written)


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key, however late a row is: every key is remembered, in the state store
    of its partition."""
    return stream.dropDuplicates(keys)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is available into a new folder and read it back."""
    spark = stream.sparkSession
    out = run_dir(spark, label)
    append_new(stream, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
