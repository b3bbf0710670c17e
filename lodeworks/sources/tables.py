"""Readers and writers: JSON lines, JSON documents, CSV, versions, owner partitions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that each hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_wrapped(
    spark: SparkSession,
    path: str,
    record: str,
    keys: Sequence[str] = ("data", "investors", "records", "results"),
) -> DataFrame:
    """A bare list per file, or an object that wraps the list under one of the keys.

    ``record`` is the DDL of one record, whose fields must not be named like a key. One read
    knows both shapes: the members of a bare list come as rows, as the parser meets them; a
    wrapping object comes as one row, whose list is exploded.
    """
    shape = T.StructType.fromDDL(record)
    lists = T.StructType([T.StructField(k, T.ArrayType(shape)) for k in keys])
    rows = spark.read.schema(T.StructType([*shape.fields, *lists.fields])).option("multiLine", True).json(path)
    wrapped = F.coalesce(*[F.col(k) for k in keys])
    bare = F.struct(*[F.col(n) for n in shape.names])
    return rows.select(F.explode(F.coalesce(wrapped, F.array(bare))).alias("r")).select("r.*")


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.csv(path, header=True, inferSchema=False)


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """First candidate path that exists on its file system."""
    for candidate in candidates:
        try:
            # Resolving a read looks the path up and opens no file.
            spark.read.text(candidate)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return candidate
    raise FileNotFoundError(f"none of {list(candidates)} exists")


def write_copies(df: DataFrame, parquet_path: str, json_path: str) -> None:
    """Overwrite the whole output in two formats; the second reads the first back."""
    df.write.mode("overwrite").parquet(parquet_path)
    df.sparkSession.read.parquet(parquet_path).write.mode("overwrite").json(json_path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv_joined(df: DataFrame, path: str, sep: str = "; ") -> None:
    """CSV with a header; list columns become one joined text."""
    shown = [
        F.array_join(f.name, sep).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*shown).write.mode("overwrite").csv(path, header=True)


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    return read_if_there(spark, f"{root.rstrip('/')}/pointers")


def latest_pointer(spark: SparkSession, root: str):
    """The newest complete version (``version, folder, n_rows``), by number, or None."""
    pointers = _pointers(spark, root)
    return None if pointers is None else pointers.orderBy(F.desc("version"), F.desc("folder")).first()


def write_version(df: DataFrame, root: str, version: int | None = None) -> int:
    """Write the rows to a folder of their own, then a pointer row that makes them the newest.

    A reader goes by the pointers alone: until the pointer is there it sees the version before,
    and a write that fails half way leaves a folder that nobody reads. Rows may be read from
    the version they replace. ``version`` defaults to one more than the newest.
    """
    spark = df.sparkSession
    if version is None:
        newest = latest_pointer(spark, root)
        version = 1 if newest is None else newest.version + 1
    folder = f"version-{version}-{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/data/{folder}"
    df.write.mode("errorifexists").parquet(path)
    pointer = spark.read.parquet(path).agg(F.count("*").alias("n_rows"))
    pointer = pointer.select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), "n_rows")
    pointer.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/pointers")
    return version


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version; only its own folder is listed and read."""
    newest = latest_pointer(spark, root)
    if newest is None:
        raise FileNotFoundError(f"{root} has no complete version")
    return spark.read.parquet(f"{root.rstrip('/')}/data/{newest.folder}")


CLEARED = "_cleared"


def replace_owner_rows(df: DataFrame, path: str, owner: str, owners: DataFrame | None = None) -> None:
    """Replace all rows of the owners present in ``df`` or in ``owners``; other owners stay.

    An owner listed without rows keeps none: its partition is overwritten with one marker
    row, which ``read_owner_rows`` leaves out.
    """
    rows = df.withColumn(CLEARED, F.lit(False))
    if owners is not None:
        gone = owners.select(owner).distinct().join(df.select(owner), owner, "left_anti")
        rows = rows.unionByName(gone.withColumn(CLEARED, F.lit(True)), allowMissingColumns=True)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(owner)
        .parquet(path)
    )


def read_owner_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all owners."""
    return spark.read.parquet(path).where(~F.col(CLEARED)).drop(CLEARED)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where its path does not exist; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def import_once(spark: SparkSession, json_path: str, schema: str, table_path: str, key: str) -> None:
    """Bring legacy JSON rows into a table; rows already there are left out."""
    rows = read_json_array(spark, json_path, schema)
    present = read_if_there(spark, table_path)
    if present is not None:
        rows = rows.join(present.select(key), key, "left_anti")
    rows.write.mode("append").parquet(table_path)


def with_payload(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON payload column; a null or unreadable payload is an empty struct."""
    parsed = F.from_json(F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("{}")), schema)
    empty = F.from_json(F.lit("{}"), schema)
    return df.withColumn(column, F.coalesce(parsed, empty))


def export_json(df: DataFrame, path: str, key: str, rows_per_file: int = 100_000) -> None:
    """One JSON document per row, in key order, in files of at most ``rows_per_file`` documents."""
    documents = df.repartitionByRange(key).sortWithinPartitions(key).select(F.to_json(F.struct("*")).alias("value"))
    documents.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)


def mark_done(df: DataFrame, path: str, key: str) -> None:
    """Append the keys to the completed table."""
    df.select(key).distinct().write.mode("append").parquet(path)


def pending(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key is not in the completed table (all rows when there is none)."""
    done = read_if_there(df.sparkSession, path)
    return df if done is None else df.join(done.select(key), key, "left_anti")


