"""Shared helpers: Arrow text buffers, words and their hashes as arrays, stored intermediates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.session import run_dir

# Texts of one numpy pass, in bytes. A longer text is a pass of its own.
SLICE_BYTES = 1 << 20

SPACES = [0x20, *range(0x09, 0x0E)]


def byte_class(separators: Iterable[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    return inside


SPACED_WORDS = byte_class(SPACES)
# Digits, lower-case ASCII letters and every byte of a non-ASCII character.
ALNUM_WORDS = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_POSITIONS = 32
_TABLE = np.random.default_rng(20240501).integers(
    0, 2**64, size=_POSITIONS * 256, dtype=np.uint64
)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose texts come to at most ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and the offsets; null is empty."""
    filled = column.cast(pa.large_binary())
    if filled.null_count:
        filled = filled.fill_null(b"")
    _, offs, data = filled.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of many texts: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, data, offsets, word_byte=SPACED_WORDS, lower=False):
        if lower:
            data = LOWER[data]
        self.data, n = data, len(data)
        inside = word_byte[data]
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.letters = data[inside]
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        lengths = self.ends - self.starts
        if not len(lengths):
            return np.empty(0, dtype=np.uint64)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        # A text has under 2^31 bytes.
        place = np.arange(len(self.letters), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
        value = _TABLE[((place & (_POSITIONS - 1)) << 8) + self.letters]
        if lengths.max() > _POSITIONS:
            value = value * ((place // _POSITIONS) * 2 + 1).astype(np.uint64)
        return mix64(np.add.reduceat(value, first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(column: pa.Array, word_byte=SPACED_WORDS, lower=False) -> Words:
    data, offsets = text_bytes(column)
    return Words(data, offsets, word_byte, lower)


_MULTIPLIERS = np.random.default_rng(77).integers(0, 2**63, size=4096, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)


def gram_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and the word each gram starts at.

    Grams never cross from one text into the next.
    """
    n = len(words.hashes)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for i in range(size):
        total += words.hashes[i : n - size + 1 + i] * _MULTIPLIERS[i]
    left = np.repeat(words.bounds[1:], words.counts)[: n - size + 1] - np.arange(n - size + 1)
    at = np.flatnonzero(left >= size)
    return mix64(total[at]), at


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes an intermediate to the shared folder and reads it back: lost executors cost
    nothing but the running tasks, and later jobs start from the table."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Stored intermediates of one operator that go once its result is stored."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = run_dir(df.sparkSession, label)
        df.write.parquet(path)
        self.paths.append(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the folders; call it when nothing reads them any more."""
        for path in self.paths:
            files, folder = fs.FileSystem.from_uri(path)
            files.delete_dir(folder)
        self.paths = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sides of a join up to this many bytes are broadcast, larger ones shuffled.
BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, bytes_of=None) -> DataFrame:
    """Marks a stored table for broadcast if its measured size allows; the join is the same."""
    bytes_of = F.lit(64) if bytes_of is None else bytes_of + 64
    size = df.agg(F.sum(bytes_of).alias("size")).first().size or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
