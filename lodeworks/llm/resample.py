"""Importance resampling towards a target distribution of hashed n-grams.

A text is lower-cased (A-Z only) and its separators collapse to single spaces; one pattern of
``regex``, scanned with ``overlapped=True`` and held to word boundaries by lookarounds, then
emits the span of every run of words, and the CRC-32 of the span is its feature. Documents
carry their counts per bucket into a stored table, so the corpus is scanned once; the bucket
totals of corpus and target (at most ``BUCKETS`` rows each) give the gains, and a document's
weight is the mean gain of its features. Gumbel noise from the digest of the id turns the
weights into a draw without replacement: the highest scores are drawn. The ranks come from
ranges of scores, so neither the documents nor a common score meet in one task.

Defined cases: a null text has no words, weight 0, and is never drawn; rows that share an id
share its noise, and those that tie in full are ranked in any order; a null id takes the noise
of an empty id and comes last among ties; without target texts all gains measure the corpus
against an even target; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import ALNUM_WORDS, LOWER, store, text_slices
from lodeworks.operators.ranking import rank_by_ranges

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
SEPARATOR = 0x20

# Lower-cases A-Z and turns every byte outside words into a space.
_FOLD = np.where(ALNUM_WORDS[LOWER], LOWER, SEPARATOR).astype(np.uint8).tobytes()


def runs(size: int) -> regex.Pattern:
    """Spans of ``size`` words, whole ones: no word byte may stand on either side."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (size - 1))


def collapsed(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(_FOLD).split())


def features(text: str | None, patterns, buckets: int) -> tuple[int, Counter]:
    """The number of words, and the counts of the text's buckets."""
    flat = collapsed(text)
    found: Counter = Counter()
    for pattern in patterns:
        found.update(zlib.crc32(m[0]) % buckets for m in pattern.finditer(flat, overlapped=True))
    return flat.count(b" ") + bool(flat), found


def count_features(longest: int, buckets: int):
    """Per row: words, features, and the buckets with their counts as packed integers."""

    def counted(batches):
        patterns = [runs(size) for size in range(1, longest + 1)]
        for part in text_slices(batches):
            rows = [features(t, patterns, buckets) for t in part.column("text").to_pylist()]
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [part.column(n) for n in names]
                + [
                    pa.array([words for words, _ in rows], pa.int64()),
                    pa.array([found.total() for _, found in rows], pa.int64()),
                    pa.array([np.fromiter(found, "<u4", len(found)).tobytes() for _, found in rows], pa.binary()),
                    pa.array([np.fromiter(found.values(), "<u4", len(found)).tobytes() for _, found in rows], pa.binary()),
                ],
                [*names, "n_words", "n_features", "buckets", "counts"],
            )

    return counted


def add_up(buckets: int):
    """The bucket totals of one task's rows."""

    def added(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u4")
            n = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4")
            total += np.bincount(at, weights=n, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return added


def bucket_totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Totals of all rows, at most one row per bucket."""
    parts = counted.select("buckets", "counts").mapInArrow(add_up(buckets), "bucket long, n long")
    total = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, floored."""
    buckets = len(corpus)
    above = (target + 1).astype(np.float64) * float(corpus.sum() + buckets)
    below = (corpus + 1).astype(np.float64) * float(target.sum() + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weigh(table):
    """The floored mean gain of each row's features."""

    def weighed(batches):
        gain = table.value
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            at = np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u4")
            counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4").astype(np.int64)
            held = np.array([len(b) // 4 for b in batch.column("buckets").to_pylist()], dtype=np.int64)
            ends = np.cumsum(held)
            run = np.concatenate(([0], np.cumsum(gain[at] * counts)))
            weight = (run[ends] - run[ends - held]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return weighed


def noise(seed: str):
    """Gumbel noise in thousandths, from the digest of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(2.0**32))))


def resample(
    documents: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank`` (null if not drawn).

    Features are the runs of 1 to ``longest`` words of ``documents`` (``doc_id, text``) and of
    ``target`` (``text``). ``percent`` of the documents with ``min_words`` words are drawn.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = "n_words long, n_features long, buckets binary, counts binary"
    scan = count_features(longest, buckets)
    corpus = store(
        documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {counted}"), "features"
    )
    wanted = target.select("text").mapInArrow(scan, counted)
    table = spark.sparkContext.broadcast(gains(bucket_totals(corpus, buckets), bucket_totals(wanted, buckets)))
    scored = store(
        corpus.mapInArrow(weigh(table), f"doc_id {kind}, n_words long, n_features long, weight long").select(
            "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score")
        ),
        "scores",
    )
    eligible = scored.filter(F.col("n_words") >= min_words)
    drawn = eligible.count() * percent // 100
    ranked = rank_by_ranges(
        eligible,
        [F.desc("score"), F.asc_nulls_last("doc_id")],
        name="rank",
        keep=lambda df: store(df, "ranked"),
    )
    short = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(short).drop("n_words")
