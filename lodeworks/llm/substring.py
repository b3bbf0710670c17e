"""Removal of passages that repeat an earlier document, by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words. A word goes if it lies in a window whose words also
start in a document with a smaller id.

1. *Which suffixes.* Every window has an anchor: the least hash of its 25-word grams. Equal
   windows have equal anchors, so only windows whose anchor occurs in two documents can
   repeat; about one word in 13 is an anchor, and only anchors are counted. Equal documents are
   folded before, the later ones being covered whole.
2. *Suffix trees, cut at the window's depth.* Each such suffix carries a prefix code (the hashes
   of its first word, first 5 and first 10 words, one behind the other) and the hash of its
   whole window. Range partitioning on them splits the suffixes at prefixes of whatever
   length balances the groups; in a sorted group the suffixes of one subtree are neighbours,
   and a deep internal node (all of the window in common) is a run of equal keys. Groups are
   streamed, with one run's head in memory. A run may go on into further groups, so that a
   passage of any number of copies is dealt out: the head of an opening run is looked up among
   the last runs of the groups before (one row per group).
3. *Maximal repeats.* The places of deep nodes that began in a smaller document are merged into
   spans per document, and the spans' words are dropped.

Defined cases: null or empty texts have no words; documents under 50 words keep all; rows
that share an id are one document; a null id takes no part and keeps its words; an empty table
gives an empty result; extra columns pass through ``remove_repeats`` inside ``doc``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import Words, if_small, mix64, store, text_slices, words_of
from lodeworks.llm.decontaminate import merge_runs

WINDOW = 50
GRAM = 25

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MOST = np.uint64(2**64 - 1)


def joined(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of longer grams: ``left`` at each place and ``right`` ``gap`` words on."""
    n = min(len(left), max(0, len(right) - gap))
    return mix64(left[:n] * _LEFT + (right[gap : gap + n] ^ (right[gap : gap + n] >> np.uint64(29))) * _RIGHT)


def grams(words: Words) -> dict[int, np.ndarray]:
    """Hashes of the 1, 5, 10, 25 and 50 words from each place on (also across texts)."""
    one = words.hashes
    two = joined(one, one, 1)
    four = joined(two, two, 2)
    five = joined(four, one, 4)
    ten = joined(five, five, 5)
    twenty = joined(ten, ten, 10)
    half = joined(twenty, five, 20)
    return {1: one, 5: five, 10: ten, GRAM: half, WINDOW: joined(half, half, GRAM)}


def sliding(op, values: np.ndarray, width: int, neutral) -> np.ndarray:
    """``op`` over each place and the ``width - 1`` places after it."""
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        ahead = np.full(len(out), neutral, dtype=out.dtype)
        ahead[: max(0, len(out) - step)] = out[step:]
        out = op(out, ahead)
        size += step
    return out


def windows_of(words: Words):
    """Places where a whole window starts, all gram hashes, and each place's anchor hash."""
    n = len(words.hashes)
    hashes = grams(words)
    left = np.repeat(words.bounds[1:], words.counts) - np.arange(n)
    gram = np.full(n, _MOST, dtype=np.uint64)
    m = len(hashes[GRAM])
    gram[:m] = np.where(left[:m] >= GRAM, hashes[GRAM], _MOST)
    anchor = sliding(np.minimum, gram, WINDOW - GRAM + 1, _MOST)
    return np.flatnonzero(left >= WINDOW), hashes, anchor


def sketch(batches):
    """Per document its length, a 128-bit hash of its words, and its distinct anchors."""
    for part in text_slices(batches):
        words = words_of(part.column("text"))
        at, _, anchor = windows_of(words)
        owner = words.owner
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
        at = at[new]
        ends = np.searchsorted(owner[at], np.arange(part.num_rows + 1)).astype(np.int32)
        place = np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], words.counts)
        turned = mix64(words.hashes + place.astype(np.uint64) * _LEFT)
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
                for h in (turned, mix64(turned ^ _RIGHT))]
        keys = [pa.array((s[words.bounds[1:]] - s[words.bounds[:-1]]).view(np.int64)) for s in sums]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(words.counts), *keys,
             pa.ListArray.from_arrays(pa.array(ends), pa.array(anchor[at].view(np.int64)))],
            ["doc_id", "n_words", "c1", "c2", "anchors"],
        )


def suffixes(batches):
    """The windows whose anchor is among the shared ones: prefix code, window hash, place."""
    for part in text_slices(batches):
        words = words_of(part.column("text"))
        at, hashes, anchor = windows_of(words)
        shared = part.column("shared").flatten().to_numpy().view(np.uint64)
        at = at[np.isin(anchor[at], shared)]
        owner = words.owner[at]
        # 20 bits for the first word, 20 for the first five, 24 for the first ten.
        code = (hashes[1][at] >> np.uint64(44)) << np.uint64(44)
        code |= (hashes[5][at] >> np.uint64(44)) << np.uint64(24)
        code |= hashes[10][at] >> np.uint64(40)
        yield pa.RecordBatch.from_arrays(
            [pa.array(code.view(np.int64)), pa.array(hashes[WINDOW][at].view(np.int64)),
             part.column("doc_id").take(pa.array(owner)),
             pa.array((at - words.bounds[:-1][owner]).astype(np.int32))],
            ["prefix", "window", "doc_id", "place"],
        )


REPEAT, OPENING, LAST = 0, 1, 2


def deep_nodes(batches):
    """Streams one sorted group: places below a deep node whose first document is another.

    ``kind`` tells the places proper, those of the first document of the opening run (which
    may have begun in an earlier group) and the last run's head (for the groups after).
    """
    key, head, opening, kinds = None, None, True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = batch.schema
        prefix, window, doc = (batch.column(c).to_numpy() for c in ("prefix", "window", "doc_id"))
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (window[1:] != window[:-1])
        new[0] = key != (prefix[0], window[0])
        first = np.flatnonzero(new)
        run = np.cumsum(new)  # 0: the run that goes on from the batch before
        heads = np.concatenate(([doc[0] if head is None else head], doc[first]))
        own = heads[run]
        opens = (run == 0) if key is not None else (run == 1)
        opens &= opening
        later = doc > own
        keep = later | opens
        yield pa.RecordBatch.from_arrays(
            [c.filter(pa.array(keep)) for c in batch.columns]
            + [pa.array(own[keep]), pa.array(np.where(later[keep], REPEAT, OPENING).astype(np.int32))],
            [*batch.schema.names, "head", "kind"],
        )
        opening = bool(opens[-1])
        key, head = (prefix[-1], window[-1]), own[-1]
    if kinds is not None:
        values = [[key[0]], [key[1]], [None], [None], [head], [LAST]]
        types = [kinds.field(c).type for c in kinds.names] + [pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, types, strict=True)], [*kinds.names, "head", "kind"]
        )


def merge_places(batches):
    for batch in batches:
        spans = []
        for places in batch.column("places").to_pylist():
            at = np.array(places, dtype=np.int64)
            lo, hi = merge_runs(at, at + WINDOW)
            spans.append(np.column_stack((lo, hi)).ravel().tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(spans, pa.list_(pa.int32()))], ["doc_id", "spans"]
        )


def repeated_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, spans``: starts and ends of the word spans to remove, merged and sorted."""
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = store(
        docs.mapInArrow(
            sketch, "doc_id long, n_words long, c1 long, c2 long, anchors array<long>"
        ).where(F.col("n_words") >= WINDOW),
        "sketches",
    )
    keys = ["n_words", "c1", "c2"]
    least = store(
        sketches.groupBy(*keys).agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("most")),
        "least",
    )
    copies = (
        sketches.select("doc_id", *keys)
        .join(least.where("id < most"), keys)
        .where("doc_id > id")
        .select("doc_id", F.array(F.lit(0), F.col("n_words").cast("int")).alias("spans"))
    )
    leaders = sketches.select("doc_id", F.explode("anchors").alias("anchor")).join(
        if_small(store(copies.select("doc_id").distinct(), "copies")), "doc_id", "left_anti"
    )
    anchors = store(leaders.select("anchor", "doc_id").distinct(), "anchors")
    shared = store(
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .where("lo < hi")
        .select("anchor"),
        "shared",
    )
    lists = store(
        anchors.join(shared, "anchor")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.collect_list("anchor").alias("shared")),
        "lists",
    )
    rows = store(
        docs.join(if_small(lists, 8 * F.size("shared")), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text", "shared")
        .mapInArrow(suffixes, "prefix long, window long, doc_id long, place int"),
        "suffixes",
    )
    order = ["prefix", "window", "doc_id", "place"]
    nodes = store(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            deep_nodes,
            "prefix long, window long, doc_id long, place int, head long, kind int",
        ),
        "nodes",
    )
    # One row per group of suffixes: its last run.
    last = nodes.where(F.col("kind") == LAST).groupBy("prefix", "window").agg(F.min("head").alias("from"))
    opened = (
        nodes.where(F.col("kind") == OPENING)
        .join(F.broadcast(last), ["prefix", "window"], "left")
        .where(F.col("doc_id") > F.least("head", "from"))
    )
    places = nodes.where(F.col("kind") == REPEAT).select("doc_id", "place").unionByName(
        opened.select("doc_id", "place")
    )
    merged = (
        places.groupBy("doc_id")
        .agg(F.collect_set("place").alias("places"))
        .mapInArrow(merge_places, "doc_id long, spans array<int>")
    )
    return merged.unionByName(copies.distinct())


def cut_spans(batches):
    for batch in batches:
        doc = batch.column("doc")
        flat = pa.RecordBatch.from_arrays(
            [doc, doc.field("text"), batch.column("spans")], ["doc", "text", "spans"]
        )
        for part in text_slices([flat]):
            words = words_of(part.column("text"))
            raw = words.data.tobytes()
            texts, gone = [], []
            for i, spans in enumerate(part.column("spans").to_pylist()):
                keep = np.ones(int(words.counts[i]), dtype=bool)
                for a, b in zip((spans or ())[::2], (spans or ())[1::2], strict=True):
                    keep[a:b] = False
                at = words.bounds[i] + np.flatnonzero(keep)
                pairs = zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)
                texts.append(b" ".join([raw[s:e] for s, e in pairs]))
                gone.append(len(keep) - len(at))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(texts, pa.binary()).cast(pa.string()),
                 pa.array(words.counts), pa.array(gone, pa.int64())],
                ["doc", "kept", "n_words", "n_removed"],
            )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc`` (all columns of a document), ``kept`` (its words that stay, joined by one
    space), ``n_words`` and ``n_removed``."""
    spans = store(repeated_spans(documents).withColumnRenamed("doc_id", "_id"), "spans")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    marked = rows.join(
        if_small(spans, 4 * F.size("spans")), F.col("doc.doc_id") == F.col("_id"), "left"
    ).select("doc", "spans")
    fields = T.StructType.fromDDL("kept string, n_words long, n_removed long").fields
    return marked.mapInArrow(cut_spans, T.StructType([rows.schema["doc"], *fields]))
