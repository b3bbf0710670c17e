"""Benchmark decontamination with suffix arrays over shards of the training texts.

Every task cuts its documents into shards of about a megabyte, sorts all word suffixes
of a shard, and binary-searches every benchmark window in it. Each hit is extended to the
longest verbatim match. Nothing is shuffled: the documents stay where they are read, and
the benchmark comes to them in blocks of bounded size.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z.
A window is ``window`` consecutive words of an item; a shorter item is one window.
A document word inside any occurrence of a window is hit.

Defined cases: null or empty texts have no words and are never contaminated; an empty
benchmark hits nothing; repeated items count once (by id); a null item id reads as an
empty string; repeated documents are judged one by one; other columns pass through
whatever their names, inside ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import ALNUM_WORDS, store, text_slices, words_of

WINDOW = 13
# One pass over the documents searches at most this much benchmark text.
BLOCK_BYTES = 8 << 20

MATCHES = "array<struct<item_id:string,item_start:int,doc_start:int,length:int>>"
MARKS = f"text string, n_words long, n_hit long, runs binary, items array<string>, matches {MATCHES}"


@dataclass
class Block:
    """Benchmark items of one pass: their words and their distinct windows."""

    hashes: np.ndarray
    item_end: np.ndarray  # for each word, where its item ends
    starts: np.ndarray
    lengths: np.ndarray
    owners: list[list[int]] = field(default_factory=list)
    item_ids: list[str] = field(default_factory=list)
    item_first: np.ndarray | None = None


def make_block(ids: list, texts: list, window: int) -> Block:
    words = words_of(pa.array(texts, pa.string()), ALNUM_WORDS, lower=True)
    seen: dict[bytes, int] = {}
    starts, lengths, owners = [], [], []
    for item, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
        size = min(window, b - a)
        for s in range(a, b - size + 1) if size else ():
            content = words.hashes[s : s + size].tobytes()
            at = seen.setdefault(content, len(starts))
            if at == len(starts):
                starts.append(s)
                lengths.append(size)
                owners.append([])
            if not owners[at] or owners[at][-1] != item:
                owners[at].append(item)
    names = ["" if i is None else str(i) for i in ids]
    ends = np.repeat(words.bounds[1:], words.counts)
    return Block(
        words.hashes, ends, np.array(starts, int), np.array(lengths, int), owners, names,
        words.bounds[:-1],
    )


def blocks_of(benchmark: DataFrame, window: int, limit: int) -> Iterator[Block]:
    """Items in blocks of at most ``limit`` bytes, read one partition at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    for item_id, text in rows.toLocalIterator():
        if texts and size + len(text) * 4 > limit:
            yield make_block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text) * 4
    if texts:
        yield make_block(ids, texts, window)


class SuffixArray:
    """All suffixes of a word sequence, sorted by their first ``depth`` words."""

    def __init__(self, hashes: np.ndarray, separators: np.ndarray, depth: int):
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        n = len(hashes) + len(separators)
        self.seq = np.zeros(n + depth, dtype=np.int64)  # 0 separates texts and pads the end
        word_place = np.ones(n, dtype=bool)
        word_place[separators] = False
        self.seq[:n][word_place] = ids + 1
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.packed = max(1, min(62 // self.bits, depth))
        self.order, self.keys = self._sort(n, depth)

    def _sort(self, n: int, depth: int):
        key = self.seq[:n].copy()
        for j in range(1, self.packed):
            key <<= self.bits
            key |= self.seq[j : n + j]
        order = np.argsort(key)
        keys = key[order]
        new = np.ones(n, dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        known = self.packed
        while known < depth:
            tied = ~new
            tied[:-1] |= tied[1:].copy()
            rows = np.flatnonzero(tied)
            if not len(rows):
                break
            place = order[rows]
            ahead = place + known
            second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            both = rank[place] * (n + 1) + second
            by = np.argsort(both)
            order[rows] = place[by]
            both = both[by]
            first = np.ones(len(rows), dtype=bool)
            first[1:] = both[1:] != both[:-1]
            new[rows] = first
            rank[order[rows]] = rows[first][np.cumsum(first) - 1]
            known *= 2
        return order, keys

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of foreign words; -1 where a word does not occur."""
        at = np.searchsorted(self.vocabulary, hashes)
        at_safe = np.minimum(at, max(len(self.vocabulary) - 1, 0))
        found = len(self.vocabulary) > 0
        hit = (self.vocabulary[at_safe] == hashes) if found else np.zeros(len(hashes), bool)
        return np.where(hit, at_safe + 1, -1)

    def ranges(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Rows [low, high) of the suffixes that begin with each window."""
        low_key = np.zeros(len(starts), dtype=np.int64)
        high_key = np.zeros(len(starts), dtype=np.int64)
        ones = (1 << self.bits) - 1
        padded = np.concatenate((ids, np.zeros(self.packed, dtype=ids.dtype)))
        for j in range(self.packed):
            word = padded[starts + j]
            low_key = (low_key << self.bits) | np.where(j < lengths, word, 0)
            high_key = (high_key << self.bits) | np.where(j < lengths, word, ones)
        low = np.searchsorted(self.keys, low_key, side="left")
        high = np.searchsorted(self.keys, high_key, side="right")
        deep = np.flatnonzero((lengths > self.packed) & (high > low))
        if len(deep):
            args = (ids, starts[deep], lengths[deep], low[deep], high[deep])
            low[deep], high[deep] = self._bound(*args, upper=False), self._bound(*args, upper=True)
        return low, high

    def _bound(self, ids, starts, lengths, low, high, upper: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        width = int(lengths.max())
        span = np.arange(self.packed, width)
        padded = np.concatenate((ids, np.zeros(width, dtype=ids.dtype)))
        wanted = padded[starts[:, None] + span]
        inside = span < lengths[:, None]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            diff = self.seq[self.order[mid][:, None] + span] - wanted[open_]
            diff[~inside[open_]] = 0
            first = np.argmax(diff != 0, axis=1)
            sign = diff[np.arange(len(open_)), first]
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]


def search_shard(hashes, bounds, block: Block):
    """Occurrences of the block's windows: the window, the word it starts at and its text."""
    counts = np.diff(bounds)
    separators = bounds[1:] + np.arange(len(counts))
    depth = int((block.item_end - np.arange(len(block.item_end))).max())
    array = SuffixArray(hashes, separators, depth)
    ids = array.ids(block.hashes)
    absent = np.concatenate(([0], np.cumsum(ids < 0)))
    known = np.flatnonzero(absent[block.starts + block.lengths] == absent[block.starts])
    if not len(known):
        return np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0, int)
    low, high = array.ranges(ids, block.starts[known], block.lengths[known])
    found = high - low
    window = np.repeat(known, found)
    row = np.arange(int(found.sum())) - np.repeat(np.cumsum(found) - found, found)
    place = array.order[np.repeat(low, found) + row]
    # Extend each occurrence to the longest verbatim match of the test suffix.
    length = block.lengths[window].copy()
    grow = np.arange(len(window))
    while len(grow):
        nxt = block.starts[window[grow]] + length[grow]
        inside = nxt < block.item_end[block.starts[window[grow]]]
        grow, nxt = grow[inside], nxt[inside]
        same = (ids[nxt] > 0) & (array.seq[place[grow] + length[grow]] == ids[nxt])
        grow = grow[same]
        length[grow] += 1
    text = np.searchsorted(separators, place, side="right")
    return window, place - text, text, length


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as sorted disjoint intervals."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], np.concatenate((ends[first[1:] - 1], ends[-1:]))


def mark_rows(part: pa.RecordBatch, block: Block) -> dict[str, list]:
    words = words_of(part.column("text"), ALNUM_WORDS, lower=True)
    counts, bounds, rows = words.counts, words.bounds, part.num_rows
    runs = [r or b"" for r in part.column("runs").to_pylist()]
    items = [i or [] for i in part.column("items").to_pylist()]
    matches = [m or [] for m in part.column("matches").to_pylist()]
    if len(words.hashes) and len(block.starts):
        window, place, text, length = search_shard(words.hashes, bounds, block)
        by = np.lexsort((place, text))
        window, place, text, length = window[by], place[by], text[by], length[by]
        cut = np.searchsorted(text, np.arange(rows + 1))
        for t in np.unique(text):
            a, b = cut[t], cut[t + 1]
            at = place[a:b] - bounds[t]
            before = np.frombuffer(runs[t], dtype=np.int32).reshape(-1, 2).astype(np.int64)
            lo, hi = merge_runs(
                np.concatenate((before[:, 0], at)),
                np.concatenate((before[:, 1], at + block.lengths[window[a:b]])),
            )
            runs[t] = np.column_stack((lo, hi)).astype(np.int32).tobytes()
            held = {block.item_ids[i] for w in np.unique(window[a:b]) for i in block.owners[w]}
            items[t] = sorted(held.union(items[t]))
            matches[t] = matches[t] + longest(block, window[a:b], at, length[a:b])
    spans = [np.frombuffer(r, dtype=np.int32).reshape(-1, 2) for r in runs]
    n_hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
    return {
        "n_words": counts.tolist(), "n_hit": n_hit, "runs": runs, "items": items,
        "matches": matches,
    }


def longest(block: Block, window, at, length) -> list[dict]:
    """Left-maximal matches: an occurrence inside a match that began earlier is part of it."""
    start = block.starts[window]
    ends: dict[int, int] = {}
    out = []
    for s, p, n in zip(start.tolist(), at.tolist(), length.tolist(), strict=True):
        if ends.get(p - s, -1) >= p + n:
            continue
        ends[p - s] = p + n
        item = int(np.searchsorted(block.item_first, s, side="right")) - 1
        out.append(
            {"item_id": block.item_ids[item], "item_start": s - int(block.item_first[item]),
             "doc_start": p, "length": n}
        )
    return out


def mark_documents(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    carry: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc`` (the columns in ``carry``, by default all), ``n_words``, ``n_hit``, ``items``
    (sorted ids of the items with occurring windows), ``matches`` (longest verbatim matches
    and their places) and ``contaminated`` (hit, and at least a twentieth of the words hit)."""
    carried = documents.columns if carry is None else carry
    marked = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"),
        "text",
        F.lit(None).cast("binary").alias("runs"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast(MATCHES).alias("matches"),
    )
    schema = T.StructType([marked.schema["doc"], *T.StructType.fromDDL(MARKS).fields])
    blocks = blocks_of(benchmark, window, block_bytes)
    block = next(blocks, None) or make_block([], [], window)
    while block is not None:
        following = next(blocks, None)
        search = searcher(
            documents.sparkSession.sparkContext.broadcast(block),  # at most block_bytes of text
            keep_text=following is not None,
        )
        marked = marked.select("doc", "text", "runs", "items", "matches").mapInArrow(search, schema)
        if following is not None:
            marked = store(marked, "marked")
        block = following
    hit = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return marked.select("doc", "n_words", "n_hit", "items", "matches", hit.alias("contaminated"))


def searcher(block, keep_text: bool):
    def search(batches):
        for part in text_slices(batches):
            marks = mark_rows(part, block.value)
            arrays = [part.column("doc")]
            arrays.append(part.column("text") if keep_text else pa.nulls(part.num_rows, pa.string()))
            arrays += [pa.array(marks[c], pa.int64()) for c in ("n_words", "n_hit")]
            kept = ("runs", "items", "matches")
            arrays += [pa.array(marks[c], part.schema.field(c).type) for c in kept]
            yield pa.RecordBatch.from_arrays(
                arrays, ["doc", "text", "n_words", "n_hit", "runs", "items", "matches"]
            )

    return search


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    marked = mark_documents(documents, benchmark, window)
    return marked.where(~F.col("contaminated")).select("doc.*")
