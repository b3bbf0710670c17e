"""Fuzzy line dedup: lines that meet in buckets, edit similarity, one line per connected group.

Lines are normalised to their words (ASCII letters lower-cased, other ASCII signs and white space
dropped; with ``fold_digits`` every digit reads as 0). Equal lines are folded first. Two lines are
linked if the edit similarity of their normalised forms is ``SIMILARITY`` or more; of each
connected group the first occurrence stays, by document id and line number. The query and the
pipeline use this one definition.

The dealt SimHash with pigeonhole blocks finds too few of these links (one replaced word flips
eight bits of a ten-word line), so lines meet on MinHash bands of their character grams instead:
three characters and rows of three for lines under ``MIDDLE`` characters, else nine and two
(long grams, as two lines of one language share short ones by chance).
Lines of up to 19 characters differ in one edit at most and meet on an intact half. A bucket
entry carries the line's length and a mark: from ``MIDDLE`` characters on a sketch, a bit per
minimum, below it counts of its letters. Pairs whose lengths or marks rule the similarity out are
dropped where they meet. Buckets of up to ``SMALL_BUCKET`` lines give all other pairs, of which the
edit distance sees the most alike of each line first and then those that no component holds.
Larger ones are cut by length; all members of one meet a hub first, and where several components
are left the lines are compared in tiles of bounded size, most alike partners first.

Defined cases: lines without words (and so null or empty texts) always stay; a document
whose every line went is left with an empty text; rows that share an id get the verdicts of
that id; documents with a null id take no part and stay whole; an empty table gives an
empty result; extra columns pass through ``drop_repeated_lines`` unchanged.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import (
    ALNUM_WORDS,
    LOWER,
    Steps,
    Words,
    if_small,
    mix64,
    text_bytes,
    text_slices,
)
from lodeworks.llm.graph import components

SIMILARITY = 0.9
# Lines of SHORT[0] to SHORT[1] characters meet on halves, those from MIDDLE on by longer grams.
# A pair has a tenth of its length for edits, so lines below a limit by that belong to both sides.
SHORT, MIDDLE = (9, 19), 60
# Bins are the first six bits of a hash.
BANDS, BINS = 16, 64
# Characters of a sketch's grams, and the bits of 64 in which alike lines agree at least: chance
# gives 32, the least similar linked lines about 45 (standard deviation 4).
SKETCH_GRAM, AGREEING = 5, 40
# Letters are counted in 16 classes of four bits, by the first byte of each character.
_CLASS = (np.arange(256, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(28)).astype(np.int64)
# Buckets up to this size give their pairs at once, larger ones in rounds of hubs.
SMALL_BUCKET = 128
# Lines of one side of a tile of a large bucket, and how many times more partners a next pass takes.
TILE, MORE = 2048, 8
# Pairs of one numpy pass.
PAIRS = 1 << 18
# Texts of one pass over their letters (its arrays stay in the cache), and bucket entries dealt at once.
LINE_BYTES, PACKED_BYTES = 1 << 17, 4 << 20
# Pairs of lines with up to so many edits are compared many at once, texts of so many bytes in one
# pass; from so few pairs on one by one. Classes of letters that rule pairs out.
FEW_EDITS, PAIR_BYTES, FEW_PAIRS, LETTERS = 400, 1 << 22, 3, 64
# Parts a task deals its bucket entries to, per shuffle partition.
PARTS = 1

_FOLD = LOWER.copy()
_FOLD[0x30:0x3A] = 0x30
_PROBES = np.random.default_rng(12).integers(0, BINS, size=(4096, BINS))
_EIGHTS = np.arange(0, 64, 8)
_STRIDE = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)
_LOW, _TOP, _ONES = (np.uint64(byte * 0x0101010101010101) for byte in (0x0F, 0x80, 0x01))


def line_table(column: pa.Array, fold_digits: bool = False):
    """Words of all lines; for each line with words its text, its number and its first word."""
    data, offsets = text_bytes(column)
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.unique(np.concatenate((filled, np.flatnonzero(data == 0x0A) + 1)))
    starts = starts[starts < len(data)]
    bounds = np.searchsorted(starts, offsets)
    words = Words((_FOLD if fold_digits else LOWER)[data], np.append(starts, len(data)), ALNUM_WORDS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    number = np.arange(len(starts)) - bounds[:-1][text]
    spoken = np.flatnonzero(words.counts > 0)
    return words, text[spoken], number[spoken], spoken, bounds


def line_keys(words: Words, spoken: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line's words in order."""
    if not len(spoken):
        return np.empty(0, np.int64)
    first = words.bounds[:-1][spoken]
    place = np.arange(len(words.hashes)) - np.repeat(first, words.counts[spoken])
    turned = mix64(words.hashes + place.astype(np.uint64) * _STRIDE)
    return mix64(np.add.reduceat(turned, first)).view(np.int64)


def lengths(words: Words, spoken: np.ndarray) -> np.ndarray:
    """The characters of each normalised line."""
    first = np.concatenate(([0], np.cumsum(words.ends - words.starts)))[words.bounds]
    # All but the continuation bytes of UTF-8 begin a character.
    inner = np.searchsorted(np.flatnonzero((words.letters & 0xC0) == 0x80), first)
    return np.diff(first - inner)[spoken] + words.counts[spoken] - 1


def half_keys(line: bytes) -> list[int]:
    """Keys of which two lines share one if one edit at most parts them: the first and the last
    half of the shorter one, and of the line itself as the longer one."""
    text = line.decode("utf-8", "replace")
    keys = []
    for size in (len(text), len(text) - 1):
        half = size // 2
        for side, part in enumerate((text[:half], text[len(text) - (size - half) :])):
            keys.append(zlib.crc32(f"{size} {side} {part}".encode()) & 0x7FFFFFFF)
    return keys


def minima(chars: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """A row of ``BINS`` minima of the grams of ``size`` bytes of each line (one-permutation
    hashing; empty bins borrow from full ones by fixed random probes)."""
    lines = len(counts)
    last = len(chars) - size + 1
    table = np.full(lines * BINS, np.iinfo(np.uint64).max, np.uint64)
    if last > 0:
        # Codes of 2, 4 or 8 bytes, and single bytes at the end for the rest of the size.
        held = min(8, 1 << size.bit_length() - 1)
        chars = np.ascontiguousarray(chars)
        hashes = np.ndarray(last, f"<u{held}", chars, strides=(1,)).astype(np.uint64)
        for i in range(held, size):
            hashes *= _STRIDE
            hashes += chars[i : i + last]
        hashes *= _TURN
        hashes ^= hashes >> np.uint64(32)
        hashes *= _STRIDE
        # Grams that begin so late that they reach into the next line are none.
        over = np.cumsum(counts)[:, None] - np.arange(1, size)
        over = over[(over >= 0) & (over < last)]
        hashes[over] = np.iinfo(np.uint64).max
        slot = np.repeat(np.arange(0, lines * BINS, BINS), counts)[:last]
        slot += (hashes >> np.uint64(64 - 6)).view(np.int64)
        np.minimum.at(table, slot, hashes)
    full = (table != np.iinfo(np.uint64).max).reshape(lines, BINS)
    given = table.copy()
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    probe = 0
    while len(row):
        donor = _PROBES[probe % len(_PROBES), col]
        lucky = full[row, donor]
        given[row[lucky] * BINS + col[lucky]] = table[row[lucky] * BINS + donor[lucky]]
        row, col = row[~lucky], col[~lucky]
        probe += 1
    return given.reshape(lines, BINS)


def line_letters(words: Words, spoken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of the lines, one line after the other, and how many each has."""
    before = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    start = before[words.bounds[:-1][spoken]]
    n = before[words.bounds[1:][spoken]] - start
    at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
    return words.letters[at], n


class Letters:
    """The letters of lines in ascending order of their sizes."""

    def __init__(self, words: Words, spoken: np.ndarray, size: np.ndarray):
        self.size = size
        self.letters, self.counts = line_letters(words, spoken)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def of(self, low: float, high: float) -> tuple[slice, np.ndarray, np.ndarray]:
        """The lines of ``low`` to under ``high`` characters, their letters and how many each has."""
        some = slice(*np.searchsorted(self.size, (low, high)).tolist())
        return some, self.letters[self.first[some.start] : self.first[some.stop]], self.counts[some]


def sketches(words: Words, spoken: np.ndarray) -> np.ndarray:
    return letter_sketches(*line_letters(words, spoken))


def letter_sketches(letters: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One bit of each minimum of the line's grams."""
    bits = (minima(letters, n, SKETCH_GRAM) & np.uint64(1)).astype(bool)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def letter_counts(words: Words, spoken: np.ndarray) -> np.ndarray:
    return class_counts(*line_letters(words, spoken))


def class_counts(letters: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often letters of each class stand in the line, up to 15, four bits a class."""
    begun = (letters & 0xC0) != 0x80
    at = np.repeat(np.arange(len(n)) * 16, n)[begun] + _CLASS[letters[begun]]
    counts = np.minimum(np.bincount(at, minlength=16 * len(n)), 15).reshape(-1, 16).astype(np.uint64)
    return np.bitwise_or.reduce(counts << np.arange(0, 64, 4, dtype=np.uint64), axis=1)


def gram_counts(letters: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often pairs of neighbouring letters of each class stand in the line, up to 3, two bits a class."""
    begun = (letters & 0xC0) != 0x80
    line = np.repeat(np.arange(len(n)) * 32, n)[begun]
    own = letters[begun].astype(np.uint32)
    pair = (own[:-1] * np.uint32(2654435761) + own[1:] * np.uint32(2246822519)) >> np.uint32(27)
    inside = line[:-1] == line[1:]
    counts = np.bincount(line[:-1][inside] + pair[inside], minlength=32 * len(n))
    counts = np.minimum(counts, 3).reshape(-1, 32).astype(np.uint64)
    return np.bitwise_or.reduce(counts << np.arange(0, 64, 2, dtype=np.uint64), axis=1)


def letters_apart(x: np.ndarray, y: np.ndarray, bits: int = 4) -> np.ndarray:
    """A lower bound of the edits between lines with these counts of ``bits`` bits a class: an edit
    takes one letter of a class away, adds one, or both (of the pairs of letters up to two)."""
    more, apart = np.zeros(len(x), np.int16), np.zeros(len(x), np.int16)
    low = _LOW if bits == 4 else _LOW // np.uint64(5)
    # One class of a byte at a time: no byte of ``gap`` borrows from the next.
    for shift in range(0, 8, bits):
        own, other = (v >> np.uint64(shift) & low for v in (x, y))
        gap = (own | _TOP) - other
        above = np.maximum(gap.view(np.uint8), np.uint8(128)).view(np.uint64) ^ _TOP
        more += byte_sums(above)
        apart += byte_sums(own) - byte_sums(other)
    return np.maximum(more, more - apart)


def byte_sums(x: np.ndarray) -> np.ndarray:
    """The sum of the eight bytes of each number, under 256."""
    return (x * _ONES >> np.uint64(56)).astype(np.int16)


def meeting_keys(words: Words, spoken: np.ndarray, size: np.ndarray) -> pa.Array:
    """The buckets of each line of ``size`` characters: halves of short lines, bands of others."""
    by = np.argsort(size, kind="stable")
    line, keys = bucket_keys(words, spoken[by], Letters(words, spoken[by], size[by]))
    line = by[line]
    held = np.bincount(line, minlength=len(spoken))
    offsets = np.concatenate(([0], np.cumsum(held))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[np.argsort(line, kind="stable")]))


def bucket_keys(words: Words, spoken: np.ndarray, lines: Letters) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the lines, in ascending order of sizes, and the line of each."""
    raw = words.data.tobytes()
    some = lines.of(SHORT[0], SHORT[1] + 1)[0]
    halves = []
    for line in spoken[some].tolist():
        a, b = words.bounds[line], words.bounds[line + 1]
        spans = zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)
        halves += half_keys(b" ".join(raw[s:e] for s, e in spans))
    pieces = [(np.repeat(np.arange(some.start, some.stop), 4), np.array(halves, np.int32))]
    for kind, (low, high, gram, rows) in enumerate(
        ((SHORT[1] - 1, MIDDLE, 3, 3), (MIDDLE * 9 // 10, np.inf, 9, 2))
    ):
        some, letters, counts = lines.of(low, high)
        if not len(counts):
            continue
        values = minima(letters, counts, gram).reshape(-1, BANDS, BINS // BANDS)
        band = np.broadcast_to(
            np.arange(BANDS, dtype=np.uint64) + np.uint64(BANDS * kind), values.shape[:2]
        )
        for i in range(rows):
            band = mix64(band * np.uint64(31) + values[:, :, i])
        own = np.repeat(np.arange(some.start, some.stop), BANDS)
        pieces.append((own, (band & np.uint64(0x7FFFFFFF)).astype(np.int32).ravel()))
    return np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])


# ``sketch``: below MIDDLE characters the letter counts.
ENTRY = np.dtype([("bucket", "<u4"), ("id", "<i8"), ("size", "<u4"), ("sketch", "<u8")])
# With counts of pairs of letters, for lines below MIDDLE characters.
MARKED = np.dtype([*ENTRY.descr, ("grams", "<u8")])
# A line where it stands: its key, document and number.
PLACE = np.dtype([("key", "<i8"), ("doc_id", "<i8"), ("line", "<i4")])


def bucket_entries(parts: int, fold_digits: bool, places: bool = False):
    """The bucket entries of the lines, packed: binaries per part of the buckets and run of slices
    (``grams``: a number per entry of a line below ``MIDDLE`` characters). With ``places`` also where
    each line stands (``doc_id``), by parts of the keys."""

    def dealt(rows, to):
        rows = rows[np.argsort(to.astype(np.uint16) if parts <= 1 << 16 else to, kind="stable")]
        ends = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=parts))))
        return [rows[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def of_slice(part):
        words, text, number, spoken, _ = line_table(part.column("text"), fold_digits)
        keys = line_keys(words, spoken)
        key, first = np.unique(keys, return_index=True)
        spoken = spoken[first]
        size = lengths(words, spoken)
        by = np.argsort(size, kind="stable")
        key, spoken, size = key[by], spoken[by], size[by]
        lines = Letters(words, spoken, size)
        marks = [class_counts(*lines.of(0, MIDDLE)[1:]), letter_sketches(*lines.of(MIDDLE, np.inf)[1:])]
        line, bucket = bucket_keys(words, spoken, lines)
        entries = np.empty(len(line), ENTRY)
        entries["bucket"] = bucket
        for name, values in (("id", key), ("size", size), ("sketch", np.concatenate(marks))):
            entries[name] = values[line]
        where = np.empty(len(keys) if places else 0, PLACE)
        if places:
            where["key"], where["line"] = keys, number
            where["doc_id"] = part.column("doc_id").to_numpy()[text]
        few = line < lines.of(0, MIDDLE)[0].stop
        return entries, gram_counts(*lines.of(0, MIDDLE)[1:])[line[few]], where

    def packed(held):
        entries, grams, where = (np.concatenate(x) for x in zip(*held, strict=True))
        to = entries["bucket"] % parts
        columns = [dealt(entries, to), dealt(grams, to[entries["size"] < MIDDLE])]
        if places:
            columns.append(dealt(where, where["key"] % parts))
        columns = [pa.array(x, pa.binary()) for x in columns]
        names = ["part", "entries", "grams", "places"][: 1 + len(columns)]
        return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), *columns], names)

    def run(batches):
        held, size = [], 0
        for part in text_slices(batches, limit=LINE_BYTES):
            held.append(of_slice(part))
            size += held[-1][0].nbytes
            if size >= PACKED_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def wanted_lines(fold_digits: bool):
    def run(batches):
        yield from _wanted_lines(batches, fold_digits)

    return run


def _wanted_lines(batches, fold_digits):
    """The normalised form of the lines of ``wanted`` (``line, key``) of each document."""
    for part in text_slices(batches):
        keys, lines = [], []
        for text, wanted in zip(
            part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True
        ):
            own = (text or "").split("\n")
            for w in wanted:
                if w["line"] < len(own):
                    keys.append(w["key"])
                    lines.append(own[w["line"]])
        words, _, _, _, bounds = line_table(pa.array(lines, pa.string()), fold_digits)
        raw = words.data.tobytes()
        spans = [raw[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        ends = words.bounds[bounds].tolist()
        plain = [b" ".join(spans[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(plain, pa.binary())], ["id", "line"]
        )


def may_link(a, b) -> np.ndarray:
    """Whether lengths and sketches of the entries leave the edit similarity open (one line
    below ``MIDDLE`` has no sketch)."""
    longer = np.maximum(a["size"], b["size"]).astype(np.int64)
    apart = np.abs(a["size"].astype(np.int64) - b["size"].astype(np.int64))
    alike = np.bitwise_count(a["sketch"] ^ b["sketch"]) <= 64 - AGREEING
    return (10 * apart <= longer) & (alike | (np.minimum(a["size"], b["size"]) < MIDDLE))


def fit_letters(size_a, size_b, mark_a, mark_b) -> np.ndarray:
    """Whether the letter counts leave pairs open; those with a line from ``MIDDLE`` on stay."""
    longer = np.maximum(size_a, size_b).astype(np.int64)
    fit = longer >= MIDDLE
    few = np.flatnonzero(~fit)
    fit[few] = 10 * letters_apart(mark_a[few], mark_b[few]) <= longer[few]
    return fit


def within(a: str, b: str, most: int) -> bool:
    """Whether ``most`` edits at most part the lines: a column of the distance table at a time, as
    the bits of whole numbers, between the first and the last difference."""
    if abs(len(a) - len(b)) > most:
        return False
    start, end = 0, min(len(a), len(b))
    while start < end:
        half = (start + end + 1) // 2
        start, end = (half, end) if a[start:half] == b[start:half] else (start, half - 1)
    a, b = a[start:], b[start:]
    start, end = 0, min(len(a), len(b))
    while start < end:
        half = (start + end + 1) // 2
        same = a[len(a) - half : len(a) - start] == b[len(b) - half : len(b) - start]
        start, end = (half, end) if same else (start, half - 1)
    a, b = a[: len(a) - start], b[: len(b) - start]
    if not a or not b:
        return True
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    top, full = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, score, left = full, 0, len(a), len(b)
    for y in b:
        same = at.get(y, 0) | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | full & ~(level | up), up & level
        score += bool(more & top) - bool(less & top)
        left -= 1
        # Each column left lowers the score by one at most.
        if score - left > most:
            return False
        more, less = more << 1 & full | 1, less << 1 & full
        up, down = less | full & ~(level | more), more & level
    return score <= most


def side(lines: list[bytes], mark: int) -> tuple[np.ndarray, ...]:
    """Of Latin-1 lines: their characters, the eight characters from each place on, in one number, where each line
    begins and its length (eight times ``mark`` stand after a line), and counts of its letters."""
    size = np.array([len(x) for x in lines], np.int64)
    first = np.cumsum(size + 8) - size - 8
    ended = bytes([mark]) * 8
    raw = ended.join([*lines, ended * 9])
    codes = np.frombuffer(raw, np.uint8)
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)).copy()
    slot = np.repeat(np.arange(len(lines)) * LETTERS, size + 8)
    slot += codes[: len(slot)] & (LETTERS - 1)
    counts = np.bincount(slot, minlength=LETTERS * len(lines)).reshape(-1, LETTERS)
    return codes, eights, first, size, counts


def equal_bytes(apart: np.ndarray) -> np.ndarray:
    """How many of eight bytes agree before the first that differs."""
    return np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3


def within_each(left: list[bytes], right: list[bytes], most: np.ndarray) -> np.ndarray:
    """``within`` for many pairs of Latin-1 lines at once: for 0, 1, 2, ... edits the furthest
    places that each diagonal of the distance table reaches."""
    (raw_a, codes_a, at_a, size_a, count_a), (raw_b, codes_b, at_b, size_b, count_b) = side(left, 0), side(right, 1)
    shift = size_b - size_a
    # An edit takes one letter of a class away, adds one, or both (the marks after the lines: 8 each).
    gap = count_b - count_a
    gap[:, 0] += 8
    gap[:, 1] -= 8
    more = np.maximum(gap, 0).sum(axis=1)
    result = most >= np.maximum(size_a, size_b)
    open_ = np.flatnonzero((np.maximum(more, more - shift) <= most) & ~result)
    open_ = open_[np.argsort(most[open_], kind="stable")]
    start = 0
    while start < len(open_):
        # Pairs of limits of one order, as tables of one width.
        end = int(np.searchsorted(most[open_], 2 * most[open_[start]] + 8, side="right"))
        some, start = open_[start:end], end
        wide = int(most[some].max()) + 1
        # reach[:, wide + d] of diagonal d: characters of the left line that are matched or edited.
        reach = np.full((len(some), 2 * wide + 1), -2, np.int32)
        reach[:, wide] = -1
        ends = np.minimum(size_a[some, None], size_b[some, None] - np.arange(-wide, wide + 1)).astype(np.int32)
        beyond = bool((ends < 0).any())
        for edits in range(wide):
            if len(some) < FEW_PAIRS:
                result[some] = [
                    within(*(x[i].decode("latin-1") for x in (left, right)), int(most[i])) for i in some.tolist()
                ]
                break
            # A diagonal that the edits left cannot lead back from to the lines' ends is of no use.
            low = wide + max(-edits, int((shift[some] - most[some]).min()) + edits)
            high = wide + min(edits, int((shift[some] + most[some]).max()) - edits) + 1
            if low >= high:
                break
            now = np.maximum(reach[:, low:high], reach[:, low + 1 : high + 1])
            now += 1
            np.maximum(now, reach[:, low - 1 : high - 1], out=now)
            np.minimum(now, ends[:, low:high], out=now)
            flat = now.ravel()
            x = (now + at_a[some, None]).ravel()
            y = (now + (at_b[some, None] + np.arange(low - wide, high - wide))).ravel()
            if beyond:
                live = np.flatnonzero((flat >= 0) & (now + np.arange(low - wide, high - wide) >= 0).ravel())
                live = live[raw_a[x[live]] == raw_b[y[live]]]
            else:
                live = np.flatnonzero(raw_a[x] == raw_b[y])
            x, y = x[live], y[live]
            same = equal_bytes(codes_a[x] ^ codes_b[y])
            flat[live] += same
            on = np.flatnonzero(same == 8)
            live, x, y = live[on], x[on] + 8, y[on] + 8
            while len(x):
                # Eight numbers at a time, to the first that differs.
                apart = codes_a[x[:, None] + _EIGHTS] ^ codes_b[y[:, None] + _EIGHTS]
                first = np.argmax(apart != 0, axis=1)
                last = apart[np.arange(len(x)), first]
                flat[live] += np.where(last == 0, 64, 8 * first + equal_bytes(last))
                on = np.flatnonzero(last == 0)
                live, x, y = live[on], x[on] + 64, y[on] + 64
            reach[:, low:high] = now
            there = reach[np.arange(len(some)), np.clip(wide + shift[some], 0, 2 * wide)] >= size_a[some]
            there &= (edits <= most[some]) & (np.abs(shift[some]) <= edits)
            result[some[there]] = True
            go_on = ~there & (most[some] > edits)
            if np.count_nonzero(go_on) < 0.9 * len(some):
                some, reach, ends = some[go_on], reach[go_on], ends[go_on]
    return result


def similar(left: list[str], right: list[str]) -> np.ndarray:
    """Whether the lines of each pair are similar enough."""
    share = round(1 - SIMILARITY, 6)
    most = np.array([int(max(len(x), len(y)) * share) for x, y in zip(left, right, strict=True)], np.int64)
    near = np.zeros(len(left), bool)
    at, sides, held = [], ([], []), 0
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if most[i] > FEW_EDITS:
            near[i] = within(x, y, int(most[i]))
            continue
        try:
            pair = x.encode("latin-1"), y.encode("latin-1")
        except UnicodeEncodeError:
            near[i] = within(x, y, int(most[i]))
            continue
        at.append(i)
        for lines, line in zip(sides, pair, strict=True):
            lines.append(line)
        held += len(x) + len(y)
        if held >= PAIR_BYTES:
            near[at] = within_each(*sides, most[at])
            at, sides, held = [], ([], []), 0
    if at:
        near[at] = within_each(*sides, most[at])
    return near


def similar_pairs(batches):
    """The pairs ``a, b`` whose lines ``la, lb`` are similar enough."""
    for batch in batches:
        near = similar(*(batch.column(c).to_pylist() for c in ("la", "lb")))
        yield batch.select(["a", "b"]).filter(pa.array(near))


def open_pair(a, b) -> np.ndarray:
    """Whether lengths, sketches and letter counts leave the edit similarity open."""
    both = may_link(a, b)
    a, b = a[both], b[both]
    fit = np.zeros(len(both), bool)
    fit[both] = fit_letters(a["size"], b["size"], a["sketch"], b["sketch"])
    if "grams" in (a.dtype.names or ()):
        few = np.flatnonzero(both)[np.maximum(a["size"], b["size"]) < MIDDLE]
        few = np.searchsorted(np.flatnonzero(both), few[fit[few]])
        a, b = a[few], b[few]
        edits = (letters_apart(a["grams"], b["grams"], 2) + 1) // 2
        fit[np.flatnonzero(both)[few]] = 10 * edits <= np.maximum(a["size"], b["size"])
    return fit


def open_places(bucket: np.ndarray, entries: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs of entries of one bucket, sorted by it, that may be linked."""
    at = np.arange(len(entries))
    none = np.empty(0, np.int64)
    left, right = [none], [none]
    for gap in range(1, len(entries)):
        at = at[: np.searchsorted(at, len(entries) - gap)]
        at = at[bucket[at + gap] == bucket[at]]
        if not len(at):
            break
        for some in np.array_split(at, len(at) // PAIRS + 1):
            some = some[rule(entries[some], entries[some + gap])]
            left.append(some)
            right.append(some + gap)
    return np.concatenate(left), np.concatenate(right)


def near_pairs(entries: np.ndarray, rule=may_link) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of entries of one bucket, sorted by it, that may be linked."""
    left, right = (entries["id"][x] for x in open_places(entries["bucket"], entries, rule))
    return np.minimum(left, right), np.maximum(left, right)


def unlike(a, b) -> np.ndarray:
    """How unlike the lines of two entries look: bits of their sketches, or edits by letter counts
    (one line below ``MIDDLE`` has no sketch)."""
    bits = np.bitwise_count(a["sketch"] ^ b["sketch"]).astype(np.int16)
    few = np.maximum(a["size"], b["size"]) < MIDDLE
    bits[few] = letters_apart(a["sketch"][few], b["sketch"][few])
    bits[~few & (np.minimum(a["size"], b["size"]) < MIDDLE)] = 64
    return bits


def runs(bucket: np.ndarray) -> np.ndarray:
    """How many entries the bucket of each entry has; they are sorted by bucket."""
    change = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    size = np.diff(np.r_[0, change, len(bucket)])
    return np.repeat(size, size)


def shared_buckets(packed: list[bytes], grams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the buckets of several lines, in order and once each, and their buckets' sizes."""
    entries = np.frombuffer(b"".join(packed), ENTRY)
    # Buckets in order, each with the place of its entry.
    order = entries["bucket"].astype(np.uint64) << np.uint64(32)
    order |= np.arange(len(entries), dtype=np.uint64)
    order.sort()
    same = order[1:] >> np.uint64(32) == order[:-1] >> np.uint64(32)
    several = np.zeros(len(entries), bool)
    several[1:] |= same
    several[:-1] |= same
    at = (order[several] & np.uint64(0xFFFFFFFF)).view(np.int64)
    place = np.cumsum(entries["size"] < MIDDLE) - 1
    marked = np.zeros(len(at), MARKED)
    for name in ENTRY.names:
        marked[name] = entries[name][at]
    few = marked["size"] < MIDDLE
    marked["grams"][few] = np.frombuffer(b"".join(grams), np.uint64)[place[at[few]]]
    marked = marked[np.lexsort((marked["id"], marked["bucket"]))]
    again = np.zeros(len(marked), bool)
    again[1:] = (marked["bucket"][1:] == marked["bucket"][:-1]) & (marked["id"][1:] == marked["id"][:-1])
    marked = marked[~again]
    size = runs(marked["bucket"])
    return marked[size > 1], size[size > 1]


def by_length(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Large buckets cut by length: a class spans a tenth, so alike lines are of one class or of two
    neighbours; a line goes to the buckets of its class and of the class below it. Returns the new
    buckets, sorted, and their entries."""
    kind = (np.log(entries["size"]) / (np.log(10 / 9) * (1 + 1e-9))).astype(np.int64) + 1
    bucket = entries["bucket"].astype(np.int64) << 16
    bucket = np.concatenate((bucket + kind, bucket + kind - 1))
    entries = np.concatenate((entries, entries))
    by = np.lexsort((entries["id"], bucket))
    return bucket[by], entries[by]


MET = "bucket long, a long, b long, size long, sketch long, grams long, line int, first boolean, again boolean, unlike int"


def bucket_reader(limit: int):
    """Per part: pairs of its small buckets (``a, b``, how ``unlike``), the members of its large ones
    (``bucket, a, size, sketch, grams``), the places of its lines (document ``a``, key ``b``, ``line``;
    whether it is the ``first`` of the key, whether the key stands ``again`` elsewhere)."""
    kinds = [*[pa.int64()] * 6, pa.int32(), pa.bool_(), pa.bool_(), pa.int32()]
    names = ["bucket", "a", "b", "size", "sketch", "grams", "line", "first", "again", "unlike"]

    def rows(**columns):
        n = len(next(iter(columns.values())))
        full = [pa.array(columns[c]).cast(k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(full, names)

    def settle(packed, grams, places):
        entries, size = shared_buckets(packed, grams)
        cut, members = by_length(entries[size > limit])
        size_cut = runs(cut)
        found = []
        for bucket, own in ((entries["bucket"][size <= limit], entries[size <= limit]),
                            (cut[size_cut <= limit], members[size_cut <= limit])):
            i, j = open_places(bucket, own, open_pair)
            ends = own["id"][i], own["id"][j]
            found.append((np.minimum(*ends), np.maximum(*ends), unlike(own[i], own[j])))
        a, b, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((b, a))
        a, b, apart = a[by], b[by], apart[by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield rows(a=a[new], b=b[new], unlike=apart[new])
        cut, members = cut[size_cut > limit], members[size_cut > limit]
        yield rows(bucket=cut, a=members["id"], size=members["size"], sketch=members["sketch"].view(np.int64), grams=members["grams"].view(np.int64))
        where = np.frombuffer(b"".join(places), PLACE)
        where = where[np.lexsort((where["line"], where["doc_id"], where["key"]))]
        new = np.ones(len(where), bool)
        new[1:] = np.any([where[x][1:] != where[x][:-1] for x in PLACE.names], axis=0)
        where = where[new]
        first = np.ones(len(where), bool)
        first[1:] = where["key"][1:] != where["key"][:-1]
        yield rows(a=where["doc_id"], b=where["key"], line=where["line"], first=first, again=runs(where["key"]) > 1)

    def read(batches):
        at, held = None, ([], [], [])
        for batch in batches:
            columns = batch.to_pydict()
            own = columns.get("places", [b""] * batch.num_rows)
            for part, *packed in zip(columns["part"], columns["entries"], columns["grams"], own, strict=True):
                if held[0] and part != at:
                    yield from settle(*held)
                    held = ([], [], [])
                at = part
                for x, y in zip(held, packed, strict=True):
                    x.append(y)
        if held[0]:
            yield from settle(*held)

    return read


def repeated_lines(
    documents: DataFrame, steps: Steps, small_bucket: int = SMALL_BUCKET, fold_digits: bool = False
) -> DataFrame:
    """``doc_id, lines``: the numbers of the lines to remove from each document."""
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = steps.store(
        docs.mapInArrow(bucket_entries(parts, fold_digits, True), "part int, entries binary, grams binary, places binary")
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(bucket_reader(small_bucket), MET),
        "met",
    )
    lines = met.where("line is not null").select(F.col("a").alias("doc_id"), "line", F.col("b").alias("key"), "first", "again")
    near = met.where("bucket is null and line is null").groupBy("a", "b").agg(F.min("unlike").alias("unlike"))
    near = steps.store(near, "near")
    large = steps.store(
        met.where("bucket is not null").select("bucket", F.col("a").alias("id"), "size", "sketch", "grams"), "large"
    )

    # The normalised lines of all that may be linked, read once where they first occur.
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select("id")).distinct()
    wanted = if_small(steps.store(wanted, "ids"))
    place = F.struct("doc_id", "line")
    distinct = lines.where("first").select(F.col("key").alias("id"), place.alias("first"))
    by_doc = steps.store(
        wanted.join(distinct, "id")
        .groupBy(F.col("first.doc_id").alias("_id"))
        .agg(F.collect_list(F.struct("first.line", F.col("id").alias("key"))).alias("wanted")),
        "wanted",
    )
    texts = steps.store(
        docs.join(if_small(by_doc, 16 * F.size("wanted")), F.col("doc_id") == F.col("_id"))
        .select("text", "wanted")
        .mapInArrow(wanted_lines(fold_digits), "id long, line binary")
        .groupBy("id")
        .agg(F.max("line").cast("string").alias("line")),
        "texts",
    )

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs whose normalised lines are similar enough."""
        return (
            pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
            .mapInArrow(similar_pairs, "a long, b long")
        )

    _, groups = line_groups(near, large, alike, steps, texts)
    # All places of the lines of which one stays.
    marked = steps.store(
        lines.join(if_small(groups).withColumnRenamed("id", "key"), "key", "left")
        .where("again or component is not null")
        .select("doc_id", "line", F.coalesce("component", "key").alias("c")),
        "marked",
    )
    keepers = steps.store(marked.groupBy("c").agg(F.min(place).alias("keeper")), "keepers")
    return (
        marked.join(keepers, "c")
        .where(place != F.col("keeper"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("line")).alias("lines"))
    )


def pair_links(near: DataFrame, alike, steps: Steps) -> DataFrame:
    """Links with the components of all links among the pairs ``a, b`` (a < b): each line is
    compared with one partner, and then the pairs that no component holds."""
    return line_groups(near, None, alike, steps)[0]


def line_groups(
    near: DataFrame, large: DataFrame | None, alike, steps: Steps, texts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Links and their components among the pairs ``near`` (``a, b``, perhaps how ``unlike``) and
    within the large buckets (``bucket, id, size, sketch, grams``; their lines in ``texts``).

    Each line is compared with its most alike partner, each member of a large bucket with the first
    of it; that settles near copies. Then all pairs that no component holds are, those of large
    buckets of several components where the lines meet (``bucket_links``). So every pair was
    compared, ruled out or lies in one component.
    """
    if large is not None and large.isEmpty():
        large = None
    best = F.struct(*[c for c in ("unlike", "a") if c in near.columns])
    first = steps.store(
        near.groupBy("b").agg(F.min(best).alias("best")).select(F.col("best.a").alias("a"), "b"), "first"
    )
    pairs = first if large is None else first.unionByName(hub_pairs(large, steps)).distinct()
    links = steps.store(alike(pairs), "links")
    groups = steps.store(components(links), "groups")
    rest = near.join(if_small(first).withColumnRenamed("a", "_a"), "b").where("a <> _a").select("a", "b")
    known = if_small(groups)
    for end in ("a", "b"):
        own = known.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        rest = rest.join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    rest = steps.store(rest.where("ca <> cb").select("a", "b"), "rest")
    links = links.unionByName(alike(rest))
    if large is not None:
        links = links.unionByName(bucket_links(large, groups, texts, steps))
    links = steps.store(links, "links")
    return links, steps.store(components(links), "groups")


def tile_lines(table: pa.Table) -> np.ndarray:
    """The entries of the lines of a tile."""
    lines = np.empty(table.num_rows, MARKED if "grams" in table.column_names else ENTRY)
    for name in lines.dtype.names[1:]:
        lines[name] = table.column(name).to_numpy().view(np.int64 if name in ("id", "size") else np.uint64)
    return lines


def tile_pairs(table: pa.Table, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a tile of a large bucket (``id, size, sketch, c, side, apart``), by id: the places of the
    pairs between components that lengths and marks leave open, for each line ``b`` the most alike
    first. With ``apart``, only pairs of different sides."""
    c, side = (table.column(x).to_numpy() for x in ("c", "side"))
    apart = table.column("apart")[0].as_py()
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low in range(1, len(lines), 256):
        own = np.arange(low, min(low + 256, len(lines)))
        free = (c[own][:, None] != c) & (own[:, None] > np.arange(len(lines)))
        if apart:
            free &= side[own][:, None] != side
        b, a = np.nonzero(free)
        b = own[b]
        open_ = np.flatnonzero(open_pair(lines[a], lines[b]))
        a, b = a[open_], b[open_]
        by = np.lexsort((a, np.bitwise_count(lines["sketch"][a] ^ lines["sketch"][b]), b))
        left.append(a[by])
        right.append(b[by])
    return np.concatenate(left), np.concatenate(right)


def proposals(partners: int):
    """Of a tile of a large bucket: a line ``b`` proposes its ``partners`` most alike open smaller
    ones ``a`` (``more``: it has others)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        lines = tile_lines(table)
        a, b = tile_pairs(table, lines)
        kept = np.arange(len(b)) - np.searchsorted(b, b) < partners
        count = np.searchsorted(b, b, side="right") - np.searchsorted(b, b)
        columns = [lines["id"][a[kept]], lines["id"][b[kept]], count[kept] > partners]
        return pa.table(columns, ["a", "b", "more"])

    return run


def first_shared(bucket: int, buckets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs share no bucket below this one; ``buckets`` has a row per line."""
    first = np.ones(len(a), bool)
    # Other buckets become a number of the line's own.
    below = np.where(buckets < bucket, buckets, -1 - np.arange(len(buckets))[:, None])
    for some in np.array_split(np.arange(len(a)), len(a) // 4096 + 1):
        x, y = below[a[some]], below[b[some]]
        first[some] = ~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return first


def tile_links(table: pa.Table) -> pa.Table:
    """The links ``a, b`` between components in a tile of lines (``line``) of a large bucket: each
    line is compared with its most alike partners, more each pass, until every pair was compared or
    lies in one component. A pair belongs to the first bucket (``buckets``) that it shares."""
    table = table.sort_by("id")
    lines = tile_lines(table)
    a, b = tile_pairs(table, lines)
    lists = table.column("buckets").combine_chunks()
    held = np.diff(lists.offsets.to_numpy())
    buckets = np.full((len(lines), max(1, int(held.max()))), np.iinfo(np.int64).max)
    buckets[np.arange(buckets.shape[1]) < held[:, None]] = lists.flatten().to_numpy()
    first = first_shared(table.column("bucket")[0].as_py(), buckets, a, b)
    a, b = a[first], b[first]
    text = table.column("line").to_pylist()
    _, group = np.unique(table.column("c").to_numpy(), return_inverse=True)
    found, partners = [np.empty((2, 0), np.int64)], 1
    while len(a):
        tried = np.arange(len(b)) - np.searchsorted(b, b) < partners
        x, y = a[tried], b[tried]
        near = similar([text[i] for i in x.tolist()], [text[i] for i in y.tolist()])
        x, y = x[near], y[near]
        found.append(np.stack((lines["id"][x], lines["id"][y])))
        group = joined(group, x, y)
        on = ~tried & (group[a] != group[b])
        a, b = a[on], b[on]
        partners *= MORE
    return pa.table(list(np.concatenate(found, axis=1)), ["a", "b"])


def joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The groups once the members ``a`` and ``b`` of each pair are in one."""
    least = np.arange(len(group))
    while True:
        own = least[group]
        low = np.minimum(own[a], own[b])
        new = least.copy()
        np.minimum.at(new, own[a], low)
        np.minimum.at(new, own[b], low)
        new = new[new[least]]
        if (new == least).all():
            return least[group]
        least = new


def hub_pairs(large: DataFrame, steps: Steps) -> DataFrame:
    """Each member of a large bucket with the first of it, if lengths and marks leave the pair open."""
    hubs = large.groupBy("bucket").agg(F.min(F.struct("id", "size", "sketch")).alias("h"))
    hubs = steps.store(hubs, "hubs").select(F.col("bucket").alias("h_bucket"), *[F.col(f"h.{x}").alias(f"h_{x}") for x in ("id", "size", "sketch")])
    open_ = (F.col("id") != F.col("h_id")) & (10 * F.abs(F.col("size") - F.col("h_size")) <= F.greatest("size", "h_size"))
    alike_marks = F.bit_count(F.col("sketch").bitwiseXOR(F.col("h_sketch"))) <= 64 - AGREEING
    open_ &= alike_marks | (F.least("size", "h_size") < MIDDLE)
    return large.join(hubs, (F.col("bucket") == F.col("h_bucket")) & open_).select(F.col("h_id").alias("a"), F.col("id").alias("b"))


def bucket_links(large: DataFrame, groups: DataFrame, texts: DataFrame, steps: Steps) -> DataFrame:
    """Links ``a, b`` between components inside the large buckets of several components, which are
    cut into tiles of bounded size; the lines travel to the tiles, not the pairs."""
    members = large.groupBy("id").agg(
        F.array_sort(F.collect_set("bucket")).alias("buckets"), *[F.first(x).alias(x) for x in ("size", "sketch", "grams")]
    )
    members = members.join(groups, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    members = steps.store(members, "members")
    some = members.select(F.explode("buckets").alias("bucket"), "c").groupBy("bucket")
    some = some.agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"))
    some = steps.store(some.where("lo < hi").select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("k")), "mixed")
    tiles = (
        members.join(texts, "id")
        .withColumn("bucket", F.explode("buckets"))
        .join(some, "bucket")
        .withColumn("side", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("i", F.least("side", "other"))
        .withColumn("j", F.greatest("side", "other"))
        .withColumn("apart", F.col("i") < F.col("j"))
    )
    return tiles.groupBy("bucket", "i", "j").applyInArrow(tile_links, "a long, b long")


def without_lines(batches):
    for batch in batches:
        texts = batch.column("doc").field("text")
        flat = pa.RecordBatch.from_arrays(
            [batch.column("doc"), texts, batch.column("lines")], ["doc", "text", "lines"]
        )
        for part in text_slices([flat]):
            whole = part.column("text")
            filled = whole.fill_null("")
            # A line break at the very end opens no further line.
            ended = pc.or_(pc.equal(filled, ""), pc.ends_with(filled, "\n"))
            totals = pc.subtract(pc.add(pc.count_substring(filled, "\n"), 1), ended.cast(pa.int32()))
            gone = pc.list_value_length(part.column("lines")).fill_null(0)
            some = pc.greater(gone, 0)
            kept = []
            for text, lines in zip(filled.filter(some).to_pylist(), part.column("lines").filter(some).to_pylist(), strict=True):
                away = set(lines)
                kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in away))
            kept = pc.replace_with_mask(whole, some, pa.array(kept, whole.type))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), kept.cast(pa.string()), totals.cast(pa.int64()), gone.cast(pa.int64())],
                ["doc", "kept", "n_lines", "n_removed"],
            )


def remove_repeated_lines(
    documents: DataFrame, small_bucket: int = SMALL_BUCKET, fold_digits: bool = False
) -> DataFrame:
    """``doc`` (all columns of a document), ``kept`` (its text without the repeated lines),
    ``n_lines`` and ``n_removed``."""
    steps, last = Steps(), Steps()
    removed = repeated_lines(documents, steps, small_bucket, fold_digits)
    removed = last.store(removed.withColumnRenamed("doc_id", "_id"), "removed")
    steps.drop()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    joined = rows.join(
        if_small(removed, 4 * F.size("lines")), F.col("doc.doc_id") == F.col("_id"), "left"
    ).select("doc", "lines")
    schema = T.StructType(
        [rows.schema["doc"], *T.StructType.fromDDL("kept string, n_lines long, n_removed long").fields]
    )
    return joined.mapInArrow(without_lines, schema)


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents without repeated lines; those that lost every line they had go."""
    left = remove_repeated_lines(documents).where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    return left.select(
        *[(F.col("kept") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in documents.columns]
    )
