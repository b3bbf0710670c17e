"""Best-fit packing of token pieces into fixed-length sequences, by linear grouping.

Packing depends on the lengths alone, and there are at most ``capacity`` of them. Spark
tokenises and counts the pieces of each length; the driver solves the counts (its work and
memory depend on the capacity, not on the data); Spark then ranks the pieces of each length
and looks up the place of each rank.

The solution: large lengths are split, in order, into groups of equal cardinality and rounded
up to the largest of their group; configurations of these few sizes are filled to the brim one
after the other, each used as often as the counts allow; the actual pieces then take the
places of their group, and small pieces go best-fit, largest first, into what is left. Several
group counts are tried and the fewest sequences kept.

Defined cases: a null text is an empty document (one piece, the end token alone); repeated
rows are documents of their own; a null id stays null; an empty table gives no rows; extra
columns are not read. A text is tokenised whole; the tokenizer's own special strings in it get
their special ids, as the tokenizer does by default.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import store, text_slices

CAPACITY = 1024
END_ID = 2
GROUPS = (64, 256, 1024)
# Pieces up to this part of the capacity are the small ones.
SMALL_PART = 4
TOKENIZER = "byte_bpe_50k"

_ENCODERS: dict = {}


def encoder(name: str, with_special: bool = False):
    """The public byte-level BPE, from its rank file (the same ids as its JSON file, and
    several times as fast; a test compares them).

    ``with_special`` adds the special tokens of the JSON file, which that file's tokenizer
    finds inside texts as well.
    """
    if (name, with_special) not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {}
        if with_special:
            with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
                special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        _ENCODERS[name, with_special] = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _ENCODERS[name, with_special]


def text_ids(name: str):
    """Ids of a text as the JSON file's tokenizer gives them, special tokens in it included."""
    encode = encoder(name, with_special=True).encode
    return lambda text: encode(text or "", allowed_special="all")


def tokenise(capacity: int, tokenizer: str, with_ids: bool):
    def cut(batches):
        encode = text_ids(tokenizer)
        for part in text_slices(batches):
            rows: dict[str, list] = defaultdict(list)
            docs = part.column("doc_id").to_pylist()
            for doc, text in zip(docs, part.column("text").to_pylist(), strict=True):
                ids = np.array(encode(text) + [END_ID], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    body = ids[start:end]
                    rows["doc_id"].append(doc)
                    rows["piece"].append(piece)
                    rows["start"].append(start)
                    rows["length"].append(len(body))
                    rows["ids_crc32"].append(zlib.crc32(body.tobytes()))
                    rows["ids"].append(body.astype(np.int32).tolist() if with_ids else None)
            types = {
                "doc_id": part.schema.field("doc_id").type, "piece": pa.int32(),
                "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
                "ids": pa.list_(pa.int32()),
            }
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in types.items()], list(types))

    return cut


def linear_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths, largest first, in groups of about equal cardinality."""
    share = -(-sum(counts.values()) // groups)
    out: list[list[int]] = [[]]
    held = 0
    for length in sorted(counts, reverse=True):
        if out[-1] and held + counts[length] > share:
            out.append([])
            held = 0
        out[-1].append(length)
        held += counts[length]
    return [g for g in out if g]


def fullest(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """The multiset of sizes, within the counts left, that fills ``room`` best."""
    came = np.zeros(room + 1, dtype=np.int64)
    reached = np.zeros(room + 1, dtype=bool)
    reached[0] = True
    for size in sizes:
        fresh = reached
        for _ in range(min(left[size], room // size) if size <= room else 0):
            moved = np.zeros_like(reached)
            moved[size:] = fresh[:-size]
            fresh = moved & ~reached
            if not fresh.any():
                break
            came[fresh] = size
            reached = reached | fresh
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    chosen = []
    while at:
        chosen.append(int(came[at]))
        at -= chosen[-1]
    return chosen


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations of few sizes, largest size first, and how often each is used."""
    left = {s: n for s, n in counts.items() if n}
    out = []
    while left:
        sizes = sorted(left, reverse=True)
        head = sizes[0]
        left[head] -= 1
        items = [head, *fullest(sizes, left, capacity - head)]
        left[head] += 1
        times = min(left[s] // items.count(s) for s in set(items))
        out.append((items, times))
        for s in set(items):
            left[s] -= times * items.count(s)
            if not left[s]:
                del left[s]
    return out


def substitute(plans, members: dict[int, list[int]], counts: dict[int, int]):
    """Puts the actual lengths of each group where its rounded size stands."""
    queue = {size: [[length, counts[length]] for length in group] for size, group in members.items()}
    out = []
    for items, times in plans:
        while times:
            taken: dict[int, int] = defaultdict(int)
            actual = []
            for size in items:
                row = next(r for r in queue[size] if r[1] > taken[r[0]])
                taken[row[0]] += 1
                actual.append(row[0])
            now = min([times] + [r[1] // taken[r[0]] for s in set(items) for r in queue[s] if taken[r[0]]])
            for s in set(items):
                for r in queue[s]:
                    r[1] -= now * taken[r[0]]
                queue[s] = [r for r in queue[s] if r[1]]
            out.append((actual, now))
            times -= now
    return out


def best_fit(bins, small: dict[int, int], capacity: int):
    """Small lengths, largest first, each into the fullest bins that still take it."""
    by_room: dict[int, list] = defaultdict(list)
    for items, times in bins:
        by_room[capacity - sum(items)].append((items, times))
    for size in sorted(small, reverse=True):
        todo = small[size]
        while todo:
            room = next((r for r in range(size, capacity + 1) if by_room.get(r)), None)
            if room is None:
                each = capacity // size
                if todo >= each:
                    by_room[capacity - each * size].append(([size] * each, todo // each))
                    todo %= each
                if todo:
                    by_room[capacity - todo * size].append(([size] * todo, 1))
                break
            items, times = by_room[room].pop()
            now = min(times, todo)
            # A bin may take several of the size at once, as best-fit would do one by one.
            each = max(1, min(room // size, todo // now))
            if times > now:
                by_room[room].append((items, times - now))
            by_room[room - each * size].append((items + [size] * each, now))
            todo -= now * each
    return [b for group in by_room.values() for b in group]


def solve(counts: dict[int, int], capacity: int = CAPACITY, groups=GROUPS) -> list[tuple[list[int], int]]:
    """Kinds of sequences (the lengths in them) and how many of each."""
    small = {s: n for s, n in counts.items() if s * SMALL_PART <= capacity}
    large = {s: n for s, n in counts.items() if s * SMALL_PART > capacity}
    best = None
    for number in groups:
        members = {g[0]: g for g in linear_groups(large, number)}
        rounded = {top: sum(large[s] for s in g) for top, g in members.items()}
        bins = substitute(configurations(rounded, capacity), members, large)
        bins = best_fit(bins, small, capacity)
        if best is None or sum(n for _, n in bins) < sum(n for _, n in best):
            best = bins
    return best or []


def places(bins) -> tuple[np.ndarray, ...]:
    """For ranges of ranks of a length: the first rank, its sequence and the offset there."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for items, times in bins:
        offset = 0
        for size in items:
            rows.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def seat(table):
    def look_up(batches):
        size, first, sequence, offset = table.value
        keys = (size << 48) | first
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                [*names, "sequence_id", "offset"],
            )

    return look_up


def pack(
    documents: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    ``ids`` holds the token ids of the piece if ``with_ids``, else null.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    body = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>"
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = store(
        documents.select("doc_id", "text")
        .mapInArrow(tokenise(capacity, tokenizer, with_ids), body)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))),
        "pieces",
    )
    shares = store(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "shares")
    # At most ``capacity`` rows come to the driver.
    counts = {r.length: r.n for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(solve(counts, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(
        shares.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")),
        "bases",
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("local", F.row_number().over(order)).join(bases, ["length", "salt"])
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids",
        (F.col("base") + F.col("local") - 1).alias("rank"),
    ).mapInArrow(seat(table), f"{body}, sequence_id long, offset long")


