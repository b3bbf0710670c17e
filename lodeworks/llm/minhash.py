"""Near-duplicate documents: one-permutation MinHash, densified, in banded buckets.

A document's set is its distinct 5-word shingles (lower-cased in A-Z; with fewer words, the
whole sequence). Equal sets are folded into classes first. One sorted pass over a text's
shingle hashes gives the minimum of each of ``BANDS * ROWS`` bins; empty bins borrow from
full ones by a fixed random probe per bin (optimal densification), so that two sets agree
in a bin with probability J. With 56 bands of 5 rows a pair of J = 0.75 meets in no band
with probability (1 - 0.75^5)^56 = 3e-7.

1. *Stars.* Every bucket links a random hub to its members, so a bucket of n documents gives
   n - 1 candidate pairs, and a document in many buckets meets many hubs. Pairs whose 256
   four-bit minima agree too seldom for J = 0.75 (by more than five deviations) are left out,
   the others confirmed on the full sets.
2. *Bound.* Buckets whose members are in one component by now are done. For a document x in
   one of the others let c(x) be the number of its shingles that another such document
   has. A link of x and y needs 175 * min(c(x), c(y)) >= 75 * (|x| + |y|): documents that no
   size in their bucket can satisfy have no link left to find.
3. *Blocks.* The few documents that remain are compared in blocks of bounded size, by their
   full sets, across components only; a block reports one link per pair of components.

So every pair that shares a bucket is confirmed, ruled out, or joined by a component already.

Defined cases: null or empty texts have no shingles and link with nothing; equal rows of one
id are one document; an id with several texts is one node, judged by the greatest of them; a
null id links with nothing and is kept; an empty table gives an empty result; other columns
of the input are not read by ``near_duplicates`` and pass through ``drop_near_duplicates``
unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import (
    gram_hashes,
    if_small,
    mix64,
    store,
    text_slices,
    words_of,
)
from lodeworks.llm.graph import components

SHINGLE = 5
BANDS = 56
ROWS = 5
BINS = BANDS * ROWS

# Four-bit minima of the first bins, 16 to a long. At J = 0.75 a bin agrees with probability
# 0.766 (one in 16 unequal minima agrees too); five deviations below lies the limit.
DIGEST_BINS = 256
AGREE_AT_LEAST = 162
# Documents and shingles of one side of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000

_PROBES = np.random.default_rng(11).integers(0, BINS, size=(4096, BINS))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the bounds of the texts."""
    words = words_of(column, lower=True)
    hashes, at = gram_hashes(words, SHINGLE)
    owner = words.owner[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(few):
        whole = np.zeros(len(few), dtype=np.uint64)
        for i in range(SHINGLE - 1):
            has = words.counts[few] > i
            place = np.where(has, words.bounds[few] + i, 0)
            whole += np.where(has, mix64(words.hashes[place] + np.uint64(i)), np.uint64(0))
        hashes = np.concatenate((hashes, mix64(whole + np.uint64(0x51ED27))))
        owner = np.concatenate((owner, few))
    texts = len(words.bounds) - 1
    if not len(hashes):
        return hashes, np.zeros(texts + 1, dtype=np.int64)
    # One sort key: the text, then the top bits of the hash (the sorted hash fits below).
    room = 64 - max(1, int(texts).bit_length())
    by = np.argsort((owner.astype(np.uint64) << np.uint64(room)) | (hashes >> np.uint64(64 - room)))
    hashes, owner = hashes[by], owner[by]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(texts + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``BINS`` minima per text; rows of empty sets are meaningless."""
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    slot = owner * BINS + bins.astype(np.int64)
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    full = np.zeros(texts * BINS, dtype=bool)
    value = np.zeros(texts * BINS, dtype=np.uint64)
    full[slot[first]] = True
    value[slot[first]] = hashes[first]
    table = value.copy()
    row, col = np.nonzero(~full.reshape(texts, BINS) & (np.diff(bounds) > 0)[:, None])
    probe = 0
    while len(row):
        donor = row * BINS + _PROBES[probe % len(_PROBES), col]
        lucky = full[donor]
        table[row[lucky] * BINS + col[lucky]] = value[donor[lucky]]
        row, col = row[~lucky], col[~lucky]
        probe += 1
    return table.reshape(texts, BINS)


def sketch(batches):
    for part in text_slices(batches):
        hashes, bounds = shingle_sets(part.column("text"))
        sizes = np.diff(bounds)
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
                for h in (hashes, mix64(hashes))]
        keys = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
        rows = signatures(hashes, bounds)
        nibbles = (rows[:, :DIGEST_BINS] >> np.uint64(7)) & np.uint64(15)
        shifts = np.arange(0, 64, 4, dtype=np.uint64)
        digest = (nibbles.reshape(len(rows), -1, 16) << shifts).sum(axis=2, dtype=np.uint64)
        longs = np.arange(0, (len(sizes) + 1) * digest.shape[1], digest.shape[1], dtype=np.int32)
        table = rows.reshape(-1, BANDS, ROWS)
        band = np.zeros(table.shape[:2], dtype=np.uint64)
        for i in range(ROWS):
            band = mix64(band * np.uint64(31) + table[:, :, i])
        band += np.arange(BANDS, dtype=np.uint64)
        flat = pa.array(mix64(band).view(np.int64).ravel())
        ends = np.arange(0, (len(sizes) + 1) * BANDS, BANDS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]),
             pa.ListArray.from_arrays(pa.array(ends), flat),
             pa.ListArray.from_arrays(pa.array(longs), pa.array(digest.view(np.int64).ravel()))],
            ["doc_id", "n_shingles", "k1", "k2", "bands", "digest"],
        )


def squeeze(batches):
    """Texts as compressed bytes: what is shuffled is a third of the size."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for part in text_slices(batches):
        texts = (t.encode() for t in part.column("text").fill_null("").to_pylist())
        packed = pa.array([pack(t) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("id"), packed], ["id", "packed"])


def unpacked_sets(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return shingle_sets(pa.array([unpack(p) for p in packed], pa.binary()))


def confirm(batches):
    """Pairs whose full sets have 100 * intersection >= 75 * union."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            sides = [part.column(c).to_pylist() for c in ("a", "b")]
            texts = dict(zip(sides[0], part.column("pa").to_pylist(), strict=True))
            texts |= zip(sides[1], part.column("pb").to_pylist(), strict=True)
            hashes, bounds = unpacked_sets(list(texts.values()))
            place = {id_: i for i, id_ in enumerate(texts)}
            sets = [hashes[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            keep = []
            for a, b in zip(*sides, strict=True):
                x, y = sets[place[a]], sets[place[b]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= 75 * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("a").filter(mask), part.column("b").filter(mask)], ["a", "b"]
            )


def shingle_rows(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            hashes, bounds = unpacked_sets(part.column("packed").to_pylist())
            ids = part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes.view(np.int64))], ["id", "shingle"])


def compare_blocks(batches):
    """Links between components among the documents of each block."""
    for batch in batches:
        found_a, found_b = [], []
        for docs, diagonal in zip(
            batch.column("docs").to_pylist(), batch.column("diagonal").to_pylist(), strict=True
        ):
            hashes, bounds = unpacked_sets([d["packed"] for d in docs])
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(docs)), sizes)
            _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
            number = np.cumsum(times > 1) - 1
            keep = times[column] > 1
            owner, column = owner[keep], number[column[keep]]
            by = np.argsort(column, kind="stable")
            owner, column = owner[by], column[by]
            shared = np.zeros((len(docs), len(docs)), dtype=np.float32)
            for low in range(0, int(number[-1]) + 1 if len(number) else 0, 8192):
                a, b = np.searchsorted(column, (low, low + 8192))
                dense = np.zeros((len(docs), 8192), dtype=np.float32)
                dense[owner[a:b], column[a:b] - low] = 1
                shared += dense @ dense.T
            c = np.array([d["c"] for d in docs])
            side = np.array([d["side"] for d in docs])
            link = 100 * shared >= 75 * (sizes[:, None] + sizes - shared)
            link &= c[:, None] < c
            if not diagonal:
                link &= side[:, None] != side
            x, y = np.nonzero(link)
            _, first = np.unique(np.column_stack((c[x], c[y])), axis=0, return_index=True)
            found_a += c[x[first]].tolist()
            found_b += c[y[first]].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"]
        )


def differing(a: str, b: str):
    """Four-bit minima in which two digests differ."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for i in range(DIGEST_BINS // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(ones))
    return total


def mixed_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with their component."""
    marked = members.join(groups, "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("c")
    )
    return several_components(store(marked, "marked"))


def several_components(marked: DataFrame) -> DataFrame:
    mixed = marked.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return store(marked.join(mixed.where("lo < hi"), "bucket", "left_semi"), "live")


def bounded(live: DataFrame, texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Drops from each bucket the documents that no member can be linked with."""
    ids = live.select("id").distinct()
    rows = store(
        texts.join(ids, "id", "left_semi").mapInArrow(shingle_rows, "id long, shingle long"),
        "shingles",
    )
    common = store(
        rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"),
        "common",
    )
    held = rows.join(common, "shingle").groupBy("id").agg(F.count("*").alias("held"))
    marked = store(live.join(store(held.join(sizes, "id"), "held"), "id"), "counted")
    least = marked.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
    n = F.col("n_shingles")
    partner = F.greatest(F.col("least"), F.ceil(n * 0.75))
    kept = marked.join(least, "bucket").where(175 * F.col("held") >= 75 * (n + partner))
    return several_components(store(kept.select("bucket", "id", "c"), "kept"))


def block_links(live: DataFrame, texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the components of ``live`` (ids of components)."""
    hubs = store(live.groupBy("bucket").agg(F.min("id").alias("a")), "hubs")
    near = components(live.join(hubs, "bucket").select("a", F.col("id").alias("b")))
    docs = store(
        near.withColumnRenamed("component", "g")
        .join(live.select("id", "c").distinct(), "id")
        .join(sizes, "id"),
        "grouped",
    )
    chunks = store(
        docs.groupBy("g").agg(
            F.ceil(
                F.greatest(
                    F.count("*") / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES, F.lit(1.0)
                )
            ).cast("int").alias("k")
        ),
        "chunks",
    )
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    dealt = (
        docs.join(chunks, "g")
        .withColumn("side", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select(
            "id", "g", "c", "side",
            F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
        )
    )
    blocks = (
        dealt.join(texts, "id")
        .groupBy("g", "i", "j")
        .agg(F.collect_list(F.struct("c", "side", "packed")).alias("docs"))
        .select("docs", (F.col("i") == F.col("j")).alias("diagonal"))
    )
    return store(blocks.mapInArrow(compare_blocks, "a long, b long").distinct(), "links")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``doc_id, text``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = store(
        docs.mapInArrow(
            sketch,
            "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, digest array<long>",
        ),
        "sketches",
    )
    classes = store(
        sketches.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "bands", "digest")).alias("x"))
        .select("k1", "k2", "n_shingles", F.col("x.doc_id").alias("id"), "x.bands", "x.digest"),
        "classes",
    )
    sizes = classes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    members = classes.select(F.explode("bands").alias("bucket"), "id")
    hubs = members.groupBy("bucket").agg(
        F.min(F.struct(F.xxhash64("bucket", "id").alias("h"), "id")).alias("x"),
        (F.min("id") < F.max("id")).alias("shared"),
    )
    hubs = store(hubs.where("shared").select("bucket", F.col("x.id").alias("a")), "hubs")
    members = store(members.join(hubs, "bucket"), "members")
    pairs = (
        members.where("a <> id")
        .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
        .distinct()
    )
    digests = classes.groupBy("id").agg(F.max("digest").alias("digest"))
    left = digests.select(F.col("id").alias("a"), F.col("digest").alias("da"))
    right = digests.select(F.col("id").alias("b"), F.col("digest").alias("db"))
    likely = store(
        pairs.join(left, "a").join(right, "b")
        .where(differing("da", "db") <= DIGEST_BINS - AGREE_AT_LEAST).select("a", "b"),
        "likely",
    )
    wanted = store(members.select("id").distinct(), "wanted")
    texts = store(
        docs.withColumnRenamed("doc_id", "id")
        .join(if_small(wanted), "id", "left_semi")
        .mapInArrow(squeeze, "id long, packed binary")
        .groupBy("id")
        .agg(F.max("packed").alias("packed")),
        "texts",
    )
    packed = [texts.select(F.col("id").alias(c), F.col("packed").alias(f"p{c}")) for c in "ab"]
    links = store(
        likely.join(packed[0], "a").join(packed[1], "b").mapInArrow(confirm, "a long, b long"),
        "links",
    )
    groups = components(links)
    live = mixed_buckets(members.select("bucket", "id"), groups)
    if not live.isEmpty():
        live = bounded(live, texts, sizes)
    if not live.isEmpty():
        # Stars of the components found so far stand for their links.
        stars = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
        groups = components(stars.unionByName(block_links(live, texts, sizes)))
    keys = ["k1", "k2", "n_shingles"]
    named = store(
        classes.join(groups, "id", "left").select(
            *keys, F.coalesce("component", "id").alias("component")
        ),
        "named",
    )
    component = F.coalesce("component", "doc_id")
    return sketches.drop("bands", "digest").join(named, keys, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents with the smallest id of their component; columns as they were."""
    verdicts = near_duplicates(documents.select("doc_id", "text"))
    dropped = verdicts.where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return documents.join(
        store(dropped, "dropped"), F.col("doc_id") == F.col("_dropped"), "left_anti"
    )
