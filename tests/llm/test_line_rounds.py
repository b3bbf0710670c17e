import random

import numpy as np
import pyarrow as pa
from test_line_dedup import edit, normal

from lodeworks.llm.common import Steps
from lodeworks.llm.line_dedup import (
    MARKED,
    by_length,
    gram_counts,
    letters_apart,
    line_letters,
    line_groups,
    line_table,
    open_pair,
    similar_pairs,
    tile_links,
    within_each,
)


def changed(rng, line, n, letters):
    line = list(line)
    for _ in range(n):
        i = rng.randrange(len(line) + 1)
        line[i : i + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
    return "".join(line)


def test_pairs_compared_at_once_equal_the_distance():
    rng = random.Random(9)
    left, right, most = [], [], []
    for size in [1, 3, 20, 90, 300] * 60:
        a = "".join(rng.choices("abcdé ", k=rng.randrange(1, size + 1)))
        left.append(a)
        right.append(changed(rng, a, rng.randrange(2 + size // 6), "abé"))
        most.append(rng.randrange(2 + size // 8))
    want = [edit(a, b) <= k for a, b, k in zip(left, right, most, strict=True)]
    sides = [[x.encode("latin-1") for x in side] for side in (left, right)]
    assert within_each(*sides, np.array(most)).tolist() == want and 60 < sum(want) < 280


def test_pairs_of_any_script_and_length_are_decided():
    long = "ab cd efg " * 700
    pairs = [("x" * 40, "x" * 38 + "yz"), ("語" * 20, "語" * 18 + "学学"), (long, long[:-400]), (long, "q" * 900 + long[900:]), ("", "")]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5)), pa.array(range(5)), *(pa.array([p[i] for p in pairs]) for i in (0, 1))], ["a", "b", "la", "lb"]
    )
    assert pa.Table.from_batches(similar_pairs([batch])).column("a").to_pylist() == [0, 1, 2, 4]


def test_counts_of_neighbouring_letters_bound_the_edits_from_below():
    rng = random.Random(5)
    lines = ["".join(rng.choices("abcéü7 語", k=rng.randrange(1, 59))) + "a" for _ in range(60)]
    words, _, _, spoken, _ = line_table(pa.array(lines))
    marks = gram_counts(*line_letters(words, spoken))
    i, j = (x.ravel() for x in np.meshgrid(range(60), range(60)))
    bound = (letters_apart(marks[i], marks[j], 2) + 1) // 2
    assert all(b <= edit(normal(lines[x]), normal(lines[y])) for b, x, y in zip(bound, i, j, strict=True))
    assert bound.max() > 6
    entries = np.zeros(2, MARKED)
    entries["size"], entries["grams"] = 40, [0, 2**64 - 1]
    assert not open_pair(entries[:1], entries[1:])[0] and open_pair(entries[:1], entries[:1])[0]


def test_alike_lines_of_a_large_bucket_keep_a_common_bucket():
    entries = np.zeros(300, MARKED)
    entries["bucket"], entries["id"], entries["size"] = 5, np.arange(300), np.arange(1, 301)
    bucket, cut = by_length(entries)
    met = {}
    for b, i in zip(bucket.tolist(), cut["id"].tolist(), strict=True):
        met.setdefault(i, set()).add(b)
    for x in range(300):
        for y in range(x, 300):
            if 10 * (y - x) <= y + 1:
                assert met[x] & met[y]
    assert max(np.unique(bucket, return_counts=True)[1]) < 80


def test_most_alike_partners_come_first(spark):
    """Of a chain each line meets its neighbour first; then no pair is open."""
    pairs = [(a, b, b - a) for b in range(30) for a in range(b)]
    seen = []

    def alike(df):
        seen.append(df.count())
        return df.where("b - a <= 3")

    near = spark.createDataFrame(pairs, "a long, b long, unlike int")
    links, groups = line_groups(near, None, alike, Steps())
    assert seen[0] == 29 and sum(seen) == 29 and {r.component for r in groups.collect()} == {0}
    assert {(r.a, r.b) for r in links.collect()} == {(i, i + 1) for i in range(29)}


def test_links_of_a_tile_join_all_components_and_leave_pairs_of_earlier_buckets():
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefgh", k=120))
    lines = [base[:i] + "x" * 6 + base[i + 6 :] for i in range(0, 114, 6)] + ["".join(rng.choices("abcdefgh", k=120)) for _ in range(5)]
    n = len(lines)

    def tile(buckets):
        return pa.table(
            {"id": pa.array(range(n), pa.int64()), "size": [120] * n, "sketch": [0] * n, "grams": [0] * n, "c": list(range(n)),
             "side": pa.array([0] * n, pa.int32()), "apart": [False] * n, "bucket": [7] * n, "buckets": buckets, "line": lines}
        )

    links = tile_links(tile([[7]] * n)).to_pylist()
    parent = list(range(n))
    for r in links:
        assert edit(lines[r["a"]], lines[r["b"]]) <= 12
        low, high = sorted((parent[r["a"]], parent[r["b"]]))
        parent = [low if p == high else p for p in parent]
    assert parent == [0] * 19 + list(range(19, 24)) and len(links) < 60
    assert tile_links(tile([[3, 7]] * n)).num_rows == 0
    assert tile_links(tile([[3, 7], [4, 7], *[[7]] * (n - 2)])).num_rows >= 18
