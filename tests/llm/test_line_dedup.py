import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.llm.line_dedup import (
    drop_repeated_lines,
    ENTRY,
    line_keys,
    line_table,
    near_pairs,
    remove_repeated_lines,
    sketches,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(line):
    line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return " ".join(WORD.findall(line))


def edit(a, b):
    """Edit distance, a column of the table at a time in the bits of whole numbers."""
    if not a or not b:
        return len(a) + len(b)
    at = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
    return score


def test_edit_distance_of_the_tests():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(2))
        assert edit(a, b) == table(a, b)


def brute(docs):
    first, places = {}, []
    for doc, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            n = normal(line)
            if n:
                places.append((doc, i, n))
                first[n] = min(first.get(n, (doc, i)), (doc, i))
    names = list(first)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            most = int(max(len(a), len(b)) * 0.1)
            if abs(len(a) - len(b)) <= most and edit(a, b) <= most:
                parent[find(a)] = find(b)
    keeper = {}
    for n in names:
        keeper[find(n)] = min(keeper.get(find(n), first[n]), first[n])
    gone = {(d, i) for d, i, n in places if keeper[find(n)] != (d, i)}
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [x for i, x in enumerate(own) if (doc, i) not in gone]
        out.append((doc, len(own) - (own[-1] == ""), len(own) - len(kept), "\n".join(kept)))
    return sorted(out), len(gone)


def documents():
    rng = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    lines = [" ".join(rng.choices(words, k=rng.choice([2, 8, 30, 120, 300]))) for _ in range(25)]
    pool = list(lines)
    for line in lines:
        for _ in range(4):
            near = line.split(" ")
            near[rng.randrange(len(near))] = rng.choice(words)
            pool.append(" ".join(near))
        pool += [line.upper(), line.replace(" ", ", ") + "!", line + " 7", line + " 8"]
    docs = ["\n".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(40)]
    docs += ["", None, "\n\n!!\n", "same\nsame\nother\n", "same\n", "é ü\né ü"]
    return list(enumerate(docs))


@pytest.mark.parametrize("small_bucket", [128, 3])
def test_removed_lines_equal_brute_force(spark, small_bucket):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = remove_repeated_lines(df, small_bucket).select("doc.doc_id", "n_lines", "n_removed", F.coalesce("kept", F.lit("")))
    want, gone = brute(docs)
    assert sorted(tuple(r) for r in got.collect()) == want and gone > 100


def test_keys_and_sketches_of_lines():
    line = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(1000))
    words, _, _, spoken, _ = line_table(pa.array(["", "!!", line, line.upper() + " !", "one", line + " x"]))
    keys, marks = line_keys(words, spoken).tolist(), sketches(words, spoken).tolist()
    assert keys[0] == keys[1] and len(set(keys)) == 3
    assert marks[0] == marks[1] and bin(marks[0] ^ marks[3]).count("1") <= 3


def test_near_pairs_of_a_bucket_go_by_length_and_sketch():
    entries = np.array(
        [(1, 5, 100, 0), (1, 3, 100, 2**63 | 3), (1, 9, 100, 2**64 - 1), (1, 7, 80, 0), (2, 8, 100, 0), (3, 1, 30, 0), (3, 2, 30, 2**64 - 1)],
        ENTRY,
    )
    left, right = near_pairs(entries)
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == [(1, 2), (3, 5)]


def test_lines_that_differ_in_figures_stay_unless_asked(spark):
    docs = [(1, "Revenue 2019: 10 of 55"), (2, "Revenue 2020: 35 of 18")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.n_removed for r in remove_repeated_lines(df).collect()] == [0, 0]
    assert sorted(r.n_removed for r in remove_repeated_lines(df, fold_digits=True).collect()) == [0, 1]


def test_defined_cases(spark):
    rows = [(1, "a b\nc d"), (1, "a b\nc d"), (None, "a b"), (2, "c d"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit("x"))
    got = drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "lines"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(1, "a b\nc d"), (1, "a b\nc d"), (None, "a b"), (3, None), (4, "")], key=repr
    )
    assert drop_repeated_lines(docs.limit(0)).count() == 0
