import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.llm.merkle import fold, manifest
from lodeworks.llm.queries import tampered_text

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """The root and, per leaf, the runs' other nodes before and after it."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf_no, i in enumerate(at):
            first = i - i % fanout
            steps[leaf_no].append((nodes[first:i], nodes[i + 1 : first + fanout]))
        at = [i // fanout for i in at]
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], steps


def brute(rows, fanout):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    parts = {s: tree([leaf(r) for r in sources[s]], fanout) for s in order}
    root, upper = tree([parts[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, upper, strict=True):
        for row, inner in zip(sources[s], parts[s][1], strict=True):
            steps = inner + top
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            node = leaf((*row[:4], row[4].translate(lower))) if hit else leaf(row)
            for before, after in steps:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join(x for b, a in steps for x in b + a))
            out.append((row[0], leaf(row), parts[s][0], root, proof, node, node == root))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("position", F.lit("x"))
    got = manifest(df, tampered_text(), **kw).drop("steps")
    return Counter(tuple(r) for r in got.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("fanout, levels", [(2, 1), (3, 1), (3, 2), (16, 3)])
def test_whole_table(spark, fanout, levels):
    rnd = random.Random(fanout * 10 + levels)
    sizes = {"hot": 61, None: 17, "a": 1, "b": 2, "é": 16, "Z": 9, "=": 3, "": 4, **{f"s{i}": 1 for i in range(9)}}
    ids = rnd.sample(range(10_000), sum(sizes.values()))
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rnd.choice([None, "", "AbÉ 漢", "lower", "X" * 50_000, "Some Words " * 9])
            rows.append((ids.pop(), source, rnd.choice(["en", None]), rnd.choice([None, 7]), text))
    assert run(spark, rows, fanout=fanout, levels=levels) == Counter(brute(rows, fanout))


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a", "en", 3, "Abc")] * 5 + [(1, "a", "en", 3, "Abd"), (None, "a", None, None, None), (None, None, None, 1, "x")]
    assert run(spark, rows, fanout=2, levels=1) == Counter(brute(rows, 2))
    assert run(spark, rows[:1]) == Counter(brute(rows[:1], 16))
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_steps_fold_to_the_root_and_a_change_does_not(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(40)]
    got = manifest(spark.createDataFrame(rows, SCHEMA), fanout=3, levels=1, with_steps=True).collect()
    assert len(got) == 40 and all(r.verified for r in got)
    for r in got:
        steps = [(s.before, s.after) for s in r.steps]
        assert fold(r.leaf, steps) == r.root != fold(sha("other"), steps)
