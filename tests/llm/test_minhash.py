import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeworks.llm.graph import components
from lodeworks.llm.minhash import (
    drop_near_duplicates,
    near_duplicates,
    shingle_sets,
    signatures,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and sets[a] and sets[b] and 100 * shared >= 75 * union:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def documents():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([6, 20, 90, 300]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append("\t".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    texts += ["", None, "one two", "One  two", "two one", "a", "a a a a a a a", "é" * 40 + " x y z w v"]
    texts.append(" ".join(rng.choices(vocabulary, k=30000)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[j]) for i, j in enumerate(order)]


def test_near_duplicates_equal_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = near_duplicates(df)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


def test_null_ids_repeated_rows_and_other_columns(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    kept = drop_near_duplicates(df.withColumn("component_id", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "1", "None"]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bins_agree_with_probability_of_the_similarity():
    rng = np.random.default_rng(1)
    words = [f"q{i}" for i in range(2000)]
    agree, true = [], []
    for _ in range(60):
        base = list(rng.choice(words, 60))
        other = list(base)
        other[int(rng.integers(60))] = "zz"
        texts = pa.array([" ".join(base), " ".join(other)])
        hashes, bounds = shingle_sets(texts)
        rows = signatures(hashes, bounds)
        agree.append((rows[0] == rows[1]).mean())
        a, b = (set(hashes[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 1))
        true.append(len(a & b) / len(a | b))
    assert abs(np.mean(agree) - np.mean(true)) < 0.02


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(tuple(r) for r in components(df).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
