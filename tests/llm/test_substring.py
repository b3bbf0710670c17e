import random
import re

import pytest
from pyspark.sql import functions as F

from lodeworks.llm.substring import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def documents():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: rng.choices(vocabulary, k=n)
    passages = [text(n) for n in (49, 50, 51, 60, 75, 140)] + [["re"] * 90, ["a", "b"] * 60]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, 12)
            parts += text(rng.choice([0, 3, 30, 200])) + (p[cut:] if rng.random() < 0.5 else p)
        docs.append((" " if rng.random() < 0.5 else "\n\t").join(parts))
    docs += [docs[3], docs[3], docs[3] + "  ", " ".join(text(20000)), "", None, "short text", "short text"]
    docs.append("é " * 70)
    docs.append("é " * 52)
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("groups", [8, 40])
def test_removed_words_equal_brute_force(spark, groups):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        # Many groups without coalescing: runs of equal windows go on from group to group.
        spark.conf.set("spark.sql.shuffle.partitions", str(groups))
        spark.conf.set("spark.sql.adaptive.enabled", str(groups == 8).lower())
        got = remove_repeats(df).select("doc.doc_id", "n_words", "n_removed", "kept").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == brute(docs)


def test_hot_passage_spans_groups(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(i, f"{passage} own{i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = remove_repeats(df).select("doc.doc_id", "n_removed").collect()
    assert sorted(tuple(r) for r in got) == [(i, 50 if i else 0) for i in range(400)]


def test_defined_cases(spark):
    same = " ".join(f"x{i}" for i in range(55))
    rows = [(1, same), (1, same), (None, same), (2, same + " more"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x"))
    got = remove_repeats(docs)
    assert sorted(((r.doc.doc_id, r.n_words, r.n_removed) for r in got.collect()), key=repr) == sorted(
        [(1, 55, 0), (1, 55, 0), (None, 55, 0), (2, 56, 55), (3, 0, 0)], key=repr
    )
    assert remove_repeats(docs.limit(0)).count() == 0
