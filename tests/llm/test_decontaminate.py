import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodeworks.llm.decontaminate import decontaminate, mark_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, ids = set(), set()
        for item_id, item in items:
            iw = WORD.findall(lower(item))
            size = min(window, len(iw))
            for s in range(len(iw) - size + 1) if size else ():
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == iw[s : s + size]:
                        hit.update(range(p, p + size))
                        ids.add(str(item_id) if item_id is not None else "")
        out.append((doc_id, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEM = " ".join(f"w{i}" for i in range(20))
DOCS = [
    (1, "start " + ITEM + " end"),
    (2, " ".join(f"W{i}" for i in range(3, 16)) + "! tail"),
    (3, " ".join(f"w{i}" for i in range(12))),
    (4, None),
    (5, ""),
    (6, "Short item here, short ITEM again"),
    (7, ("filler " * 5000) + "short item " + ("x " * 3000)),
    (8, "a a a a a a a a a a a a a a a a a"),
    (8, "a a a a a a a a a a a a a a a a a"),
    (9, "ünïcode 漢字 w1"),
]
ITEMS = [(10, ITEM), (11, "short item"), (12, "a " * 13), (12, "a " * 13), (13, None), (14, "!"),
         (None, "漢字"), (15, "w5 " + " ".join(f"w{i}" for i in range(6, 19)) + " other")]


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_marks_equal_brute_force(spark, block_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("n_hit", F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = mark_documents(docs, items, block_bytes=block_bytes).select(
        "doc.doc_id", "n_words", "n_hit", "items", "contaminated"
    )
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(DOCS, ITEMS)


def test_longest_matches_and_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("runs", F.lit(1))
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    first = mark_documents(docs, items).where("doc.doc_id = 1").first()
    assert [tuple(m) for m in first.matches] == [("10", 0, 1, 20)]
    kept = decontaminate(docs, items)
    assert kept.columns == ["doc_id", "text", "runs"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 8, 9]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert mark_documents(docs.limit(0), items).count() == 0
    none = mark_documents(docs, items.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(DOCS)


def test_query_equals_brute_force(spark, tmp_path):
    from lodeworks.llm.queries import QUERIES

    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op4_benchmark_decontamination"](spark, str(tmp_path))
    want = [
        (d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c)
        for d, n, h, i, c in brute(DOCS, ITEMS)
    ]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
