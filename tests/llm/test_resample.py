import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodeworks.llm.resample import collapsed, features, resample, runs

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").encode().translate(LOWER))


def grams(text, longest):
    ws = words(text)
    return [b" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, longest, buckets, min_words, percent):
    def tally(texts):
        out = [0] * buckets
        for text in texts:
            for g in grams(text, longest):
                out[zlib.crc32(g) % buckets] += 1
        return out

    s, t = tally([x for _, x in docs]), tally(target)
    gain = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets))))
        for a, b in zip(s, t, strict=True)
    ]
    rows = []
    for doc, text in docs:
        found = [gain[zlib.crc32(g) % buckets] for g in grams(text, longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(words(text)), len(found), weight, score))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    ranks = {}
    for place, r in enumerate(drawn, 1):
        ranks.setdefault(r, []).append(place)
    return sorted(((r[0], *r[2:], ranks[r].pop() if ranks.get(r) else None) for r in rows), key=str)


def made_up():
    rnd = random.Random(8)
    vocabulary = ["the", "The", "Übung", "x1", "漢字", "don't", "--", "a\x00b", "code", "data\n", "42"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 3, 19, 20, 21, 90]))) for _ in range(120)]
    texts += ["", None, " \n..", "w " * 20_000, "same " * 25, "same " * 25]
    return [(i * 7 % 400, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 17, 55), (2, 1, 100), (1, 5, 0)])
def test_whole_result(spark, longest, buckets, percent):
    docs, target = made_up(), ["the data code 42", None, "", "漢字 x1 x1"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("rank", F.lit("x"))
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(df, items, longest=longest, buckets=buckets, percent=percent).collect()
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str)
    assert got == brute(docs, target, longest, buckets, 20, percent)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = [(1, "a b " * 20)] * 4 + [(None, "a b " * 20), (2, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    got = resample(df, none, percent=60).collect()
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str)
    assert got == brute(docs, [], 1, 10_000, 20, 60)
    assert resample(none, df).count() == 0


def test_spans_are_the_runs_of_whole_words():
    for size in (1, 2, 3):
        flat = collapsed("One  two,THREE\tdon't\n4")
        got = [m[0] for m in runs(size).finditer(flat, overlapped=True)]
        assert got == [g for g in grams("One  two,THREE\tdon't\n4", 3) if g.count(b" ") == size - 1]
    assert features(None, [runs(1)], 10)[0] == 0 and features("..", [runs(1)], 10)[0] == 0
