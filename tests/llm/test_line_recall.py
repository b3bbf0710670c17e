import random

import numpy as np
import pyarrow as pa
from test_line_dedup import edit, normal

from lodeworks.llm.line_dedup import lengths, line_table, meeting_keys, remove_repeated_lines

WORDS = [f"{a}{b}{c}{d}" for a in "kmprst" for b in ("a", "ei", "o", "uri") for c in "lnvd" for d in ("", "er", "ing")]


def with_word(rng, line):
    near = line.split(" ")
    near[rng.randrange(len(near))] = rng.choice(WORDS)
    return " ".join(near)


def with_edits(rng, line, n):
    for _ in range(n):
        i = rng.randrange(len(line))
        line = line[:i] + rng.choice(["", "x", "xy"]) + line[i + 1 :]
    return line


def buckets(lines):
    words, _, _, spoken, _ = line_table(pa.array(lines))
    size = lengths(words, spoken)
    assert size.tolist() == [len(normal(x)) for x in lines]
    return [set(k) for k in meeting_keys(words, spoken, size).to_pylist()]


def test_near_lines_meet_by_edit_similarity_alone():
    rng = random.Random(3)
    for size, share in ((2, 1.0), (5, 0.9), (10, 0.95), (20, 0.98), (32, 0.98), (100, 0.98)):
        pairs = []
        while len(pairs) < 150:
            a = " ".join(rng.choices(WORDS, k=size))
            b = with_word(rng, a) if rng.random() < 0.6 else with_edits(rng, a, max(1, len(a) // 25))
            x, y = normal(a), normal(b)
            if x != y and edit(x, y) <= max(len(x), len(y)) // 10:
                pairs.append((a, b))
        met = buckets([x for p in pairs for x in p])
        assert np.mean([bool(met[i] & met[i + 1]) for i in range(0, len(met), 2)]) >= share, size


def test_lines_with_one_replaced_word_go(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choices(WORDS, k=rng.choice([20, 32, 50]))) for _ in range(60)]
    docs = [(i, x) for i, x in enumerate(lines + [with_word(rng, x) for x in lines])]
    docs += [(200, "contact us now"), (201, "contact us nov"), (202, "Écrire à Zoé"), (203, "écrire à zoë"), (204, "Écrire a Zoé")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = remove_repeated_lines(df).where("n_removed > 0").select("doc.doc_id").collect()
    gone = {r.doc_id for r in rows}
    assert len([d for d in gone if 60 <= d < 120]) >= 59 and not [d for d in gone if d < 60]
    assert 201 in gone and 200 not in gone
