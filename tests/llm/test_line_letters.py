import random

import numpy as np
import pyarrow as pa
from test_line_dedup import edit, normal

from lodeworks.llm.common import Steps, text_slices
from lodeworks.llm.line_dedup import (
    bucket_entries,
    bucket_reader,
    letter_counts,
    letters_apart,
    line_table,
    pair_links,
)


def counts(lines):
    words, _, _, spoken, _ = line_table(pa.array(lines))
    return letter_counts(words, spoken)


def test_letter_counts_bound_the_edits_from_below():
    rng = random.Random(5)
    lines = ["".join(rng.choices("abcéü7 語", k=rng.randrange(1, 70))) + "a" for _ in range(60)]
    marks = counts(lines)
    i, j = (x.ravel() for x in np.meshgrid(range(60), range(60)))
    bound = letters_apart(marks[i], marks[j])
    assert all(b <= edit(normal(lines[x]), normal(lines[y])) for b, x, y in zip(bound, i, j, strict=True))
    assert bound.max() > 6


def test_short_lines_of_one_bucket_with_other_letters_give_no_pair():
    texts = ["the quick brown fox jumps over the lazy dog by day", "the quick brown fox jumps over my sleepy old cat now",
             "the quick brown fox jumps over the lazy dog by bay"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    packed = list(bucket_entries(1, False)([batch]))
    found = pa.Table.from_batches(list(bucket_reader(128)(packed))).to_pylist()
    marks = dict(zip(counts(texts).tolist(), texts, strict=True))
    assert len(found) == 1 and len(marks) == 3


def test_copies_of_one_line_are_compared_once_each(spark):
    """All pairs of 20 alike lines: 19 comparisons, not 190; pairs the first partners leave open follow."""
    pairs = [(a, b) for b in range(20) for a in range(b)] + [(30, 32), (31, 32), (30, 31)]
    seen = []

    def alike(df):
        seen.append(df.count())
        return df.where("not (a = 30 and b = 32)")

    links = pair_links(spark.createDataFrame(pairs, "a long, b long"), alike, Steps())
    got = {tuple(r) for r in links.collect()}
    assert seen == [21, 1]
    assert {b for a, b in got if a < 20} == set(range(1, 20)) and (30, 31) in got and (31, 32) in got


def test_slices_hold_a_megabyte():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 4000)], ["text"])
    assert max(p.num_rows for p in text_slices([batch])) * 1000 <= 1 << 20
