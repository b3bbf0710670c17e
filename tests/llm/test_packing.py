import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeworks.llm.packing import linear_groups, pack, solve


def json_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def documents():
    rng = random.Random(2)
    parts = ["the ", "eau", "ção", "\n\n", "  ", "don't", "12345", "<|endoftext|>", "  <|endoftext|>", "<|im_end|>", "漢字", " ", "!!"]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 5, 60, 400, 3000]))) for _ in range(60)]
    return [(i, t) for i, t in enumerate([*texts, "", None, "x" * 30000, "same", "same"])]


def test_pieces_and_sequences(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("offset", F.lit(1))
    rows = pack(df.repartition(3), with_ids=True).collect()
    ids = dict(zip([d for d, _ in docs], json_ids([t or "" for _, t in docs]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        body = np.array(r.ids, dtype="<u4")
        assert zlib.crc32(body.tobytes()) == r.ids_crc32 and len(body) == r.length
    for doc, want in ids.items():
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert sum((r.ids for r in got), []) == want
        assert all(r.length == 1024 for r in got[1:])
        assert [r.start for r in got] == [sum(q.length for q in got[:i]) for i in range(len(got))]
    for got in by_sequence.values():
        end = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
    tokens = sum(map(len, ids.values()))
    assert len(by_sequence) <= -(-tokens // 1024) * 1.1 + 1


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_solution_uses_every_piece_and_is_near_the_bound():
    rng = random.Random(4)
    for scale in (1, 50):
        lengths = [min(1024, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(4000)]
        counts = {k: n * scale for k, n in Counter(lengths).items()}
        bins = solve(counts)
        used = Counter()
        for items, times in bins:
            assert sum(items) <= 1024
            for size in items:
                used[size] += times
        assert used == Counter(counts)
        bound = sum(k * n for k, n in counts.items()) / 1024
        assert sum(n for _, n in bins) <= 1.01 * bound + 1
    assert sum(n for _, n in solve({600: 10, 424: 10})) == 10
    assert solve({}) == []


def test_groups_have_equal_cardinality():
    groups = linear_groups({i: 3 for i in range(65, 1025)}, 64)
    sizes = [3 * len(g) for g in groups]
    assert len(groups) == 64 and max(sizes) - min(sizes) == 0
