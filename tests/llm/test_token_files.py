import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeworks.llm import token_files as T
from lodeworks.session import run_dir


def json_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def brute(rows):
    """Documents by id, nulls first; ids of all documents before each."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (doc, _), ids in zip(order, json_ids([t for _, t in order]), strict=True):
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("block", [64, 1024])
def test_round_trip_equals_the_tokenizer(spark, block):
    rnd = random.Random(block)
    parts = ["the ", "eau", "ção", "\n\n", "  ", "don't", "!", "12345", "<|endoftext|>", " <|endoftext|>", "漢字", " ", "!!"]
    texts = ["".join(rnd.choices(parts, k=rnd.choice([0, 1, 5, 60, 400, 3000]))) for _ in range(120)]
    texts += ["", None, "!" * 5000, "ab " * 150_000, "same", "same"]
    rows = list(zip(rnd.sample(range(-500, 10**12), len(texts)), texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("start", F.lit("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = T.write_tokens(df, run_dir(spark, "t"), block=block)
        assert files.count() > 1
        assert got(T.read_tokens(files)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(3, "b"), (1, "a b"), (1, "a b"), (None, "c d e"), (2, None)]
    assert got(T.round_trip(spark.createDataFrame(rows, "doc_id int, text string"))) == brute(rows)
    assert T.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_blocks_of_any_values_come_back(seed):
    rng = np.random.default_rng(seed)
    top = [1, 2, 300, 50_257, 2**20, 2**32][seed]
    values = rng.integers(0, top, size=(9, [1, 7, 64, 1000, 1024, 65_535][seed]), dtype=np.uint64).astype(np.uint32)
    values[rng.random(values.shape) < 0.02] = 2**32 - 1
    values[3] = 7
    blocks = T.pack_blocks(values)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:-1]
    assert (T.unpack_blocks(b"".join(blocks), starts.tolist()) == values.ravel()).all()


def test_outliers_are_exceptions_and_do_not_widen_the_block():
    values = np.full((1, 1024), 1000, dtype=np.uint32)
    values[0, ::2] += 15
    values[0, 5::100] = 50_000
    block = T.pack_blocks(values)[0]
    low, count, exceptions, width = T.HEAD.unpack_from(block)
    assert (low, count, exceptions, width) == (1000, 1024, 11, 4)
    assert len(block) == T.HEAD.size + 1024 * 4 // 8 + 11 * 6


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_ranges_are_read_by_the_index_and_damage_is_found():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_257, size=n).astype(np.uint32) for n in (0, 1, 5000, 64, 3, 700_000)]
    file = Memory()
    writer = T.Writer(file, block=64)
    for number, ids in enumerate(docs):
        writer.add(number, ids)
    n, tokens, size = writer.close()
    assert (n, tokens, size) == (6, sum(map(len, docs)), file.size())
    reader = T.Reader(file)
    whole = np.concatenate(docs)
    for a, b in [(0, 0), (0, 1), (63, 65), (64, 128), (4990, 5100), (tokens - 1, tokens), (0, tokens)]:
        assert (reader.read(a, b) == whole[a:b]).all()
    data = bytearray(file.getvalue())
    data[-T.TRAILER.size - 3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        T.Reader(Memory(bytes(data)))
