import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeworks.llm.quality_crf import chain, fit, keep_good, line_features, score_documents, train


def test_chain_equals_enumeration():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 3, 3, 4, 9])
    evidence, transition = rng.normal(size=9), rng.normal(size=(2, 2))
    good, pairs, _ = chain(evidence, transition, bounds)
    want, want_pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in itertools.pairwise(bounds):
        weights = {}
        for path in itertools.product((0, 1), repeat=b - a):
            energy = sum(e * y for e, y in zip(evidence[a:b], path, strict=True))
            weights[path] = np.exp(energy + sum(transition[p] for p in itertools.pairwise(path)))
        total = sum(weights.values())
        for path, w in weights.items():
            for i, y in enumerate(path):
                want[a + i] += y * w / total
            for p in itertools.pairwise(path):
                want_pairs[p] += w / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_lines_and_neighbours():
    texts = pa.array(["One two two\n\nTHREE!!", None, "", "a\n", "é"])
    features, lengths, bounds = line_features(texts)
    assert bounds.tolist() == [0, 3, 3, 3, 4, 5] and lengths.tolist() == [12, 1, 7, 2, 2]
    assert np.allclose(features[1, 9:18], features[0, :9]) and np.allclose(features[1, 18:27], features[2, :9])
    assert not features[0, 9:18].any() and not features[2, 18:27].any() and not features[3, 18:27].any()
    assert features[1, 8] == 1 and abs(features[0, 5] - 1 / 3) < 1e-9


def test_held_out_accuracy_on_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from lodeworks.llm.queries import QUERIES

    got = QUERIES["op8_quality_classifier"](spark, sf).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) >= 0.97
    # Labels of the held-out fold have no say.
    turned = labels.withColumn(
        "quality",
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality"))
        .otherwise(F.col("quality")),
    )
    one, two = train(docs, labels), train(docs, turned)
    assert np.array_equal(one.weights, two.weights) and one.slope == two.slope


def test_defined_cases(spark):
    rows = [(1, "good words here"), (None, None), (2, ""), (2, ""), (3, "w " * 100000), (4, "\n" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = train(docs, none)
    assert [r.score for r in score_documents(docs, model).select("score").collect()] == [0.5] * 6
    assert score_documents(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (3, None), (4, 7), (None, 1)], "doc_id long, quality int")
    assert np.array_equal(train(docs, odd).weights, model.weights)
    assert keep_good(docs, model, 0.4).columns == ["doc_id", "text", "score"]
    assert keep_good(docs, model).count() == 0


def test_fit_separates():
    texts = pa.array(["plain words of prose\nand more of it"] * 20 + ["BAD!! BAD!! BAD!!\nNO!! NO!!"] * 20)
    features, lengths, bounds = line_features(texts)
    model = fit(features, lengths, bounds, np.repeat([1.0, 0.0], 20))
    assert (model.score(texts) >= 0.7).tolist() == [True] * 20 + [False] * 20
