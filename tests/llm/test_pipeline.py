import test_decontaminate
import test_line_dedup
import test_minhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodeworks.llm.quality_crf import score_documents, train

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_every_stage_equals_brute_force_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, out)
        if name != "best_fit_packing":
            assert out.columns == columns
        docs = out
    given, kept = seen["quality_classifier"]
    scores = score_documents(given, train(given, spark.read.parquet(f"{SF}/labels.parquet")))
    good = {r.doc_id for r in scores.where("score >= 0.7").select("doc.doc_id").collect()}
    assert {d for d, _ in rows(kept)} == good and 0 < len(good) < given.count()
    given, kept = seen["line_dedup"]
    want, gone = test_line_dedup.brute(rows(given))
    assert sorted(rows(kept)) == sorted((d, t) for d, _, n, t in want if n == 0 or t) and gone > 0
    assert kept.where(F.length("text") != F.col("n_chars")).count() == 0
    given, kept = seen["minhash_near_dedup"]
    assert sorted(d for d, _ in rows(kept)) == sorted(d for d, _, _, k in test_minhash.brute(rows(given)) if k)
    given, kept = seen["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    marked = test_decontaminate.brute(rows(given), items)
    assert sorted(d for d, _ in rows(kept)) == sorted(m[0] for m in marked if not m[4])
    given, packed = seen["best_fit_packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in rows(given)}


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
