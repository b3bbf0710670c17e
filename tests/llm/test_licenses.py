import re

from pyspark.sql import functions as F

from lodeworks.llm.licenses import scan
from lodeworks.llm.queries import LICENSES


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, templates):
    """Containment over windows of 2m words at every m-th word."""
    out = {}
    for doc, text in docs:
        w = words(text)
        h = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        for name, t in templates:
            tw = words(t)
            m, ts = len(tw), {tuple(tw[i : i + 3]) for i in range(len(tw) - 2)}
            for start in range(0, len(h), m) if m >= 3 else ():
                part = h[start : start + 2 * m - 2]
                share = len(ts & set(part)) / len(ts)
                if share >= 0.8:
                    first = start + min(i for i, s in enumerate(part) if s in ts)
                    out[doc, name, first] = max(share, out.get((doc, name, first), 0))
    return sorted((*k, v) for k, v in out.items())


def documents():
    filler = " ".join(f"word{i}" for i in range(90))
    docs = [(i, f"{' '.join(f'x{j}' for j in range(i))} {text} {filler}") for i, (_, text) in enumerate(LICENSES * 4)]
    docs += [
        (100, None), (101, ""), (102, "the MIT"), (103, "released\nUNDER the\tMIT license"),
        (104, "Released under the MIT License. " * 3), (105, filler * 60 + " licensed under CC BY-NC 4.0"),
        (106, LICENSES[5][1].replace("charge", "cost")), (107, LICENSES[5][1].replace("obtaining", "who gets")),
    ]
    return docs


def test_matches_equal_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start_word", F.lit("x"))
    templates = spark.createDataFrame([*LICENSES, LICENSES[0], ("tiny", "a b"), ("none", None)], "license string, text string")
    got = scan(df.repartition(3), templates)
    want = brute(docs, LICENSES)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) >= 28
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    templates = spark.createDataFrame(LICENSES, "license string, text string")
    assert scan(docs.limit(0), templates).count() == 0 and scan(docs, templates.limit(0)).count() == 0


def test_no_short_notice_is_missed(spark):
    notice = "'p' || id, 'q' || id, 'r' || id, 's' || id, 't' || id"
    around = f"'a' || id, 'b' || id, {notice}, 'c' || id, 'd' || id, 'e' || id"
    ids = spark.range(8_000)
    templates = ids.selectExpr("cast(id as string) license", f"concat_ws(' ', {notice}) text")
    got = scan(ids.selectExpr("id doc_id", f"concat_ws(' ', {around}) text"), templates)
    assert got.where("license = doc_id and start_word = 2 and containment = 1").count() == 8_000
