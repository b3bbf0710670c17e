"""Registered queries beside their SQL on rows that larger tables hold."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodeworks.functions import text as X
from lodeworks.functions.exprs import round_to
from lodeworks.operators import dedup as D
from lodeworks.operators import match as M
from lodeworks.plans import load_catalog


def differences(spark, folder, name, tables):
    """Rows of a query and of its SQL over the given tables that the other side lacks."""
    db = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    q = load_catalog()[name]
    df = q.build(spark, str(folder))
    cursor = db.execute(q.sql)
    names = [d[0] for d in cursor.description]
    want = {tuple(r) for r in cursor.fetchall()}
    got = {tuple(r) for r in df.select(*names).collect()}
    assert want
    return got ^ want


def test_filing_amounts_under_one(spark, tmp_path):
    balances = [0.3, 0.49, 0.5, 0.0, -0.2, 5000.4, 12.34]
    ids = list(range(len(balances)))
    tables = {
        "supplier": {"s_suppkey": ids, "s_name": [f"S{i}" for i in ids], "s_nationkey": [0] * len(ids), "s_acctbal": balances},
        "nation": {"n_nationkey": [0], "n_name": ["N"], "n_regionkey": [0]},
    }
    assert not differences(spark, tmp_path, "filing_flatten", tables)


def test_portfolio_lists_with_odd_blanks_and_null_texts(spark, tmp_path):
    texts = [None, "", "\n", "\tOne Two,\nThree Four", " One, Two Three　, x.", "Red\u000bSmall", "A\u0085, Bb Cc", "Big One Small\nBolt"]
    n = len(texts)
    tables = {
        "documents": {"doc_id": list(range(n)), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [len(t or "") for t in texts]},
        "part": {
            "p_partkey": list(range(n)), "p_name": ["hot ring"] * n, "p_brand": ["Brand#1"] * n, "p_type": ["SMALL"] * n,
            "p_size": [1] * n, "p_retailprice": [1.0] * n,
        },
    }
    assert not differences(spark, tmp_path, "portfolio_lists", tables)


def test_similarity_counts_by_blocks_equal_all_pairs(spark, monkeypatch):
    """Blocks of three vectors: signatures that span blocks, odd vectors, pairs with one vector."""
    monkeypatch.setattr(M, "VECTOR_BLOCK", 3)
    rng = np.random.default_rng(7)
    odd = [None, [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [1.0, 2.0], []]
    words = [["red", "bolt"], ["gear"], [], ["bolt", "ring", "gear"]]

    def side(soft, n, vec, tokens):
        rows = [(f"s{i % 5}", i, odd[i] if i < len(odd) else rng.normal(size=4).round(2).tolist(), words[i % 4]) for i in range(n)]
        return spark.createDataFrame(rows, f"{soft} string, id long, {vec} array<double>, {tokens} array<string>")

    asks, held = side("psoft", 30, "profile_vec", "profile_tokens"), side("fsoft", 40, "firm_vec", "firm_tokens")
    soft = spark.createDataFrame([(f"s{i}", f"s{j}") for i in range(5) for j in range(5) if (i + 2 * j) % 3], "psoft string, fsoft string")
    pairs = soft.join(asks.drop("id"), "psoft").join(held.drop("id"), "fsoft")
    want = dict(pairs.groupBy(round_to(M.similarity(True), 4).alias("s")).count().collect())
    found = M.word_counts(soft, asks, held).unionByName(M.vector_counts(soft, asks, held)).groupBy("s").sum("n").collect()
    assert {round(s, 4): n for s, n in found} == {round(s, 4): n for s, n in want.items()}


def test_matches_are_scanned_once_per_use(spark):
    """Each pattern stands once in the plan, and not inside the lambdas that go over its matches."""
    text = "Ann Lee, Partner. Bo Ray - Director ann@x.io. Ann Lee, Director. Cy Doe, Partner."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "write to z@y.io"), (4, "")], "id long, text string")
    people = rows.select(X.people_from_text("text", ["Partner", "Director"]).alias("p"))
    assert people._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert [(p["name"], p["title"]) for p in people.first()["p"]] == [
        ("Ann Lee", "Partner"), ("Bo Ray", "Director"), ("Cy Doe", "Partner"),
    ]
    shown = rows.select(X.contacts_in_window("text", ["Partner", "Director"]).alias("c"))
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    got = [[(c["name"], c["email"], c["confidence"]) for c in r["c"]] for r in shown.collect()]
    assert got[1:] == [[], [(None, "z@y.io", "low")], []]
    assert [c[1:] for c in got[0]] == [("ann@x.io", "high")] * 3


@pytest.mark.parametrize("passes", [4, 0])
def test_greedy_rows_of_settled_names_enter_no_round(spark, monkeypatch, passes):
    """Only names whose first row may lose its second key are decided in rounds."""
    rows = [(i, f"n{i % 50}", f"u{i}" if i % 3 else None) for i in range(500)]
    # n50 loses u1 to n1 and takes u600, which n51 then lacks; n52 has copies that tie.
    rows += [(600, "n50", "u1"), (601, "n50", "u600"), (602, "n51", "u600"), (603, "n51", "u603")]
    rows += [(604, "n52", "b"), (604, "n52", "a"), (604, "n52", "a"), (605, None, ""), (606, "", "z")]
    seen, first_two = [], D._first_two
    monkeypatch.setattr(D, "FIRST_ROW_PASSES", passes)
    monkeypatch.setattr(D, "_first_two", lambda df, *a: seen.append(df.count()) or first_two(df, *a))
    df = spark.createDataFrame(rows, "ord long, name string, url string")
    got = [tuple(r) for r in D.greedy_by_keys(df, "ord", "name", "url").collect()]
    want = [r for r in rows if r[0] < 50] + [(601, "n50", "u600"), (603, "n51", "u603"), (604, "n52", "a"), (605, None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(seen) <= 4 if passes else max(seen) > 300
