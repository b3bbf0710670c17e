"""Operators with their own distributed method, against brute force."""

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import dedup, fuzzy, percentile, skew
from lodeworks.operators.percentile import exact_percentiles
from lodeworks.operators.ranking import rank_by_ranges
from lodeworks.session import shared_dir


def greedy(rows):
    kept, names, urls = [], set(), set()
    for order, name, url in sorted(rows):
        if name in names or (url is not None and url in urls):
            continue
        kept.append(order)
        names.add(name)
        if url is not None:
            urls.add(url)
    return kept


def test_greedy_by_keys_small_example(spark):
    rows = [(0, "n1", "u1"), (1, "n2", "u1"), (2, "n2", "u3")]
    df = spark.createDataFrame(rows, "ord long, name string, url string")
    assert sorted(r.ord for r in dedup.greedy_by_keys(df, "ord", "name", "url").collect()) == [0, 2]


def test_greedy_by_keys_with_null_keys(spark):
    rows = [(0, None, None), (1, None, None), (2, "a", None), (3, "a", ""), (4, "b", ""), (5, None, "u")]
    df = spark.createDataFrame(rows, "ord long, name string, url string")
    assert sorted(r.ord for r in dedup.greedy_by_keys(df, "ord", "name", "url").collect()) == [0, 2, 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_by_keys_random_and_hot(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (
            i,
            "hot" if rnd.random() < 0.35 else f"n{rnd.randrange(60)}",
            None if rnd.random() < 0.2 else f"u{rnd.randrange(80)}",
        )
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "ord long, name string, url string").repartition(5)
    got = sorted(r.ord for r in dedup.greedy_by_keys(df, "ord", "name", "url").collect())
    assert got == greedy(rows)


def test_greedy_by_edges_chain(spark):
    nodes = spark.range(6).withColumnRenamed("id", "ord")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "earlier long, later long")
    got = sorted(r.ord for r in dedup.greedy_by_edges(nodes, edges, "ord").collect())
    assert got == [0, 2, 4, 5]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Rows that decide one another in a chain of 10,000 are settled by doubling."""
    cuts = []
    cut = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: cuts.append(0) or cut(df))
    n = 10_000
    rows = spark.range(n).select(
        F.col("id").alias("ord"),
        F.concat(F.lit("n"), F.floor((F.col("id") + 1) / 2)).alias("name"),
        F.concat(F.lit("u"), F.floor(F.col("id") / 2)).alias("url"),
    )
    got = sorted(r.ord for r in dedup.greedy_by_keys(rows, "ord", "name", "url").select("ord").collect())
    assert got == list(range(0, n, 2)) and len(cuts) <= 30
    cuts.clear()
    nodes = spark.range(n).withColumnRenamed("id", "ord")
    edges = nodes.filter("ord > 0").select((F.col("ord") - 1).alias("earlier"), F.col("ord").alias("later"))
    got = sorted(r.ord for r in dedup.greedy_by_edges(nodes, edges, "ord").collect())
    assert got == list(range(0, n, 2)) and len(cuts) <= 30


@pytest.mark.parametrize("seed", range(3))
def test_greedy_by_edges_random(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({tuple(sorted(rnd.sample(range(120), 2))) for _ in range([60, 130, 400][seed])})
    dropped = set()
    for i in range(120):
        if any(b == i and a not in dropped for a, b in edges):
            dropped.add(i)
    nodes = spark.range(120).withColumnRenamed("id", "ord")
    df = spark.createDataFrame(edges, "earlier long, later long")
    got = {r.ord for r in dedup.greedy_by_edges(nodes, df, "ord").collect()}
    assert got == set(range(120)) - dropped


def names(seed, n=140):
    rnd = random.Random(seed)
    words = ["blue", "oak", "capital", "river", "partners", "north", "fund", "labs", "seed"]
    out = set()
    while len(out) < n:
        name = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(name))
            name = rnd.choice(
                [name[:at] + name[at + 1 :], name[:at] + "x" + name[at:], name[:at] + "y" + name[at + 1 :]]
            )
        if name.strip():
            out.add(name)
    return sorted(out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("measure, threshold", [(fuzzy.EDIT, 0.85), (fuzzy.RATIO, 0.88)])
def test_similar_names_loses_no_pair(spark, measure, threshold):
    all_names = names(7)
    df = spark.createDataFrame([(n,) for n in all_names], "a string")
    got = {
        (r.a, r.b)
        for r in fuzzy.similar_names(df, df.withColumnRenamed("a", "b"), threshold, measure=measure).collect()
    }

    def sim(a, b):
        if measure == fuzzy.EDIT:
            return 1 - edit_distance(a, b) / max(len(a), len(b))
        return SequenceMatcher(None, a, b).ratio()

    want = {(a, b) for a in all_names for b in all_names if sim(a, b) > threshold}
    assert got == want


@pytest.mark.parametrize("common", [2, 15, 10_000])
def test_common_segments_lose_no_pair(spark, common):
    """A third of the names share their ending; the rarest of finer segments index them."""
    rnd = random.Random(common)
    base = names(11, 120)
    all_names = base + [f"{n[:9]} capital partners" for n in base[::2]] + [f"{rnd.choice(base)[:7]}x capital partner" for _ in range(30)]
    df = spark.createDataFrame([(n,) for n in set(all_names)], "a string")
    got = {
        (r.a, r.b)
        for r in fuzzy.similar_names(df, df.withColumnRenamed("a", "b"), 0.82, strict=False, common=common).collect()
    }
    want = {
        (a, b) for a in set(all_names) for b in set(all_names) if 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.82
    }
    assert got == want


def test_a_common_segment_makes_no_candidates(spark):
    """A third of the names share nothing but an ending, and are not paired through it."""
    rnd = random.Random(5)
    made = {"".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=12)) + " partners" for _ in range(1000)}
    made |= {"".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=21)) for _ in range(2000)}
    df = spark.createDataFrame([(m,) for m in made], "a string")

    def candidates(common):
        other = df.withColumnRenamed("a", "b")
        return fuzzy.candidate_pairs(df, other, 0.85, fuzzy.EDIT, F.lit(True), common=common).count()

    assert 10 * candidates(50) < candidates(10**9)


def test_restore_missing_skips_present_names(spark):
    wanted = spark.createDataFrame([(1, "blue oak fund"), (2, "river capitl"), (3, "gone far away")], "id int, name string")
    present = spark.createDataFrame([("blue oak fund",)], "nm string")
    backup = spark.createDataFrame([("river capital", 7), ("river kapital", 5)], "b string, ord long")
    got = fuzzy.restore_missing(wanted, "name", present, "nm", backup, 0.82).collect()
    assert [(r.id, r.name, r.ord) for r in got] == [(2, "river capitl", 7)]


def test_best_match_prefers_exact_then_similar(spark):
    wanted = spark.createDataFrame([("blue oak fund",), ("river capitl",), ("zzzz",)], "a string")
    backup = spark.createDataFrame(
        [("blue oak fund", 3), ("river capital", 1), ("river capitol", 2)], "b string, ord long"
    )
    got = {r.a: r.b for r in fuzzy.best_match(wanted, backup, 0.85).collect()}
    assert got == {"blue oak fund": "blue oak fund", "river capitl": "river capital"}


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 10.0, 20.0],
        [-5.5, 0.0, 0.0, 3.25, 1e9, 1e-7, -2e6],
        [7.0] * 50 + [8.0, 9.0],
        list(np.random.default_rng(3).lognormal(8, 3, 3000)),
    ],
)
def test_exact_percentiles(spark, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    got = {r.p: r.percentile for r in exact_percentiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_exact_percentiles_of_a_million_values_in_one_bucket(spark, monkeypatch):
    """All values share sign, exponent and leading digits; no range is ranked with many rows."""
    ranked = []
    whole = percentile._in_ranges

    def counted(data, ranges, *rest):
        ranked.append(ranges.agg(F.max("_n")).first()[0])
        return whole(data, ranges, *rest)

    monkeypatch.setattr(percentile, "_in_ranges", counted)
    df = spark.range(1_000_000).select((F.lit(5.0) + ((F.col("id") * 7919) % 1_000_000) * 1e-9).alias("v"))
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {r.p: r.percentile for r in exact_percentiles(df, "v", probs, final_rows=500).collect()}
    values = 5.0 + np.arange(1_000_000) * 1e-9
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-13)
    assert ranked[0] == 1_000_000 and ranked[-1] <= 500 and len(ranked) <= 5


def test_exact_percentiles_of_hot_and_null_groups(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", None, "", "a"]), rnd.choice([rnd.gauss(0, 1), -3.5, 0.0, rnd.random() * 1e-9])) for _ in range(4000)]
    df = spark.createDataFrame([*rows, ("none", None)], "g string, v double").repartition(5)
    got = {(r.g, r.p): r.percentile for r in exact_percentiles(df, "v", [0.05, 0.5, 0.9], ["g"], final_rows=20).collect()}
    assert {g for g, _ in got} == {"hot", None, "", "a"}
    for (g, p), value in got.items():
        want = float(np.quantile([v for k, v in rows if k == g], p))
        assert value == pytest.approx(want, rel=1e-12, abs=1e-18)


def test_exact_percentiles_by_group(spark):
    rows = [(g, float(i * g)) for g in (1, 2, 3) for i in range(11)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r.g, r.p): r.percentile for r in exact_percentiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {(1, 0.5): 5.0, (2, 0.5): 10.0, (3, 0.5): 15.0}


def skewed(spark):
    left = spark.range(3000).select(
        F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")
    )
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    return left, right


def test_keyed_lookup_splits_hot_keys_without_change(spark):
    left, right = skewed(spark)
    want = sorted(map(tuple, left.join(right, "k", "left").select("i", "k", "w").collect()))
    got = skew.keyed_lookup(left, right, "k", share=0.1, floor=0).select("i", "k", "w")
    assert sorted(map(tuple, got.collect())) == want


def test_salted_join_without_change(spark):
    left, right = skewed(spark)
    want = sorted(map(tuple, left.join(right, "k").select("i", "k", "w").collect()))
    got = skew.salted_join(left, right, ["k"], "i", share=0.1, floor=0).select("i", "k", "w")
    assert sorted(map(tuple, got.collect())) == want


@pytest.fixture
def whole_partitions(spark):
    """Tables of a test are small: AQE would join their partitions into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("group", [["k"], []])
def test_rank_by_ranges_splits_a_hot_key(spark, whole_partitions, group):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None, f"k{i}"]), rnd.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, d int, i int").repartition(6)
    shared_dir(spark)
    got = rank_by_ranges(df, [F.desc("d"), F.asc("i")], group, keep=parts.append_and_fix).collect()
    seen, want = Counter(), {}
    for k, d, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[k if group else 0] += 1
        want[i] = seen[k if group else 0]
    assert {r.i: r.position for r in got} == want
    assert max(parts.sizes) < 0.5 * len(rows)


class parts:
    """Remembers how many rows each partition of the sorted ranges held."""

    sizes: list = []

    @staticmethod
    def append_and_fix(df):
        fixed = df.checkpoint()
        parts.sizes = [r["count"] for r in fixed.groupBy(F.shiftright("_row", 33)).count().collect()]
        return fixed


def test_rank_by_ranges_of_repeated_rows(spark, whole_partitions):
    df = spark.createDataFrame([("a", 1)] * 500 + [("b", 0)], "k string, d int").repartition(4)
    shared_dir(spark)
    got = rank_by_ranges(df, [F.asc("d")], ["k"], keep=parts.append_and_fix).collect()
    assert sorted(r.position for r in got if r.k == "a") == list(range(1, 501))
    assert max(parts.sizes) < 400
    assert rank_by_ranges(df.limit(0), [F.asc("d")], ["k"]).count() == 0


def test_keep_best_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    best = dedup.keep_best(df, ["k"], [F.desc("id")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.id for r in best.collect()) == [98, 99]
