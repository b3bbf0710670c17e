"""Work that must not repeat itself, or meet in one task, as tables grow."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodeworks.functions import html as H
from lodeworks.functions import names as N
from lodeworks.operators import fuzzy as Z
from lodeworks.operators.filters import list_in
from lodeworks.plans.matching import firms, profiles
from lodeworks.plans.validating import raw_results


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_title_cleaner_holds_each_step_once(spark):
    rules = N.NameRules(firm_words=["fund", "capital"], tagline_words=["of", "in"])
    names = [None, "", "  ", "About: Red Bolt - Direx profile", "red bolt red bolt", "a b c a b c", "x y works at B1 Fund",
             "red bolt of all things", "red bolt  fund | Start page", "Long Words Here And There Again Seven"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, s string")
    cleaned = N.clean_title_name("s", rules, ["direx"], ["about"], ["start page"])
    df = rows.select("id", cleaned.alias("name"))
    got = [r["name"] for r in df.orderBy("id").collect()]
    assert got == [None, None, None, "Red Bolt", "red bolt", "a b c", "B1 Fund", None, "red bolt fund", None]
    assert optimized(df.select("name")).count("(?i)") == 5


def test_block_ratio_scores_only_pairs_the_edits_leave_open(spark, monkeypatch):
    """Prefixes compared at once and by segments; both equal brute force."""
    names = [f"{a} {b} brand{n} {c}" for a in ("red", "reddish", "red hot") for b in ("bolt", "gear") for n in (1, 7, 12) for c in ("small", "smart")]
    both = spark.createDataFrame([(x,) for x in [*names, "", None, "rex"]], "a string")
    ratio = {(x, y): SequenceMatcher(None, x, y).ratio() for x in names for y in names if x[:4] == y[:4]}
    want = {k: r for k, r in ratio.items() if r > 0.88}
    for block in (1, 2000):
        monkeypatch.setattr(Z.candidate_pairs, "__defaults__", (0, 3, block))
        found = Z.similar_names(both, both.withColumnRenamed("a", "b"), 0.88, measure=Z.RATIO, same_prefix=4)
        assert "levenshtein" in optimized(found)
        got = {(r["a"], r["b"]): r["sim"] for r in found.collect() if r["a"] in names and r["b"] in names}
        assert got == want and len(want) < len(ratio)


def test_pages_are_walked_a_few_at_a_time(spark, monkeypatch):
    """What a task holds as Python objects does not grow with the pages of its batch."""
    page = '<div class="team"><li>Ann {0}</li><p>of {0}<br>Bolt</p></div><li>out</li>'
    rows = [(i, page.format(i)) for i in range(7)] + [(7, None), (8, "")]
    pages = spark.createDataFrame(rows, "id long, html string").coalesce(1)
    monkeypatch.setattr(H, "WALKED", 2)
    found = H.walk_sections(pages, "id", "html", ["team"], ["li", "p"])
    want = {x for i in range(7) for x in ((i, "team", f"Ann {i}"), (i, "team", f"of {i} Bolt"))}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "MapInArrow" in optimized(found)


def test_results_are_spread_and_lists_built_once(spark):
    found = raw_results(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() > 1
    kept = optimized(spark.range(1).select(list_in(F.array(F.concat(F.col("id").cast("string"), F.lit("x"))), ["0x"]).alias("l")))
    assert kept.count("concat(") == 1
    rows = spark.createDataFrame([(["a", "z"],), (["z"],), ([],), (None,)], "v array<string>")
    assert [r["l"] for r in rows.select(list_in("v", ["a"]).alias("l")).collect()] == [["a"], None, None, None]


def test_features_of_the_matcher_are_spread(spark):
    for side in (profiles, firms):
        assert side(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
