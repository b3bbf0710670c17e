"""Record builders: hand-made rows, absent columns, cascades."""

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import records as R

RULES = R.RecordRules(
    sectors=["health"], states=["NY"], type_rules=[R.TypeRule("fund", gate="fund")], weights={"name": 60, "aum_usd": 70}
)



def test_absent_columns_become_defaults(spark):
    raw = spark.createDataFrame([("ACME fund",), ("  ",), (None,)], "name string")
    rows = R.clean_records(raw, RULES, now=F.lit("now")).collect()
    assert rows[0].asDict() == {
        **{c: None for c in R.CLEAN_ORDER},
        "id": rows[0].id, "name": "ACME fund", "slug": "acme-fund", "investor_type": "other", "sector": "general",
        "sectors": ["general"], "stage": [], "focus": [], "region": "North America", "hq_country": "US", "key_people": [],
        "contacts": [], "portfolio": [], "data_source": "unknown", "data_confidence": "medium", "us_verified": True,
        "scraped_at": "now", "completeness_score": 60,
    }
    assert len(rows) == 1 and rows[0].id.startswith("m_")


def test_completeness_counts_what_is_filled_and_stops_at_100(spark):
    raw = spark.createDataFrame([("A b", "7"), ("C d", "0")], "name string, aum_usd string")
    got = {r.name: r.completeness_score for r in R.clean_records(raw, RULES).collect()}
    assert got == {"A b": 100, "C d": 60}


@pytest.mark.parametrize(
    "flag, assets, kept", [("Y", "10", True), ("N", "10", False), ("N", None, True), ("N", "5000000", True)]
)
def test_small_advisers_without_a_fund_flag_go(spark, flag, assets, kept):
    df = spark.createDataFrame([("X", "ny", flag, assets)], "n string, s string, flag string, assets string").select(
        F.struct(F.col("n").alias("BusNm")).alias("Info"),
        F.struct(F.col("s").alias("State")).alias("MainAddr"),
        F.struct(
            F.struct(F.struct(F.col("flag").alias("Q1")).alias("Item8A"), F.struct(F.col("assets").alias("AUM")).alias("Item5F")).alias("Part1A")
        ).alias("FormInfo"),
    )
    rows = R.adviser_filings(df, RULES, now=F.lit("now")).collect()
    assert len(rows) == kept
    if kept:
        assert rows[0].asDict()["id"] == "sec_X" and rows[0].investor_type == ("fund" if flag == "Y" else "other")


def test_item_with_a_plain_number_and_a_list_of_sites(spark):
    df = spark.createDataFrame([("X", "NY", 9_000_000, ["a.com", "b.com"])], "n string, s string, v long, w array<string>").select(
        F.struct(F.col("n").alias("LegalNm")).alias("Info"),
        F.struct(F.col("s").alias("State")).alias("MainAddr"),
        F.struct(F.struct(F.col("v").alias("Item5F"), F.struct(F.col("w").alias("WebAddrs")).alias("Item1")).alias("Part1A")).alias("FormInfo"),
    )
    row = R.adviser_filings(df, RULES, now=F.lit("now")).first()
    assert (row.aum_usd, row.website, row.portfolio, row.key_people) == (9_000_000, "https://a.com", [], [])


def test_unwrapped_profile_keeps_its_leaves(spark):
    df = spark.sql("select 'c' as company_name, struct('seed' as funding_stage, array('a', 'b') as sector_tags) as tier1")
    row = R.profile_records(df, nested=True).first()
    assert (row.funding_stage, row.sector, row.pre_revenue, row.overall_confidence, row.missing_signals) == ("seed", "a, b", False, 0.0, [])
    assert row["_profile"].tier1.sector_tags == ["a", "b"]


def test_cascade_order_gate_and_nulls(spark):
    rules = [R.TypeRule("a", flags=["x"]), R.TypeRule("b", name_words=["n"], text_words=["t"]), R.TypeRule("c", name_words=["z"], gate="g")]
    rows = [(True, "n", None, True), (None, "N", None, None), (False, "z", "x T", None), (False, "z", None, True), (False, "z", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "x boolean, name string, text string, g boolean")
    kind = R.type_cascade(rules, "d", {"x": F.col("x"), "g": F.col("g")}, F.col("name"), F.col("text"))
    assert [r.k for r in df.select(kind.alias("k")).collect()] == ["a", "b", "b", "c", "d", "d"]
