"""The matcher: hand-computed rows, and blocked against plain pairing."""

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import match as M
from lodeworks.plans import matching

FIRM = dict(
    firm_id="F1",
    ord=1,
    is_real_investor=True,
    investor_type="vc",
    stages=["seed"],
    sectors=["alpha", "gamma"],
    check_size_min_usd=1_000_000,
    check_size_max_usd=3_000_000,
    geo_focus=["us_agnostic"],
    thesis_text=None,
    submission_url=None,
    business_model_preference=None,
    pre_revenue_ok=None,
    min_arr_usd=None,
    team_background_preference=None,
    lead_investor="both",
    portfolio_companies=None,
    tier1_completeness=100,
    sub_tags=["s1", "s4"],
)
FIRM_DDL = """firm_id string, ord int, is_real_investor boolean, investor_type string, stages array<string>,
sectors array<string>, check_size_min_usd bigint, check_size_max_usd bigint, geo_focus array<string>,
thesis_text string, submission_url string, business_model_preference array<string>, pre_revenue_ok boolean,
min_arr_usd bigint, team_background_preference array<string>, lead_investor string,
portfolio_companies array<struct<name: string, sector: string, founder_background: string>>,
tier1_completeness int, sub_tags array<string>"""
PROFILE = dict(
    profile_id="P",
    funding_stage="seed",
    raise_min=None,
    raise_max=None,
    raise_value=2_000_000,
    sector_tags=["alpha", "beta"],
    geo_city=None,
    seeking_lead=True,
    business_model=None,
    arr_usd=500_000.0,
    pre_revenue=False,
    team_background=None,
    sub_sector_tags=["s1", "s2", "s3"],
    narrative_text=None,
    conf_stage="high",
    conf_sector="high",
    conf_geo="high",
    conf_raise="high",
    has_profile=True,
)
PROFILE_DDL = """profile_id string, funding_stage string, raise_min bigint, raise_max bigint, raise_value bigint,
sector_tags array<string>, geo_city string, seeking_lead boolean, business_model array<string>, arr_usd double,
pre_revenue boolean, team_background array<string>, sub_sector_tags array<string>, narrative_text string,
conf_stage string, conf_sector string, conf_geo string, conf_raise string, has_profile boolean"""


def run(spark, firms, profiles=None, vocab=None, **options):
    a = spark.createDataFrame([tuple(p.values()) for p in profiles or [PROFILE]], PROFILE_DDL)
    b = spark.createDataFrame([tuple(f.values()) for f in firms], FIRM_DDL)
    rows = M.match(a, b, vocab or M.MatchVocab(), **options).collect()
    return {(r.profile_id, r.firm_id): r for r in rows}


def test_hand_computed_firms(spark):
    firms = [
        FIRM,
        {**FIRM, "firm_id": "F2", "ord": 2, "stages": ["growth"]},
        {**FIRM, "firm_id": "F3", "ord": 3, "check_size_min_usd": 50_000_000, "check_size_max_usd": 60_000_000},
        {**FIRM, "firm_id": "F4", "ord": 4, "sectors": ["gamma"]},
        {**FIRM, "firm_id": "F5", "ord": 5, "sub_tags": ["generalist"]},
        {**FIRM, "firm_id": "F6", "ord": 6, "sub_tags": ["s7", "s8"]},
        {**FIRM, "firm_id": "F7", "ord": 7, "stages": None, "sectors": None, "geo_focus": []},
        {**FIRM, "firm_id": "F8", "ord": 8, "is_real_investor": False},
        {**FIRM, "firm_id": "F8n", "ord": 9, "is_real_investor": None},
    ]
    got = {k[1]: v for k, v in run(spark, firms).items()}
    assert set(got) == {"F1", "F5", "F6", "F7", "F8n"}
    first = got["F1"]
    assert first.sector_score == 0.4583
    assert first.tier2_score == 0.4160
    assert first.sub_f1_base == 0.3333
    assert first.score == 0.3109
    assert first.sub_sector_status == "matched"
    assert got["F5"].sub_f1_base == 0.20 and got["F5"].sub_sector_status == "no_data"
    assert got["F6"].sub_f1_base == 0.03 and got["F6"].sub_sector_status == "confirmed_mismatch"
    assert got["F7"].sector_score == 1.0 and got["F7"].dim_scores.geo_soft == 0.5


def test_pre_revenue_bar(spark):
    firm = {**FIRM, "pre_revenue_ok": False}
    assert not run(spark, [firm], [{**PROFILE, "pre_revenue": True}])


def test_equal_firms_rank_by_input_order(spark):
    firms = [{**FIRM, "firm_id": f"X{i}", "ord": i} for i in (5, 3, 9, 1)]
    got = sorted(run(spark, firms, top_n=2).values(), key=lambda r: r["rank"])
    assert [r.firm_id for r in got] == ["X1", "X3"]


def test_inferred_tags_rescue(spark):
    firm = {**FIRM, "sub_tags": [], "portfolio_companies": [("acme s-two", None, None)]}
    vocab = M.MatchVocab(portfolio_tags=[("s-two", "s2")])
    got = run(spark, [firm], vocab=vocab)[("P", "F1")]
    assert got.sub_sector_status == "inferred" and got.sub_tags_matched == ["s2"]


def test_shuffled_path_equals_broadcast_path(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"

    def result():
        rows = matching.match_top(spark, sf).select("profile_id", "rank", "firm_id", "score").collect()
        return sorted(map(tuple, rows))

    want = result()
    monkeypatch.setattr(M, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(M, "salted_join", lambda a, b, k, s, c: _salted(a, b, k, s, c))
    assert result() == want


def test_pruning_loses_no_row_and_opens_few_pairs(spark, monkeypatch):
    """Without the threshold every gated pair is opened; the ranking stays the same."""
    counts = {}

    def counted(name, threshold):
        pruned, opened = M.promising, M.opened

        def promised(soft, profile_sigs, firm_sigs, anchors, top_n):
            if threshold:
                return pruned(soft, profile_sigs, firm_sigs, anchors, top_n)
            pairs = soft.select("psoft", "fsoft").join(profile_sigs.select("psig", "psoft"), "psoft")
            return pairs.withColumn("threshold", F.lit(0.0))

        def rows(*args):
            out = opened(*args)
            counts[name] = out.count()
            return out

        with monkeypatch.context() as m:
            m.setattr(M, "promising", promised)
            m.setattr(M, "opened", rows)
            found = matching.match_top(spark, "/root/testdata/sf0.001")
            return sorted(map(tuple, found.select("profile_id", "rank", "firm_id", "score").collect()))

    assert counted("pruned", True) == counted("all", False)
    assert 2 * counts["pruned"] < counts["all"]


def test_profile_without_either_form_is_refused(spark):
    rows = [
        PROFILE,
        {**PROFILE, "profile_id": "flat", "has_profile": False},
        {**PROFILE, "profile_id": "raw", "has_profile": None, "sub_sector_tags": None},
        {**PROFILE, "profile_id": "untagged", "sub_sector_tags": None},
    ]
    assert {k[0] for k in run(spark, [FIRM], rows)} == {"P", "flat", "untagged"}
    df = spark.createDataFrame([tuple(p.values()) for p in rows], PROFILE_DDL)
    accepted, refused = M.split_profiles(df)
    assert accepted.count() == 3 and [(r.profile_id, r.reason) for r in refused.collect()] == [
        ("raw", "neither profile nor sub_sector_tags")
    ]


def test_narrowed_firms_rank_below_wide_ones(spark):
    """An indication the profile is silent on costs 0.6 of the base, for tagged and untagged firms."""
    vocab = M.MatchVocab(indications={"x": ["xray", "xenon"]})
    firms = [
        {**FIRM, "firm_id": f"{tags}{text}", "ord": i, "sub_tags": ["s1"] if tags == "tag" else [], "thesis_text": t}
        for i, (tags, text, t) in enumerate(
            [("tag", "narrow", "xray xenon"), ("tag", "wide", "xray"), ("no", "narrow", "xray xenon"), ("no", "wide", None)]
        )
    ]
    for top in (1, 2, 3, 4):
        got = sorted(run(spark, firms, vocab=vocab, top_n=top).values(), key=lambda r: r["rank"])
        assert [r.firm_id for r in got] == ["tagwide", "nowide", "tagnarrow", "nonarrow"][:top]


def _salted(a, b, keys, spread_on, condition):
    from lodeworks.operators.skew import salted_join

    return salted_join(a, b, keys, spread_on, condition, share=0.01, floor=0)


def test_missing_vectors_use_words(spark):
    firm = {**FIRM, "thesis_text": "plain thesis about rivers"}
    profile = {**PROFILE, "narrative_text": "plain story about rivers"}
    got = run(spark, [firm], [profile])[("P", "F1")]
    assert got.semantic_score == 1.0
    assert any(r.startswith("thesis alignment") for r in got.match_reasons)


@pytest.mark.parametrize("city, ok", [("Metro City, X", True), ("Elsewhere", False)])
def test_city_gate(spark, city, ok):
    firm = {**FIRM, "geo_focus": ["metro"]}
    vocab = M.MatchVocab(city_tags={"metro city": "metro"})
    assert bool(run(spark, [firm], [{**PROFILE, "geo_city": city}], vocab=vocab)) is ok


