"""Hand-computed cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import exprs, names, normalize
from lodeworks.functions import normalize as N
from lodeworks.functions import text as X
from lodeworks.functions.exprs import positive_int, safe_int, title_case, trimmed
from lodeworks.functions.web import normalize_url
from lodeworks.operators import validate as V
from lodeworks.operators.joins import amount_multiplier


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "usd, shown",
    [(1_500_000_000, "$1.5B"), (475_000_000, "$475M"), (999, "$999"), (0, None), (None, None)],
)
def test_money(spark, usd, shown):
    assert one(spark, N.money(F.lit(usd).cast("bigint"))) == shown


@pytest.mark.parametrize("usd, shown", [(2_500_000, "$2.5M"), (2_000_000, "$2M"), (100_000, "$100K"), (12, "$12")])
def test_money_short(spark, usd, shown):
    assert one(spark, N.money_short(F.lit(usd))) == shown


def test_money_range_open_end(spark):
    none = F.lit(None).cast("bigint")
    assert one(spark, N.money_range(F.lit(100_000), none, N.money_short)) == "$100K+"
    assert one(spark, N.money_range(none, F.lit(5_000_000), N.money_short)) == "up to $5M"
    assert one(spark, N.money_range(none, none)) is None


def test_title_case(spark):
    assert one(spark, title_case(F.lit("o'neil a-b 3com vc"))) == "O'Neil A-B 3Com Vc"


def test_numbers_and_trim(spark):
    assert one(spark, safe_int(F.lit("12.7"))) == 12
    assert one(spark, safe_int(F.lit("1e30"))) is None
    assert one(spark, positive_int(F.lit("$1,250"))) == 1250
    assert one(spark, positive_int(F.lit("-3"))) is None
    assert one(spark, trimmed(F.lit("  "))) is None


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("HTTP://WWW.X.Com/Path", "http://www.x.com/Path"),
        ("//x.com", "https://x.com"),
        ("x.com", "https://x.com"),
        (" N/A ", None),
    ],
)
def test_normalize_url(spark, raw, clean):
    assert one(spark, normalize_url(F.lit(raw))) == clean


def test_split_compounds_and_acronyms(spark):
    assert one(spark, N.split_compounds(F.lit("bluecapital"), ["capital"])) == "blue capital"
    assert one(spark, N.restore_acronyms(F.lit("Abc Vc"), ["VC"])) == "Abc VC"


@pytest.mark.parametrize(
    "raised, expected",
    [(2e6, 1.0), (9e6, 0.7), (24e6, 0.4), (25e6, 0.0), (2e5, 0.4), (None, 1.0)],
)
def test_amount_ladder(spark, raised, expected):
    want = F.lit(raised).cast("double")
    assert one(spark, amount_multiplier(F.lit(1e6), F.lit(3e6), want, want)) == expected


def test_amount_open_firm(spark):
    none = F.lit(None).cast("double")
    assert one(spark, amount_multiplier(none, none, F.lit(1.0), F.lit(1.0))) == 1.0


LEXICON = {"c1": ["ab", "cd"], "c2": ["ef", "gh"]}


@pytest.mark.parametrize(
    "text, main, order",
    [("xabx cd", "c1", ["c1"]), ("ab ef", "c1", ["c1", "c2"]), ("gh", "c2", ["c2"]), ("zz", "general", [])],
)
def test_tagger(spark, text, main, order):
    hits = X.class_hits(F.lit(text), LEXICON)
    assert one(spark, X.primary_class(hits)) == main
    assert one(spark, X.classes_in_order(hits)) == order


@pytest.mark.parametrize(
    "text, found",
    [
        ('{"a":1}', 1),
        ('text ```json {"a":1} ``` tail', 1),
        ('x {"a":1} y', 1),
        ("no json", None),
        ("[1]", None),
    ],
)
def test_json_salvage(spark, text, found):
    assert one(spark, X.salvage_json(F.lit(text), "a int")["a"]) == found


def test_range_rule(spark):
    for low, high, kept in [(100_000, 5_000_000, True), (100_000, 5_100_000, False), (9, 3, False)]:
        a, b = V.check_range(F.lit(low), F.lit(high))
        assert one(spark, a) == (low if kept else None)
        assert one(spark, b) == (high if kept else None)
    assert one(spark, V.thesis(F.lit("x" * 49), [])) is None
    assert one(spark, V.thesis(F.lit("x" * 50), [])) == "x" * 50


def test_cosine_bounds(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, X.scaled_cosine(a, a)) == 1.0
    assert one(spark, X.scaled_cosine(a, zero)) == 0.0


def test_overlap_needs_both_sides(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, X.overlap_score(empty, F.array(F.lit("a")))) == 0.5


def test_sliced_lexicon_equals_one_slice(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "ab cd gh"), (2, "ef gh"), (3, "zz")], "id int, t string")
    rows = [(c, k, i) for i, (c, ks) in enumerate(LEXICON.items()) for k in ks]
    lexicon = spark.createDataFrame(rows, "class string, keyword string, ord int")
    want = {1: "c1", 2: "c2", 3: "general"}
    assert {r.id: r["class"] for r in X.tag_by_join(texts, "id", "t", lexicon).collect()} == want
    monkeypatch.setattr(X, "LEXICON_ROWS", 2)
    assert {r.id: r["class"] for r in X.tag_by_join(texts, "id", "t", lexicon).collect()} == want
    twice = texts.unionByName(texts.limit(1))
    assert X.tag_by_join(twice, "id", "t", lexicon).count() == 4
    none = X.tag_by_join(twice, "id", "t", lexicon.limit(0)).collect()
    assert [r["class"] for r in none] == ["general"] * 4


def test_members_lose_blanks_and_keep_digits(spark):
    values = F.array(F.lit(" a "), F.lit("1st Fund 1"), F.lit("\n\t"), F.lit(None))
    assert one(spark, normalize.trimmed_list(values)) == ["a", "1st Fund 1"]
    assert one(spark, exprs.trimmed(F.lit("\n\t"))) is None


def test_years_that_share_a_blank(spark):
    year = X.founded_year(F.lit("founded 1895 since 1999"), ["founded", "since"], 2026)
    assert one(spark, year) == 1999


def test_label_falls_back_to_title_case(spark):
    assert one(spark, X.label_of(F.lit("pre-ipo"), [])) == "Pre-Ipo"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Blue Sky Blue Sky", "Blue Sky"),
        ("Blue Sky Blue Sky Ventures", "Blue Sky Blue Sky Ventures"),
        ("Blue Ventures Home - Welcome", "Blue Ventures"),
        ("About: Blue Ventures", "Blue Ventures"),
    ],
)
def test_title_names(spark, raw, want):
    rules = names.NameRules(firm_words=["ventures"])
    assert one(spark, names.clean_title_name(F.lit(raw), rules, ["direx"], ["about"], ["home"])) == want


def test_manual_names_lose_listed_endings_only(spark):
    clean = lambda t: one(spark, names.clean_manual_name(F.lit(t), ["·Buyer"], ["fund"], ["x"]))
    assert clean("Smith, Buyer") == "Smith, Buyer" and clean("Smith·BUYER") == "Smith"


def test_no_connectives_match_nothing(spark):
    rules = names.NameRules(firm_words=["capital"])
    assert one(spark, names.valid_list_name(F.lit("Lee & Co Capital"), rules)) is True


def test_contacts_stand_where_the_titled_name_stands(spark):
    text = "Ann Lee spoke. " + "x" * 400 + " Ann Lee, Partner a@b.com linkedin.com/in/annlee"
    df = spark.createDataFrame([(text,)], "t string")
    row = X.contacts_by_proximity(df, "t", ["Partner"], "c").first()
    assert [(c.name, c.email, c.confidence) for c in row.c] == [("Ann Lee", "a@b.com", "high")]
    assert row.c[0].linkedin == "https://linkedin.com/in/annlee"


def test_section_items_left_open(spark):
    from lodeworks.functions.html import walk_sections

    rows = [(1, '<div class="team"><p>Cy Fox'), (2, '<ul class="team"><li>Ann Lee<li>Bo Ray</ul>')]
    df = spark.createDataFrame(rows, "id int, html string")
    got = walk_sections(df, "id", "html", ["team"], ["p", "li"]).collect()
    assert sorted((r.id, r.item) for r in got) == [(1, "Cy Fox"), (2, "Ann Lee"), (2, "Bo Ray")]
