"""Merges by policy, top-up, balanced spans, draft labels, board lines: hand-made cases."""

from pyspark.sql import functions as F

from lodeworks.functions import html as H
from lodeworks.functions import text as X
from lodeworks.operators import merge as G
from lodeworks.operators.filters import tags_or_default


def test_policies_by_field_length_and_group(spark):
    known = spark.createDataFrame(
        [(1, "old", "", None, 7), (2, "old", "NY", "short", 8), (3, None, None, None, 9)], "id int, site string, st string, d string, other int"
    )
    news = spark.createDataFrame([(1, " ", "CA", "x" * 6, ["t"]), (2, "new", "CA", "y" * 9, [])], "id int, site string, st string, d string, tags array<string>")
    policies = [
        G.Policy("site", G.ALWAYS),
        G.Policy("st", G.ALWAYS, group="place"),
        G.Policy("d", longer_than=6),
        G.Policy("tags", G.ALWAYS),
    ]
    got = G.merge_by_policies(known, news, "id", policies, {"place": lambda old, new: old("st").isNull()})
    assert got.columns == ["id", "site", "st", "d", "other", "tags"]
    assert sorted(map(tuple, got.collect())) == [
        (1, "old", "CA", None, 7, ["t"]),
        (2, "new", "NY", "short", 8, None),
        (3, None, None, None, 9, None),
    ]


def test_top_up_computes_only_what_is_missing(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    stored = spark.createDataFrame([(2, "old"), (9, "old")], "id int, v string")
    seen = []

    def compute(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.select("id", F.lit("new").alias("v"))

    assert sorted(map(tuple, G.top_up(rows, stored, "id", compute).collect())) == [(1, "new"), (2, "old"), (3, "new"), (9, "old")]
    assert sorted(map(tuple, G.top_up(rows, stored, "id", compute, force=True).collect())) == [(1, "new"), (2, "new"), (3, "new"), (9, "old")]
    assert G.top_up(rows, None, "id", compute).count() == 3
    assert seen == [[1, 3], [1, 2, 3], [1, 2, 3]]


def test_published_row_without_a_result(spark):
    original = spark.createDataFrame([(1, "Acme")], "id int, name string")
    enriched = spark.createDataFrame([], "id int, stages array<string>")
    row = G.merge_authoritative(original, enriched, lambda n, u: F.upper(n), now=F.lit("now")).first().asDict()
    assert list(row) == G.AUTHORITATIVE
    assert {k: v for k, v in row.items() if v is not None} == {
        "id": 1, "name": "Acme", "display_name": "ACME", "is_real_investor": True, "partner_contacts": [], "tier1_evidence": {},
        "tier2_evidence": {}, "tier1_completeness": 0, "tier2_completeness": 0, "contacts_completeness": 0, "overall_confidence": "low",
        "missing_fields": [], "contact_flags": [], "enriched_at": "now",
    }


def test_balanced_span_knows_strings_and_escapes(spark):
    cases = {
        'x {"a": {"b": 1}} y {"c": 2}': '{"a": {"b": 1}}',
        r'{"s": "} \" } {"} tail}': r'{"s": "} \" } {"}',
        r'{"s": "ends \\"} {': r'{"s": "ends \\"}',
        '} {"k": 1}}': '{"k": 1}',
        '{"k": {"cut": 1}': None,
        '{"open string }': None,
        "none": None,
        "": None,
        "{" + "a" * 100_000 + "\n}": "{" + "a" * 100_000 + "\n}",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r.s for r in df.select(X.balanced_span("t").alias("s")).collect()] == list(cases.values())
    fixed = df.select(X.salvage_json("t", "k int, a struct<b: int>").alias("j")).collect()
    assert fixed[0].j.a.b == 1 and fixed[3].j.k == 1


def test_draft_labels_match_in_any_case_at_line_starts(spark):
    df = spark.createDataFrame([("x\nSUBJECT: y",), ("no subject: here",), ("[hook] a",)], "b string")
    errors = X.draft_errors(F.lit("s"), "b", F.lit(6), [r"\[HOOK\]", "^Subject:"])
    got = [[e for e in r.e if e.startswith("label")] for r in df.select(errors.alias("e")).collect()]
    assert got == [["label:^Subject:"], [], [r"label:\[HOOK\]"]]


def test_tags_keep_repeats_and_change_blanks_and_hyphens(spark):
    df = spark.createDataFrame([(["Real Estate", "real-estate", " AI ", "x", None],), (["x"],), (None,)], "t array<string>")
    got = [r.t for r in df.select(tags_or_default("t", ["real_estate", "ai"]).alias("t")).collect()]
    assert got == [["real_estate", "real_estate", "ai"], ["generalist"], ["generalist"]]


def test_board_line_cuts_trailing_roles(spark):
    lines = ["ANN B. LEE Blue Oak Capital Chair Elect, General Partner", "BO DOE Red Fund LLC, Partner", "nothing"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    got = [r.f for r in df.select(H.firm_from_board_line("l", ["General Partner", "Partner"], ["Chair", "LLC"]).alias("f")).collect()]
    assert got == ["Blue Oak Capital", "Red Fund", None]
