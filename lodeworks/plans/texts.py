"""Tagging and extraction bound to documents and conversations, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import text as X
from lodeworks.operators.records import TypeRule, type_cascade
from lodeworks.plans.registry import query, sql_list, table, text_table

# Example vocabularies: made-up classes over word parts that occur in the tables.
LEXICON = {
    "romance": ["mente", "ción", "eau", "queux"],
    "germanic": ["keit", "heit", "ungsch", "lich"],
    "anglic": ["tion", "thing", "wh", "ness"],
    "rude": ["scum", "idiot", "moron", "loser"],
}
TIGHT = {"rude": ["scum", "idiot"], "legal": ["rights reserved", "license"]}
STAGES = {"early": ["thing", "heit"], "middle": ["scum", "queux"], "late": ["idiot", "keit"]}
CITIES = [("erhash", "NY|Erhash"), ("scum", "CA|Scum"), ("keiten", "TX|Keiten"), ("eaux", "WA|Eaux")]


def docs(spark, sf):
    return text_table(spark, sf, "documents", "doc_id")


def sql_hits(text, lexicon):
    rows = []
    for i, (name, kws) in enumerate(lexicon.items()):
        rows.append(
            f"{{'hits': len(list_filter({sql_list(kws)}, lambda k: contains({text}, k))), 'ord': {-i}, 'cls': '{name}'}}"
        )
    return f"list_filter([{', '.join(rows)}], lambda r: r.hits > 0)"


HITS = sql_hits("lower(text)", LEXICON)


@query(
    "lexicon_tags",
    "T1",
    f"""with t as (select doc_id, lower(text) as low, {HITS} as h from documents),
       p as (select *, coalesce(list_max(h).cls, 'general') as main from t)
       select doc_id, main, array_to_string([r.cls for r in list_reverse_sort(h)], ',') as by_hits,
         array_to_string([r.cls for r in h], ',') as in_order,
         array_to_string(list_filter(case main when 'romance' then {sql_list(LEXICON["romance"])} when 'germanic' then {sql_list(LEXICON["germanic"])}
           when 'anglic' then {sql_list(LEXICON["anglic"])} when 'rude' then {sql_list(LEXICON["rude"])} else [] end, lambda k: contains(low, k)), ',') as focus
       from p""",
)
def lexicon_tags(spark, sf):
    tagged = docs(spark, sf).select("doc_id", "text", X.class_hits("text", LEXICON).alias("h"))
    tagged = tagged.withColumn("main", X.primary_class(F.col("h")))
    return tagged.select(
        "doc_id",
        "main",
        F.array_join(X.classes_by_hits(F.col("h")), ",").alias("by_hits"),
        F.array_join(X.classes_in_order(F.col("h")), ",").alias("in_order"),
        F.array_join(X.matched_keywords("text", LEXICON, F.col("main")), ",").alias("focus"),
    )


@query(
    "lexicon_tags_by_table",
    "T1",
    f"""select doc_id, coalesce(list_max({HITS}).cls, 'general') as class from documents""",
)
def lexicon_tags_by_table(spark, sf):
    rows = [(c, k, i) for i, (c, kws) in enumerate(LEXICON.items()) for k in kws]
    lexicon = spark.createDataFrame(rows, "class string, keyword string, ord int")
    return X.tag_by_join(docs(spark, sf), "doc_id", "text", lexicon)


@query(
    "two_phase_tags",
    "T2",
    f"""with j as (select d.doc_id, lower(d.text) as a, lower(b.text) as b from documents d left join benchmark b on d.doc_id = b.item_id)
       select doc_id, coalesce(list_max({sql_hits("a", TIGHT)}).cls, list_max({sql_hits("b", LEXICON)}).cls, 'general') as class from j""",
)
def two_phase_tags(spark, sf):
    more = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("joined"))
    rows = docs(spark, sf).select("doc_id", "text").join(more, "doc_id", "left")
    by_name = F.array_max(X.class_hits("text", TIGHT))["class"]
    by_text = F.array_max(X.class_hits("joined", LEXICON))["class"]
    return rows.select("doc_id", F.coalesce(by_name, by_text, F.lit("general")).alias("class"))


@query(
    "stage_tags",
    "T3",
    f"""with t as (select doc_id, [r.cls for r in {sql_hits("lower(text)", STAGES)}] as f from documents)
       select doc_id, case when len(f) > 0 then array_to_string(f, ',') else 'Unknown' end as stages, array_to_string(f, ',') as plain from t""",
)
def stage_tags(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        F.array_join(X.stage_tags("text", STAGES), ",").alias("stages"),
        F.array_join(X.stage_tags("text", STAGES, default=None), ",").alias("plain"),
    )


@query(
    "first_city",
    "T4 W12",
    """with t as (select doc_id, lower(text) as low from documents), c as (select doc_id, case when contains(low, 'erhash') then 'NY|Erhash'
         when contains(low, 'scum') then 'CA|Scum' when contains(low, 'keiten') then 'TX|Keiten' when contains(low, 'eaux') then 'WA|Eaux' end as hit from t)
       select doc_id, string_split(hit, '|')[1] as state, string_split(hit, '|')[2] as city from c""",
)
def first_city(spark, sf):
    hit = F.split(X.first_listed("text", CITIES), r"\|")
    return docs(spark, sf).select(
        "doc_id", F.get(hit, F.lit(0)).alias("state"), F.get(hit, F.lit(1)).alias("city")
    )


@query(
    "region_group",
    "T5",
    """with t as (select doc_id, lower(text) as low from documents)
       select doc_id, case when contains(low, 'scum') or contains(low, 'erhash') then 'North' when contains(low, 'keit') then 'East'
         when contains(low, 'eau') then 'West' end as region from t""",
)
def region_group(spark, sf):
    groups = [(["scum", "erhash"], "North"), (["keit"], "East"), (["eau"], "West")]
    return docs(spark, sf).select("doc_id", X.first_group("text", groups).alias("region"))


KEYWORDS = ["tion", "scum", "keit", "eau", "ción", "wh", "ound", "mente", "lich", "the"]


@query(
    "keyword_list",
    "T6",
    f"""with t as (select doc_id, list_filter(list_sort({sql_list(KEYWORDS)}), lambda k: contains(lower(text), k)) as f from documents)
       select doc_id, array_to_string(f, ',') as keywords, array_to_string(f[1:3], ',') as capped from t""",
)
def keyword_list(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        F.array_join(X.keyword_list("text", KEYWORDS), ",").alias("keywords"),
        F.array_join(X.keyword_list("text", KEYWORDS, 3), ",").alias("capped"),
    )


STAGE_RE = "(?i)(?:pre-?tion|heitkeit|tion|keit|eaux)"


@query(
    "stage_by_pattern",
    "T7 T7b W11",
    f"""with t as (select doc_id, nullif(regexp_extract(text, '{STAGE_RE}'), '') as raw, list_distinct(regexp_extract_all(text, '{STAGE_RE}')) as al,
           regexp_extract_all(text, '{STAGE_RE}') as dup, text from documents)
       select doc_id, coalesce(case when contains(lower(raw), 'heitk') then 'Double' when contains(lower(raw), 'tion') then 'Seed' end,
           upper(raw[1]) || lower(raw[2:])) as stage, len(al) as n_distinct,
         regexp_matches(text, '(?i)scum|idiot') as tier_a, regexp_matches(text, '(?i)keit') as tier_b from t""",
)
def stage_by_pattern(spark, sf):
    stage = X.label_of(X.first_match("text", STAGE_RE), [("heitk", "Double"), ("tion", "Seed")])
    return docs(spark, sf).select(
        "doc_id",
        stage.alias("stage"),
        F.size(F.array_distinct(X.all_matches("text", STAGE_RE))).alias("n_distinct"),
        F.col("text").rlike("(?i)scum|idiot").alias("tier_a"),
        F.col("text").rlike("(?i)keit").alias("tier_b"),
    )


@query(
    "type_by_flags",
    "T8",
    """select p_partkey, case when p_size > 40 then 'Private Equity' when p_size > 30 then 'Venture'
         when contains(p_name, 'bolt') then 'Venture' when p_retailprice > 950 and (contains(p_name, 'ring') or contains(p_name, 'gear')) then 'Growth'
         when p_retailprice > 950 then 'Fund' else 'Adviser' end as kind from part""",
)
def type_by_flags(spark, sf):
    """Filing flags beat names; the broad name rules need the fund flag."""
    flags = {"buyout": F.col("p_size") > 40, "venture": F.col("p_size") > 30, "fund": F.col("p_retailprice") > 950}
    rules = [
        TypeRule("Private Equity", flags=["buyout"]),
        TypeRule("Venture", flags=["venture"], name_words=["bolt"]),
        TypeRule("Growth", name_words=["ring", "gear"], gate="fund"),
        TypeRule("Fund", gate="fund"),
    ]
    kind = type_cascade(rules, "Adviser", flags, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind"))


@query(
    "type_by_text",
    "T9",
    """select doc_id, case when contains(lower(text), 'idiot') then 'CVC' when contains(lower(text), 'scum') or contains(lower(source), 'src7') then 'Accelerator'
         when contains(lower(text), 'keit') then 'Growth' else 'VC' end as kind from documents""",
)
def type_by_text(spark, sf):
    rules = [
        TypeRule("CVC", text_words=["idiot"]),
        TypeRule("Accelerator", text_words=["scum"], name_words=["src7"]),
        TypeRule("Growth", text_words=["keit"]),
    ]
    kind = type_cascade(rules, "VC", {}, F.col("source"), F.col("text"))
    return docs(spark, sf).select("doc_id", kind.alias("kind"))


# The checking engine has no lookaround: every separator is doubled there, so that one match
# does not use up the edge of the next.
YEARS_RE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:founded|since)\s+(?:in\s+)?(\d{4})(?:$|[^\p{L}\p{N}_])"
YEAR_TEXT = "(text || case when doc_id % 3 = 0 then ' Founded in ' || (1900 + n_chars % 200) || ' since ' || (1950 + n_chars % 120) || '.' else '' end)"


def year_text():
    n = F.col("n_chars")
    extra = F.concat(
        F.lit(" Founded in "),
        (F.pmod(n, F.lit(200)) + 1900).cast("string"),
        F.lit(" since "),
        (F.pmod(n, F.lit(120)) + 1950).cast("string"),
        F.lit("."),
    )
    return F.concat("text", F.when(F.pmod("doc_id", F.lit(3)) == 0, extra).otherwise(""))


@query(
    "founded_year",
    "T10",
    rf"""with t as (select doc_id, [cast(y as integer) for y in regexp_extract_all(regexp_replace({YEAR_TEXT}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '{YEARS_RE}', 1)] as ys from documents)
       select doc_id, list_filter(ys, lambda y: y between 1970 and 2026)[1] as year, case when ys[1] between 1970 and 2026 then ys[1] end as first_only from t""",
)
def founded_year(spark, sf):
    words = ["founded", "since"]
    return docs(spark, sf).select(
        "doc_id",
        X.founded_year(year_text(), words, 2026).alias("year"),
        X.founded_year(year_text(), words, 2026, first_only=True).alias("first_only"),
    )


BOILER = "(?i)(?:all rights|nicht|copyright)"
WANTED = "(?i)(?:tion|keit)"


@query(
    "descriptions",
    "T11 T21",
    rf"""with t as (select doc_id, source, text, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat,
           array_to_string(list_filter(string_split(regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), chr(10)), lambda l: not regexp_matches(l, '{BOILER}')), chr(10)) as body from documents),
       s as (select *, [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))] as ss from t),
       p as (select *, list_filter(ss, lambda x: not regexp_matches(x, '^[#*\[\-]') and not regexp_matches(x, '{BOILER}')) as pl from s)
       select doc_id, case when length(flat) > 50 then left(flat, 300) end as lead,
         coalesce(list_filter(pl, lambda x: length(x) between 50 and 240 and (regexp_matches(x, '{WANTED}') or contains(lower(x), lower(source))))[1],
           list_filter(pl, lambda x: length(x) between 60 and 200)[1]) as sentence from p""",
)
def descriptions(spark, sf):
    body = X.drop_lines(X.unwrap_links("text"), BOILER)
    return docs(spark, sf).select(
        "doc_id",
        X.lead_description("text").alias("lead"),
        X.best_sentence(body, "source", WANTED, BOILER).alias("sentence"),
    )


TITLES = ["General Partner", "Partner", "Director", "Founder"]


def staffed(spark, sf):
    """Documents with people from the part table written into them."""
    people = table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        F.concat_ws(" ", F.initcap("p_name")).alias("a"),
        F.concat(F.initcap(F.split("p_name", " ")[1]), F.lit(" "), F.initcap("p_type")).alias("b"),
    )
    words = F.concat(
        F.col("a"), F.lit(", Partner. "), F.col("text"), F.lit(" "), F.col("b"),
        F.lit(" - Director linkedin.com/in/me-"), F.col("doc_id").cast("string"),
        F.lit(" and "), F.col("a"), F.lit(" Founder."),
    )
    return docs(spark, sf).join(people, "doc_id").select("doc_id", words.alias("text"))


CAP = "array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split({0}, ' ')], ' ')"
STAFFED = f"""(select doc_id, {CAP.format("p_name")} || ', Partner. ' || text || ' ' || {CAP.format("string_split(p_name, ' ')[2] || ' ' || p_type")}
   || ' - Director linkedin.com/in/me-' || doc_id || ' and ' || {CAP.format("p_name")} || ' Founder.' as text
   from documents join part on doc_id = p_partkey)"""
PERSON_RE = X.person_pattern(TITLES)
KEY_RE = rf"{X.EDGE}({X.PERSON_NAME})\s*[,–\-\n]\s*(?:{'|'.join(TITLES)})"


@query(
    "people_and_titles",
    "T12",
    rf"""with t as (select doc_id, list_zip(regexp_extract_all(text, '{PERSON_RE}', 1), regexp_extract_all(text, '{PERSON_RE}', 2)) as z,
           [trim(regexp_replace(k, '\s+', ' ', 'g')) for k in regexp_extract_all(text, '{KEY_RE}', 1)] as kp from {STAFFED}),
       u as (select doc_id, [{{'n': trim(regexp_replace(p[1], '\s+', ' ', 'g')), 't': p[2]}} for p in z] as ps, kp from t),
       v as (select doc_id, list_filter(ps, lambda p, i: list_position([lower(q.n) for q in ps], lower(p.n)) = i)[1:8] as f,
           list_filter(kp, lambda p: not contains(p, 'Promo')) as kp from u)
       select doc_id, array_to_string([p.n || '/' || p.t for p in f], ';') as people,
         array_to_string(list_filter(kp, lambda p, i: list_position([lower(q) for q in kp], lower(p)) = i)[1:5], ';') as key_people from v""",
)
def people_and_titles(spark, sf):
    people = F.transform(
        X.people_from_text("text", TITLES), lambda p: F.concat_ws("/", p["name"], p["title"])
    )
    return staffed(spark, sf).select(
        "doc_id",
        F.array_join(people, ";").alias("people"),
        F.array_join(X.key_people("text", TITLES, ["Promo"]), ";").alias("key_people"),
    )


# Lead-ins of the test texts: what follows the partner's name, and what follows the link.
LEAD_INS = [r"(?i)partner\.\s([^.]{8,120})", r"in/me-\d+ and ([^.]{5,60})"]
COMPANY = r"[A-Z][a-zA-Z0-9]{1,19}"
SUFFIX_RE = rf"{X.EDGE}((?:{COMPANY}\s+){{0,3}}{COMPANY}\s+(?:Small|Large|Promo|Bolt))"


@query(
    "portfolio_lists",
    "T13",
    rf"""with t as (select doc_id, list_concat({', '.join(f"flatten([list_filter([trim(x) for x in string_split(m, ',')], lambda x: length(x) between 2 and 40)[1:5] for m in regexp_extract_all(text, '{p}', 1)])" for p in LEAD_INS)}) as l,
           [trim(regexp_replace(k, '\s+', ' ', 'g')) for k in regexp_extract_all(text, '{SUFFIX_RE}', 1)] as c from {STAFFED}),
       u as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:15] as l, list_filter(c, lambda x: not regexp_matches(x, '(?i)gizmo') and len(string_split(x, ' ')) between 2 and 5) as c from t)
       select doc_id, array_to_string(l, ';') as listed, array_to_string(list_filter(c, lambda x, i: list_position([lower(y) for y in c], lower(x)) = i)[1:6], ';') as suffixed from u""",
)
def portfolio_lists(spark, sf):
    return staffed(spark, sf).select(
        "doc_id",
        F.array_join(X.listed_portfolio("text", LEAD_INS), ";").alias("listed"),
        F.array_join(
            X.suffixed_companies("text", ["Small", "Large", "Promo", "Bolt"], "(?i)gizmo"), ";"
        ).alias("suffixed"),
    )


@query(
    "contact_handles",
    "T14",
    rf"""select doc_id, array_to_string(regexp_extract_all(text, '{X.EMAIL}'), ';') as mails,
         array_to_string(regexp_extract_all(text, '{X.PHONE}'), ';') as phones, array_to_string(regexp_extract_all(text, '{X.PROFILE_LINK}'), ';') as links from {STAFFED}""",
)
def contact_handles(spark, sf):
    return staffed(spark, sf).select(
        "doc_id",
        F.array_join(X.all_matches("text", X.EMAIL), ";").alias("mails"),
        F.array_join(X.all_matches("text", X.PHONE), ";").alias("phones"),
        F.array_join(X.all_matches("text", X.PROFILE_LINK), ";").alias("links"),
    )


def show_contact(c):
    return F.concat_ws(
        "/", F.coalesce(c["name"], F.lit("-")), F.coalesce(c["email"], F.lit("-")),
        F.coalesce(c["phone"], F.lit("-")), F.coalesce(c["linkedin"], F.lit("-")), c["confidence"],
    )


@query(
    "contacts_by_proximity",
    "T15",
    rf"""with t as (select doc_id, text, regexp_extract_all(text, '{PERSON_RE}', 1) as ns, regexp_extract_all(text, '{PERSON_RE}', 0) as fs, [{{'h': h, 'pos': strpos(text, h)}} for h in regexp_extract_all(text, '{X.EMAIL}')] as es,
           [{{'h': h, 'pos': strpos(text, h)}} for h in regexp_extract_all(text, '{X.PHONE}')] as ph, [{{'h': case when starts_with(h, 'http') then h else 'https://' || h end, 'pos': strpos(text, h)}} for h in regexp_extract_all(text, '{X.PROFILE_LINK}')] as ls from {STAFFED}),
       u as (select *, [{{'n': trim(regexp_replace(z[1], '\s+', ' ', 'g')), 'pos': strpos(text, z[2]) + strpos(z[2], z[1]) - 1}} for z in list_zip(ns, fs)] as ps from t),
       v as (select *, list_filter(ps, lambda p, i: list_position([lower(q.n) for q in ps], lower(p.n)) = i) as f from u),
       w as (select *, [{{'n': p.n, 'e': list_filter(es, lambda h: abs(h.pos - p.pos) <= 200)[1].h, 'p': list_filter(ph, lambda h: abs(h.pos - p.pos) <= 200)[1].h,
           'l': list_filter(ls, lambda h: abs(h.pos - p.pos) <= 200)[1].h}} for p in f] as m from v),
       x as (select doc_id, list_concat([z.n || '/' || coalesce(z.e, '-') || '/' || coalesce(z.p, '-') || '/' || coalesce(z.l, '-') || '/' || case when z.e is not null or z.p is not null or z.l is not null then 'high' else 'medium' end for z in m],
           ['-/' || h.h || '/-/-/low' for h in list_filter(es, lambda h: not list_contains([q.e for q in m], h.h))],
           ['-/-/' || h.h || '/-/low' for h in list_filter(ph, lambda h: not list_contains([q.p for q in m], h.h))],
           ['-/-/-/' || h.h || '/low' for h in list_filter(ls, lambda h: not list_contains([q.l for q in m], h.h))])[1:20] as c from w)
       select doc_id, array_to_string(c, ';') as contacts from x""",
)
def contacts_by_proximity(spark, sf):
    rows = X.contacts_by_proximity(staffed(spark, sf), "text", TITLES, "contacts")
    return rows.select(
        "doc_id", F.array_join(F.transform("contacts", show_contact), ";").alias("contacts")
    )


@query("contacts_in_window", "T15")
def contacts_in_window(spark, sf):
    return staffed(spark, sf).select(
        "doc_id",
        F.array_join(F.transform(X.contacts_in_window("text", TITLES), show_contact), ";").alias(
            "contacts"
        ),
    )


FENCE = "```"


@query(
    "json_salvage",
    "T24",
    """select event_id, case event_type when 'error' then null else cast(json_extract_string(props, '$.k') as bigint) end as k from events""",
)
def json_salvage(spark, sf):
    props, kind = F.col("props"), F.col("event_type")
    messy = (
        F.when(kind == "error", F.lit("no json at all"))
        .when(kind == "view", F.concat(F.lit(f"text {FENCE}json\n"), props, F.lit(f"\n{FENCE} tail")))
        .when(kind == "click", F.concat(F.lit("the answer is "), props, F.lit(" as asked")))
        .otherwise(props)
    )
    parsed = X.salvage_json(messy, "k bigint")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


SPAN_TEXT = """'noted: ' || case event_id % 5 when 0 then '{"a": {"k": ' || event_id || '}, "s": "} \\\\" {"} and {"z": 1}'
  when 1 then '{"k": ' || event_id || ', "cut": {"off": 1}' when 2 then 'nothing here' when 3 then '} {"k": ' || event_id || '}}}' else '{"q": "\\\\\\\\", "k": ' || event_id || '}{' end"""


@query(
    "json_balanced_span",
    "T24",
    rf"""with t as (select event_id, regexp_extract({SPAN_TEXT.replace(chr(92) * 2, chr(92))}, '(?s)\{{.*', 0) as s from events),
       m as (select event_id, s, regexp_extract_all(s, '(?s)(\\.|["{{}}]|[^"{{}}\\]+|\\)', 1) as marks from t),
       r as (select event_id, s, list_reduce(list_prepend({{'d': 0, 'q': false, 'c': false, 'n': 0, 'm': ''}}, [{{'d': 0, 'q': false, 'c': false, 'n': 0, 'm': x}} for x in marks]),
         lambda a, x: case when a.c then a else {{'d': a.d + (not a.q and x.m = '{{')::int - (not a.q and x.m = '}}')::int, 'q': a.q <> (x.m = '"'),
           'c': not a.q and x.m = '}}' and a.d = 1, 'n': a.n + cast(length(x.m) as int), 'm': ''}} end) as z from m)
       select event_id, case when z.c then left(s, z.n) end as span from r""",
)
def json_balanced_span(spark, sf):
    """Nested, quoted and cut-off braces around event numbers."""
    k, n = F.col("event_id").cast("string"), F.pmod("event_id", F.lit(5))
    text = (
        F.when(n == 0, F.concat(F.lit('{"a": {"k": '), k, F.lit('}, "s": "} \\" {"} and {"z": 1}')))
        .when(n == 1, F.concat(F.lit('{"k": '), k, F.lit(', "cut": {"off": 1}')))
        .when(n == 2, F.lit("nothing here"))
        .when(n == 3, F.concat(F.lit('} {"k": '), k, F.lit("}}}")))
        .otherwise(F.concat(F.lit('{"q": "\\\\", "k": '), k, F.lit("}{")))
    )
    return table(spark, sf, "events").select(
        "event_id", X.balanced_span(F.concat(F.lit("noted: "), text)).alias("span")
    )


@query(
    "draft_checks",
    "T25",
    r"""with t as (select conv_id, turn, text as body, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as n,
           len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) % 13 as score,
           len(list_filter(string_split_regex(string_split(text, '.')[1], '\s+'), lambda w: w <> '')) as ns from conversations)
       select conv_id, turn, array_to_string(list_filter([case when regexp_matches(body, '[\x{4e00}-\x{9fff}]') then 'foreign_characters' end,
         case when n < 150 or n > 240 then 'word_count' end,
         case when contains(lower(body), 'of the') then 'label:of  ?the' when regexp_matches(body, '(?im)^en ') then 'label:^en ' end,
         case when ns < 1 or ns > 10 then 'subject_length' end, case when score < 5 then 'low_score' end], lambda e: e is not null), ';') as errors from t""",
)
def draft_checks(spark, sf):
    subject = F.get(F.split("text", r"\."), F.lit(0))
    score = F.pmod(F.size(X.words("text")), F.lit(13))
    errors = X.draft_errors(subject, "text", score, ["of  ?the", "^en "])
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(errors, ";").alias("errors")
    )


STOP = ["that", "with", "this", "pour", "dans", "para"]
TOKENS = (
    "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[,.;]', '', 'g'), '\\s+'), lambda w: length(w) > 3 and w not in ('that', 'with', 'this', 'pour', 'dans', 'para')))"
)


@query(
    "token_sets",
    "T26",
    f"""select doc_id, array_to_string(list_sort({TOKENS.format("text")}), ' ') as tokens from documents""",
)
def token_sets(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.array_join(F.sort_array(X.token_set("text", STOP)), " ").alias("tokens")
    )


@query(
    "keyword_overlap",
    "M19",
    f"""with b as (select item_id, {TOKENS.format("text")} as tb from benchmark), d as (select doc_id, {TOKENS.format("text")} as td from documents),
       p as (select d.doc_id, td, tb from d join b on d.doc_id = b.item_id)
       select doc_id, round(case when len(td) = 0 or len(tb) = 0 then 0.5 else least(1.0::double,
         (len(list_intersect(td, tb))::double / (len(td) + len(tb) - len(list_intersect(td, tb)))) / 0.12::double) end, 4) as overlap from p""",
)
def keyword_overlap(spark, sf):
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), X.token_set("text", STOP).alias("tb")
    )
    pairs = docs(spark, sf).select("doc_id", X.token_set("text", STOP).alias("td")).join(items, "doc_id")
    return pairs.select(
        "doc_id", F.round(X.overlap_score(F.col("td"), F.col("tb")), 4).alias("overlap")
    )


@query(
    "scaled_cosine_to_centroid",
    "M18",
    """with x as (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings),
       c as (select label, i, avg(v::double) as m from x group by 1, 2),
       s as (select vec_id, sum(v::double * m) as dot, sqrt(sum(v::double * v::double)) as a, sqrt(sum(m * m)) as b from x join c on x.label = c.label and x.i = c.i group by vec_id)
       select vec_id, round(least(1.0, greatest(0.0, (case when a * b = 0 then 0 else dot / (a * b) end - 0.20) / 0.25)), 4)::double as similarity from s""",
)
def scaled_cosine_to_centroid(spark, sf):
    """Each vector against the mean of its label: an equi-join, no pair search."""
    vectors = table(spark, sf, "embeddings")
    dims = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    # One entry per dimension: the gathered list is as long as a vector.
    centres = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c")
    )
    return vectors.join(centres, "label").select(
        "vec_id", F.round(X.scaled_cosine(F.col("embedding"), F.col("c")), 4).alias("similarity")
    )
