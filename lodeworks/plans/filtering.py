"""Filters and predicates bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import names as N
from lodeworks.functions.exprs import words
from lodeworks.functions.web import host_of, html_text
from lodeworks.operators import filters as P
from lodeworks.plans.registry import query, sql_in, sql_list, table, text_table

RULES = N.NameRules(
    firm_words=["tion", "ring", "keit", "mente", "ment"],
    places=["thing.", "un.", "sthe.", "en.", "the."],
    noise=["all rights", "disgusting", "nicht"],
    count_words=["und", "the", "of"],
    headline_words=["from", "with", "pour", "das"],
    site_words=["http", "copyright"],
    generic=["thing", "reserved", "things"],
    tagline_words=["for", "und", "avec", "para"],
    bad_starts=["the ", "un ", "der "],
    excluded=["all rights reserved.", "thing."],
    months=["jan", "feb", "in", "on"],
    starters=["the", "of", "und", "et"],
    connectives=["and", "or", "in", "of", "le", "der"],
)
L, R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def alts(ws):
    return "|".join(ws)


def sql_any(text, terms):
    return "(" + " or ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def text_lines(spark, sf):
    """Every line of every document, numbered."""
    return text_table(spark, sf, "documents", "doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


LINES = """(select doc_id, unnest(string_split(text, chr(10))) as line,
   generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)"""
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


def flagged(df):
    return df.withColumn(
        "flag",
        F.when(F.col("value") < 100, F.lit(True)).when(F.col("value") < 200, F.lit(False)),
    )


@query(
    "null_safe_flag_filter",
    "F1",
    """select event_id, event_type from (select *, case when value < 100 then true
         when value < 200 then false end as flag from events)
       where flag is distinct from false""",
)
def null_safe_flag_filter(spark, sf):
    return P.keep_unless_false(flagged(table(spark, sf, "events")), "flag").select(
        "event_id", "event_type"
    )


@query(
    "faceted_browse",
    "F2",
    """select p_partkey, p_name, p_brand, p_type from part
       where p_type in ('SMALL', 'MEDIUM', 'LARGE')
         and contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'widget')
         and p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')""",
)
def faceted_browse(spark, sf):
    saved = (
        table(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(F.col("l_partkey").alias("p_partkey"))
    )
    return P.browse(
        table(spark, sf, "part"),
        facets={"p_type": ["SMALL", "MEDIUM", "LARGE"]},
        text_columns=["p_name", "p_brand", "p_type"],
        text=" Widget ",
        saved=saved,
        saved_key="p_partkey",
    ).select("p_partkey", "p_name", "p_brand", "p_type")


@query(
    "derived_type",
    "F3",
    """select p_partkey, case when contains(lower(p_name), 'anvil') or contains(lower(p_name), 'gizmo')
         then 'CVC' else case p_type when 'SMALL' then 'Seed fund' when 'LARGE' then 'Growth fund' end
         end as firm_type from part""",
)
def derived_type(spark, sf):
    firm_type = P.derived_type(
        "p_name", "p_type", ["anvil", "gizmo"], {"SMALL": "Seed fund", "LARGE": "Growth fund"}
    )
    return table(spark, sf, "part").select("p_partkey", firm_type.alias("firm_type"))


@query(
    "name_search_first",
    "F4 W13",
    """select p_partkey, p_name, concat_ws('; ', p_brand, p_type) as tags from part
       where contains(lower(p_name), 'bolt') order by p_partkey limit 10""",
)
def name_search_first(spark, sf):
    return (
        table(spark, sf, "part")
        .filter(F.lower("p_name").contains("bolt"))
        .select(
            "p_partkey", "p_name", F.array_join(F.array("p_brand", "p_type"), "; ").alias("tags")
        )
        .orderBy("p_partkey")
        .limit(10)
    )


@query(
    "source_split",
    "F5",
    """select doc_id, case when coalesce(source, '') in ('src1', 'src2', 'src3')
         then 'inside' else 'outside' end as lane from documents""",
)
def source_split(spark, sf):
    lane = P.lane_by_source("source", ["src1", "src2", "src3"])
    return table(spark, sf, "documents").select("doc_id", lane.alias("lane"))


PERSON = f"""(len(ws) in (2, 3) and list_bool_and([regexp_matches(w, '^\\p{{Lu}}') for w in ws])
   and not {sql_any("lower(nm)", RULES.firm_words)} and not regexp_matches(nm, '[0-9]'))"""


@query(
    "reject_reasons",
    "F6 F7",
    rf"""with t as (select doc_id, line_no, trim(line) as nm, lower(trim(line)) as low,
         {WORDS.format("trim(line)")} as ws from {LINES})
       select doc_id, line_no, case
         when length(nm) < 4 then 'too_short'
         when low in {sql_in(RULES.places)} then 'place_name'
         when {sql_any("low", RULES.noise)} then 'noise_phrase'
         when regexp_matches(low, '^\d+\s+(?:{alts(RULES.count_words)})') then 'count_phrase'
         when len(ws) > 8 then 'too_many_words'
         when regexp_matches(low, 'https?://|@') or regexp_matches(low, '\.(?:com|org|io){R}')
           then 'url_or_email'
         when not {sql_any("low", RULES.firm_words)} and len(ws) > 4 then 'no_firm_word'
         when {PERSON} then 'person_like'
         end as reason from t""",
)
def reject_reasons(spark, sf):
    return text_lines(spark, sf).select(
        "doc_id", "line_no", N.reject_reason("line", RULES).alias("reason")
    )


@query(
    "person_like_names",
    "F7",
    f"""select p_partkey, coalesce({PERSON}, false) as person_like from (
         select p_partkey, p_brand || ' ' || upper(left(p_name, 1)) || substr(p_name, 2) as b,
           upper(left(p_type, 1)) || ' ' || upper(left(p_name, 1)) || substr(p_name, 2) as nm,
           {WORDS.format("upper(left(p_type, 1)) || ' ' || upper(left(p_name, 1)) || substr(p_name, 2)")} as ws
         from part)""",
)
def person_like_names(spark, sf):
    name = F.concat(
        F.upper(F.left("p_type", F.lit(1))),
        F.lit(" "),
        F.upper(F.left("p_name", F.lit(1))),
        F.substring("p_name", 2, 1000),
    )
    return table(spark, sf, "part").select(
        "p_partkey", N.person_like(name, RULES.firm_words).alias("person_like")
    )


@query(
    "cleaning_steps",
    "F8",
    f"""with t as (select p_type, p_size, lower(p_name) as low from part)
       select step, count(*) as n_rows from (select case
         when contains(low, 'anvil') then 'invalid_name'
         when p_type = 'PROMO' then 'not_an_institution'
         when p_size > 40 then 'portfolio_company' else 'kept' end as step from t) group by step""",
)
def cleaning_steps(spark, sf):
    return P.step_report(
        table(spark, sf, "part"),
        [
            ("invalid_name", F.lower("p_name").contains("anvil")),
            ("not_an_institution", F.col("p_type") == "PROMO"),
            ("portfolio_company", F.col("p_size") > 40),
        ],
    )


@query(
    "valid_headline_names",
    "F9",
    rf"""with t as (select doc_id, line_no, line, trim(regexp_replace(line, '\s+', ' ', 'g')) as nm from {LINES})
       select doc_id, line_no from t where length(line) >= 4
         and not regexp_matches(nm, '(?i){L}(?:{alts(RULES.headline_words)}){R}')
         and not {sql_any("lower(nm)", RULES.site_words)}
         and regexp_replace(lower(nm), 's+$', '') not in {sql_in([g.rstrip("s") for g in RULES.generic])}
         and not regexp_matches(nm, '(?i){L}(?:{alts(RULES.tagline_words)}){R}')
         and not (starts_with(lower(nm), 'the ') or starts_with(lower(nm), 'un ') or starts_with(lower(nm), 'der '))
         and len({WORDS.format("nm")}) <= 6 and regexp_matches(nm, '^[\p{{Lu}}\p{{Nd}}]')""",
)
def valid_headline_names(spark, sf):
    return (
        text_lines(spark, sf)
        .filter(N.valid_headline_name("line", RULES))
        .select("doc_id", "line_no")
    )


@query(
    "valid_list_names",
    "F10",
    rf"""with t as (select doc_id, line_no, line as nm, lower(line) as low, {WORDS.format("line")} as ws from {LINES})
       select doc_id, line_no from t where length(nm) between 3 and 70 and len(ws) between 1 and 7
         and {sql_any("low", RULES.firm_words)} and low not in {sql_in(RULES.excluded)}
         and not regexp_matches(low, '^\s*(?:{alts(RULES.months)})[a-z]*\s+\d')
         and not regexp_matches(nm, '^\s*[$€£¥]?\d[\d,.]+[BMKbmk%]?\s*\+?$')
         and coalesce(lower(ws[1]), '') not in {sql_in(RULES.starters)}
         and list_bool_or([regexp_matches(w, '^\p{{Lu}}') for w in ws])
         and not (len(ws) >= 3 and regexp_matches(array_to_string(ws[2:], ' '), '{L}(?:{alts(RULES.connectives)}){R}'))""",
)
def valid_list_names(spark, sf):
    return (
        text_lines(spark, sf).filter(N.valid_list_name("line", RULES)).select("doc_id", "line_no")
    )


@query(
    "valid_document_names",
    "F11",
    rf"""with t as (select doc_id, line_no, trim(line) as nm, lower(trim(line)) as low, {WORDS.format("trim(line)")} as ws from {LINES})
       select doc_id, line_no from t where length(nm) between 5 and 80 and len(ws) between 2 and 7
         and {sql_any("low", RULES.firm_words)} and not regexp_matches(nm, '^\d')
         and not list_has_any({WORDS.format("low")}, {sql_list(RULES.noise)})""",
)
def valid_document_names(spark, sf):
    return (
        text_lines(spark, sf)
        .filter(N.valid_document_name("line", RULES))
        .select("doc_id", "line_no")
    )


@query(
    "placeholder_people",
    "F12",
    f"""select doc_id, line_no, (line = '' or contains(line, '(') or starts_with(trim(lower(line)), 'the ')
         or starts_with(trim(lower(line)), 'of ') or contains(trim(lower(line)), 'of the')
         or contains(trim(lower(line)), 'en la')) as placeholder from {LINES}""",
)
def placeholder_people(spark, sf):
    flag = N.placeholder_person("line", ["the ", "of "], ["of the", "en la"])
    return text_lines(spark, sf).select("doc_id", "line_no", flag.alias("placeholder"))


@query(
    "domestic_entities",
    "F13",
    """select c_custkey from (select c_custkey, upper(trim(c_mktsegment)) as st,
         upper(trim(case when c_acctbal < 0 then '' else n_name end)) as ctry
         from customer join nation on c_nationkey = n_nationkey)
       where (ctry = '' or ctry in ('NATION_1', 'NATION_2', 'NATION_3')) and st in ('BUILDING', 'MACHINERY')""",
)
def domestic_entities(spark, sf):
    named = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    country = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("n_name"))
    return named.filter(
        P.domestic_entity(
            country, "c_mktsegment", ["NATION_1", "NATION_2", "NATION_3"], ["BUILDING", "MACHINERY"]
        )
    ).select("c_custkey")


HTML_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(html,
   '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))"


@query(
    "evidence_gates",
    "F14 F15",
    f"""with t as (select page_id, url, lower({HTML_TEXT}) as txt from pages)
       select page_id,
         ({sql_any("txt", ["withthe", "tionof", "disgusting"])} or not {sql_any("lower(url)", ["/fr/", "/de/"])}) as lenient_pass,
         {sql_any("txt", ["withthe", "tionof", "disgusting"])} as strict_pass,
         {sql_any("txt", ["heit ", "tion ", "mente "])} as invests from t""",
)
def evidence_gates(spark, sf):
    home = ["withthe", "tionof", "disgusting"]
    pages = table(spark, sf, "pages").withColumn("txt", F.lower(html_text("html")))
    return pages.select(
        "page_id",
        P.lenient_evidence("txt", "url", home, ["/fr/", "/de/"]).alias("lenient_pass"),
        P.mentions_any("txt", home).alias("strict_pass"),
        P.mentions_any("txt", ["heit ", "tion ", "mente "]).alias("invests"),
    )


@query(
    "host_exclusion",
    "F16",
    f"""select page_id, {HOST} as host from pages where not (
         {HOST} = 'cheap-pills.example.com' or ends_with({HOST}, '.cheap-pills.example.com')
         or {HOST} = 'example.net' or ends_with({HOST}, '.example.net'))""",
)
def host_exclusion(spark, sf):
    return (
        table(spark, sf, "pages")
        .select("page_id", host_of("url").alias("host"))
        .filter(~P.on_hosts("host", ["cheap-pills.example.com", "example.net"]))
    )


@query(
    "small_adviser_drop",
    "F17",
    """select o_orderkey from (select o_orderkey, o_orderstatus = 'F' as fund,
         case when o_totalprice > 1000 then o_totalprice * 100 end as aum from orders)
       where not (not fund and aum is not null and aum < 5e6)""",
)
def small_adviser_drop(spark, sf):
    aum = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice") * 100)
    return (
        table(spark, sf, "orders")
        .filter(~P.small_adviser(F.col("o_orderstatus") == "F", aum))
        .select("o_orderkey")
    )


@query(
    "filled_ratio",
    "F18",
    """with t as (select d.doc_id, [lower(trim(coalesce(d.text, ''))), lower(trim(coalesce(d.source, ''))),
           lower(trim(coalesce(d.lang, ''))), lower(trim(coalesce(cast(l.quality as varchar), '')))] as f
         from documents d left join labels l on d.doc_id = l.doc_id)
       select doc_id, round(len(list_filter(f, lambda v: v <> '' and not contains(v, 'idiot')
         and not contains(v, 'src7') and not contains(v, 'fr'))) / 4.0::double, 2) as score from t""",
)
def filled_ratio(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    score = P.filled_ratio(
        ["text", "source", "lang", F.col("quality").cast("string")], ["idiot", "src7", "fr"]
    )
    return joined.select("doc_id", score.alias("score"))


@query(
    "amount_missing",
    "F19",
    """with t as (select p_partkey, case when p_size < 10 then p_type when p_size < 20 then 'unknown'
         when p_size < 30 then '' else p_brand end as amt from part)
       select p_partkey, (trim(amt) = '' or contains(lower(amt), 'unknown')
         or not regexp_matches(amt, '[\\d$€£¥KMBkmb]')) as missing from t""",
)
def amount_missing(spark, sf):
    size = F.col("p_size")
    amount = (
        F.when(size < 10, F.col("p_type"))
        .when(size < 20, "unknown")
        .when(size < 30, "")
        .otherwise(F.col("p_brand"))
    )
    return table(spark, sf, "part").select(
        "p_partkey", P.amount_missing(amount, ["unknown"]).alias("missing")
    )


ALLOWED = {"SMALL": ["red", "bolt"], "LARGE": ["blue", "gear", "old"]}


@query(
    "focus_whitelist",
    "F20",
    """select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: case p_type
         when 'SMALL' then w in ('red', 'bolt') when 'LARGE' then w in ('blue', 'gear', 'old')
         else true end), ',') as focus from part""",
)
def focus_whitelist(spark, sf):
    focus = P.allowed_by_key(F.split("p_name", " "), "p_type", ALLOWED)
    return table(spark, sf, "part").select("p_partkey", F.array_join(focus, ",").alias("focus"))


@query(
    "vocabulary_filters",
    "F21",
    """select p_partkey, case when trim(p_type) in ('SMALL', 'PROMO') then trim(p_type) end as kind,
         array_to_string(nullif(list_filter(string_split(p_name, ' '), lambda w: w in ('red', 'gear', 'ring')), []), ',') as known,
         coalesce(array_to_string(nullif(list_filter(string_split(lower(p_name), ' '), lambda w: w in ('hot', 'bolt')), []), ','), 'generalist') as tags
       from part""",
)
def vocabulary_filters(spark, sf):
    parts = words("p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        P.enum_or_null("p_type", ["SMALL", "PROMO"]).alias("kind"),
        F.array_join(P.list_in(parts, ["red", "gear", "ring"]), ",").alias("known"),
        F.array_join(P.tags_or_default(parts, ["hot", "bolt"]), ",").alias("tags"),
    )


@query(
    "tag_spelling",
    "F21 V11",
    """select p_partkey, coalesce(array_to_string(nullif(list_filter(string_split(replace(lower(p_name), ' ', '_'), '#') || [lower(split_part(p_name, ' ', 1)) || '_' || lower(split_part(p_name, ' ', 2))] || [lower(split_part(p_name, ' ', 3))],
           lambda w: w in ('red_bolt', 'hot_gear', 'ring', 'blue_ring')), []), ','), 'generalist') as tags from part""",
)
def tag_spelling(spark, sf):
    """Tags written with blanks, hyphens and capitals."""
    w = F.split("p_name", " ")
    first, second, third = (F.get(w, F.lit(i)) for i in range(3))
    raw = F.array(
        F.upper("p_name"),
        F.concat(F.lit(" "), F.initcap(first), F.lit("-"), second, F.lit(" ")),
        third,
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(P.tags_or_default(raw, ["red_bolt", "hot_gear", "ring", "blue_ring"]), ",").alias("tags"),
    )


@query(
    "skip_nameless",
    "F22 F23",
    """select c_custkey, c_mktsegment from customer
       where nullif(trim(case when c_acctbal < 0 then ' ' else c_name end), '') is not null""",
)
def skip_nameless(spark, sf):
    shown = F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name"))
    return (
        table(spark, sf, "customer")
        .withColumn("_shown", F.nullif(F.trim(shown), F.lit("")))
        .filter(F.col("_shown").isNotNull())
        .select("c_custkey", "c_mktsegment", "_shown")
        .drop("_shown")
    )


@query(
    "skip_lanes",
    "F24",
    f"""with t as (select page_id, case when contains(url, '/es/') then '' else url end as u,
           {HOST} as host, case when contains(url, '.html') then '' else {HTML_TEXT} end as txt from pages)
       select page_id, case when u = '' then 'no_website'
         when host = 'example.org' or ends_with(host, '.example.org') then 'excluded_host'
         when trim(txt) = '' then 'empty_text' end as reason from t""",
)
def skip_lanes(spark, sf):
    pages = table(spark, sf, "pages")
    url = F.when(F.col("url").contains("/es/"), "").otherwise(F.col("url"))
    text = F.when(F.col("url").contains(".html"), "").otherwise(html_text("html"))
    reason = P.skip_reason(F.lit(True), url, host_of("url"), text, ["example.org"])
    return pages.select("page_id", reason.alias("reason"))
