"""Page operators bound to the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import html as H
from lodeworks.functions import names as N
from lodeworks.functions import text as X
from lodeworks.functions.web import bare_host, html_text, site_root
from lodeworks.plans.filtering import HTML_TEXT, L, R, WORDS, alts, sql_any
from lodeworks.plans.registry import query, sql_in, table, text_table
from lodeworks.plans.texts import LEXICON, sql_hits

RULES = N.NameRules(
    firm_words=["tion", "ring", "keit", "mente", "ment"],
    excluded=["tion"],
    months=["jan", "feb"],
    starters=["the", "of", "und", "et", "der"],
    connectives=["and", "or", "in", "of", "le", "der"],
    generic=["thing"],
    headline_words=["pour", "das"],
    tagline_words=["avec", "para"],
    site_words=["http"],
    bad_starts=["un "],
)
TAGS = "<[^>]+>"


def inner(tag):
    return rf"[trim(regexp_replace(t, '{TAGS}', '', 'g')) for t in regexp_extract_all(html, '(?is)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})>', 1)]"


LINES_OF = rf"""list_filter([trim(t) for t in string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'), '{TAGS}', chr(10), 'g'), chr(10))], lambda t: t <> '')"""


def valid_sql(nm, ws):
    return rf"""(length({nm}) between 3 and 70 and len({ws}) between 1 and 7 and {sql_any(f"lower({nm})", RULES.firm_words)}
      and lower({nm}) not in {sql_in(RULES.excluded)} and not regexp_matches(lower({nm}), '^\s*(?:jan|feb)[a-z]*\s+\d')
      and not regexp_matches({nm}, '^\s*[$€£¥]?\d[\d,.]+[BMKbmk%]?\s*\+?$') and coalesce(lower({ws}[1]), '') not in {sql_in(RULES.starters)}
      and list_bool_or([regexp_matches(w, '^\p{{Lu}}') for w in {ws}])
      and not (len({ws}) >= 3 and regexp_matches(array_to_string({ws}[2:], ' '), '{L}(?:{alts(RULES.connectives)}){R}')))"""


def pages(spark, sf):
    return text_table(spark, sf, "pages", "page_id")


@query(
    "page_candidate_names",
    "T16",
    rf"""with t as (select page_id, unnest(list_concat({inner("a")}, {inner("h[1-4]")}, {LINES_OF})) as nm from pages),
       u as (select distinct page_id, nm, {WORDS.format("nm")} as ws from t)
       select page_id, nm as name from u where {valid_sql("nm", "ws")}""",
)
def page_candidate_names(spark, sf):
    return pages(spark, sf).select(
        "page_id", F.explode(H.candidate_names("html", RULES)).alias("name")
    )


@query(
    "page_listed_names",
    "T17",
    rf"""with t as (select page_id, unnest([trim(regexp_replace(regexp_extract(x, '^([^:]*)', 1), '\([^)]*\)', '', 'g')) for x in {inner("li|p")}]) as nm from pages)
       select distinct page_id, nm as name from t where length(nm) between 3 and 80 and {sql_any("lower(nm)", ["tion", "keit", "ment"])} and not starts_with(lower(nm), 'the ')""",
)
def page_listed_names(spark, sf):
    names = H.listed_names("html", ["tion", "keit", "ment"], ["the "])
    return pages(spark, sf).select("page_id", F.explode(names).alias("name"))


@query(
    "board_line_firms",
    "T18",
    """select p_partkey, upper(p_name[1]) || p_name[2:] || ' Fund' as firm from part where p_size > 20 union all
       select p_partkey, null from part where p_size <= 20""",
)
def board_line_firms(spark, sf):
    firm = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000), F.lit(" Fund"))
    line = F.when(
        F.col("p_size") > 20, F.concat(F.lit("ANN "), "p_type", F.lit(" "), firm, F.lit(", Partner"))
    ).otherwise(F.concat(firm, F.lit(" news")))
    return table(spark, sf, "part").select(
        "p_partkey", H.firm_from_board_line(line, ["General Partner", "Partner"]).alias("firm")
    )


@query(
    "page_text",
    "T19",
    f"select page_id, md5({HTML_TEXT}) as digest, length({HTML_TEXT}) as n_chars from pages",
)
def page_text(spark, sf):
    return (
        pages(spark, sf)
        .select("page_id", html_text("html").alias("t"))
        .select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))
    )


@query("page_section_items", "T20")
def page_section_items(spark, sf):
    """Items inside sections named by class or id, from the tag walk."""
    marked = pages(spark, sf).select(
        "page_id",
        F.replace(
            F.replace(F.col("html"), F.lit("<article>"), F.lit('<article class="portfolio">')),
            F.lit("<nav>"),
            F.lit('<nav id="our-team">'),
        ).alias("html"),
    )
    return H.walk_sections(marked, "page_id", "html", ["team", "portfolio"], ["li", "h1", "p"])


TITLE_SQL = "trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))"


@query(
    "page_title_names",
    "T22",
    rf"""with t as (select page_id, trim(regexp_replace(string_split({TITLE_SQL}, ', ')[1], '\s+', ' ', 'g')) as a, trim(regexp_replace({TITLE_SQL}, '\s+', ' ', 'g')) as b,
           regexp_extract({HTML_TEXT}, '{X.EDGE}([A-Z][a-z]+ [a-z]+tion)', 1) as c, contains({TITLE_SQL}, ', ') as has from pages),
       u as (select page_id, unnest([a, c, b]) as nm, unnest([1, 2, 3]) as o, has from t),
       u1 as (select *, {WORDS.format("nm")} as w0 from u),
       u2 as (select page_id, o, has, case when len(w0) >= 4 and w0[1:len(w0) // 2] = w0[len(w0) // 2 + 1:len(w0)]
           then array_to_string(w0[1:len(w0) // 2], ' ') else nm end as nm from u1),
       v as (select page_id, o, nm, {WORDS.format("nm")} as ws from u2 where (o <> 1 or has)
         and not regexp_matches(nm, '(?i){L}(?:avec|para){R}')),
       w as (select page_id, o, nm from v where length(nm) >= 4 and len(ws) <= 6 and regexp_matches(nm, '^[\p{{Lu}}\p{{Nd}}]')
         and not (length(nm) > 40 and not list_has_any([lower(w) for w in ws], ['tion', 'ring', 'keit', 'mente', 'ment']))
         and not regexp_matches(nm, '(?i){L}(?:pour|das){R}') and not contains(lower(nm), 'http') and regexp_replace(lower(nm), 's+$', '') not in ('thing') and not starts_with(lower(nm), 'un '))
       select p.page_id, arg_min(w.nm, w.o) as name from pages p left join w on p.page_id = w.page_id group by p.page_id""",
)
def page_title_names(spark, sf):
    """First title part that validates, else the first pattern hit, else the title."""
    title = H.page_title("html")
    hit = F.regexp_extract(html_text("html"), X.EDGE + r"([A-Z][a-z]+ [a-z]+tion)", 1)
    part = F.when(title.contains(", "), F.get(F.split(title, ", "), F.lit(0)))
    rows = pages(spark, sf).select("page_id", F.array(part, hit, title).alias("options"))
    cleaned = F.transform("options", lambda t: N.clean_title_name(t, RULES, ["direx"]))
    valid = F.filter(cleaned, lambda t: t.isNotNull() & N.valid_headline_name(t, RULES))
    return rows.select("page_id", F.get(valid, F.lit(0)).alias("name"))


@query(
    "page_records",
    "T23",
    rf"""with t as (select page_id, url, {HTML_TEXT} as txt from pages),
       h as (select *, {sql_hits("lower(txt)", LEXICON)} as h from t)
       select page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) as website,
         'm_' || left(md5(lower(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\.', ''))), 12) as id,
         coalesce(list_max(h).cls, 'caller') as sector, array_to_string([r.cls for r in list_reverse_sort(h)], ',') as sectors,
         case when contains(lower(txt), 'scum') then 'CA' when contains(lower(txt), 'keiten') then 'TX' end as hq_state,
         case when length(txt) > 50 then left(txt, 300) end as description,
         array_to_string(regexp_extract_all(txt, '{X.EMAIL}'), ';') as mails from h""",
)
def page_records(spark, sf):
    from lodeworks.functions.normalize import stable_id

    # The caller's sector stands in where the tagger finds none.
    rows = pages(spark, sf).select("page_id", "url", html_text("html").alias("txt"))
    rows = rows.withColumn("h", X.class_hits("txt", LEXICON))
    return rows.select(
        "page_id",
        site_root("url").alias("website"),
        stable_id([bare_host("url")]).alias("id"),
        X.primary_class(F.col("h"), "caller").alias("sector"),
        F.array_join(X.classes_by_hits(F.col("h")), ",").alias("sectors"),
        X.first_listed("txt", [("scum", "CA"), ("keiten", "TX")]).alias("hq_state"),
        X.lead_description("txt").alias("description"),
        F.array_join(X.all_matches("txt", X.EMAIL), ";").alias("mails"),
    )


