"""Column normalisers bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import names as M
from lodeworks.functions import normalize as N
from lodeworks.functions.exprs import positive_int, safe_int, title_case, trimmed, whole_amount
from lodeworks.functions.web import bare_host, flattened_url, normalize_url, prefixed_url, site_root
from lodeworks.plans.filtering import LINES, WORDS, text_lines
from lodeworks.plans.registry import query, sql_in, table, text_table

TITLE = (
    "array_to_string([upper(w[1]) || lower(w[2:]) for w in regexp_extract_all({0}, '([\\p{{L}}]+|[^\\p{{L}}]+)')], '')"
)


@query(
    "slug",
    "N1",
    r"""select doc_id, line_no, left(regexp_replace(regexp_replace(trim(regexp_replace(trim(lower(line)), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g'), '-+', '-', 'g'), 80) as slug
       from """ + LINES,
)
def slug(spark, sf):
    return text_lines(spark, sf).select("doc_id", "line_no", N.slug("line").alias("slug"))


MONEY = """case when {0} >= 1e9 then '$' || printf('%.1f', round_even({0} / 1e9, 1)) || 'B'
   when {0} >= 1e6 then '$' || printf('%.0f', round_even({0} / 1e6, 0)) || 'M'
   when {0} >= 1e3 then '$' || printf('%.0f', round_even({0} / 1e3, 0)) || 'K'
   when {0} <> 0 then '$' || printf('%.0f', round_even({0}, 0)) end"""


@query(
    "money_display",
    "N2",
    f"""with t as (select o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 10000 when o_orderstatus = 'P' then o_totalprice else 0 end as v from orders)
       select o_orderkey, {MONEY.format("v")} as shown from t""",
)
def money_display(spark, sf):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    v = F.when(status == "F", price * 10000).when(status == "P", price).otherwise(0)
    return table(spark, sf, "orders").select("o_orderkey", N.money(v).alias("shown"))


SHORT = """case when {0} >= 1000000000 then '$' || printf('%.1f', round_even({0} / 1e9, 1)) || 'B'
   when {0} >= 1000000 then '$' || (case when {0} % 1000000 = 0 then printf('%.0f', {0} / 1e6) else printf('%.1f', round_even({0} / 1e6, 1)) end) || 'M'
   when {0} >= 1000 then '$' || (case when {0} % 1000 = 0 then printf('%.0f', {0} / 1e3) else printf('%.1f', round_even({0} / 1e3, 1)) end) || 'K'
   when {0} is not null then '$' || {0} end"""


@query(
    "money_variants",
    "N2b",
    f"""with t as (select o_orderkey, cast(floor(o_totalprice) as bigint) * case when o_orderstatus = 'F' then 100 else 1 end as n from orders)
       select o_orderkey,
         case when n >= 1e9 then '$' || printf('%.2f', round_even(n / 1e9, 2)) || 'B' when n >= 1e6 then '$' || printf('%.1f', round_even(n / 1e6, 1)) || 'M'
           else format('${{:,}}', n) end as audit_style,
         {SHORT.format("n")} as short_style,
         case when n >= 1e6 then '$' || printf('%.1f', round_even(n / 1e6, 1)) || 'M' when n <> 0 then format('${{:,}}', n) end as profile_style from t""",
)
def money_variants(spark, sf):
    n = F.floor("o_totalprice").cast("bigint") * F.when(F.col("o_orderstatus") == "F", 100).otherwise(1)
    return table(spark, sf, "orders").select("o_orderkey", n.alias("n")).select(
        "o_orderkey",
        N.money_audit("n").alias("audit_style"),
        N.money_short("n").alias("short_style"),
        N.money_profile("n").alias("profile_style"),
    )


@query(
    "money_range",
    "N3",
    f"""with t as (select p_partkey, case when p_size > 10 then p_size * 100000 else 0 end as lo, case when p_size < 40 then p_size * 250000 end as hi from part),
       u as (select *, {MONEY.format("lo")} as a, {MONEY.format("hi")} as b, {SHORT.format("nullif(lo, 0)")} as sa, {SHORT.format("hi")} as sb from t)
       select p_partkey, case when a is not null and b is not null then a || '–' || b when a is not null then a || '+' when b is not null then 'up to ' || b end as shown,
         case when sa is not null and sb is not null then sa || '–' || sb when sa is not null then sa || '+' when sb is not null then 'up to ' || sb end as short from u""",
)
def money_range(spark, sf):
    size = F.col("p_size")
    lo = F.when(size > 10, size * 100000).otherwise(0)
    hi = F.when(size < 40, size * 250000)
    return table(spark, sf, "part").select(
        "p_partkey",
        N.money_range(lo, hi).alias("shown"),
        N.money_range(lo, hi, N.money_short).alias("short"),
    )


@query(
    "list_coercion",
    "N4",
    """select p_partkey, case when p_type = 'SMALL' then replace(p_name, ' ', '|') || ' 1' when p_type = 'LARGE' then trim(p_name)
         when p_type = 'PROMO' then '' else replace(p_name, ' ', '|') end as items from part""",
)
def list_coercion(spark, sf):
    # Members with blanks around them and digits.
    quoted = F.concat(
        F.lit("[' "), F.replace(F.col("p_name"), F.lit(" "), F.lit(" ', ' ")), F.lit(" 1', '  ']")
    )
    json = F.to_json(F.split("p_name", " "))
    raw = (
        F.when(F.col("p_type") == "SMALL", quoted)
        .when(F.col("p_type") == "LARGE", F.concat(F.lit(" "), "p_name", F.lit(" ")))
        .when(F.col("p_type") == "PROMO", F.lit(" "))
        .otherwise(json)
    )
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(N.list_of(raw), "|").alias("items")
    )


RAW_URL = """case when page_id % 5 = 0 then regexp_replace(url, '^https?:', '') when page_id % 5 = 1 then regexp_replace(url, '^https?://', '')
   when page_id % 5 = 2 then upper(url) when page_id % 5 = 3 and contains(url, 'utm') then ' N/A ' else ' ' || url || ' ' end"""


def raw_urls(spark, sf):
    """Addresses written the way messy sources write them."""
    kind, url = F.pmod("page_id", F.lit(5)), F.col("url")
    raw = (
        F.when(kind == 0, F.regexp_replace(url, "^https?:", ""))
        .when(kind == 1, F.regexp_replace(url, "^https?://", ""))
        .when(kind == 2, F.upper(url))
        .when((kind == 3) & url.contains("utm"), " N/A ")
        .otherwise(F.concat(F.lit(" "), url, F.lit(" ")))
    )
    return table(spark, sf, "pages").select("page_id", "url", raw.alias("raw"))


@query(
    "url_normalise",
    "N5",
    rf"""with t as (select page_id, trim({RAW_URL}) as s from pages),
       u as (select *, case when regexp_matches(lower(s), '^https?://') then s else 'https://' || s end as p from t)
       select page_id, case when s = '' or lower(s) in ('null', 'none', 'n/a', '-') then null
         when regexp_matches(lower(s), '^https?://') then lower(regexp_extract(s, '^([A-Za-z]+://[^/?#]+)', 1)) || regexp_extract(s, '^[A-Za-z]+://[^/?#]+(.*)$', 1)
         when starts_with(s, '//') then 'https:' || s else 'https://' || s end as clean,
         p as prefixed, regexp_extract(lower(p), '^(https?://)', 1) || regexp_replace(regexp_replace(lower(p), '^https?://+', ''), '/{{2,}}', '/', 'g') as flat from u""",
)
def url_normalise(spark, sf):
    return raw_urls(spark, sf).select(
        "page_id",
        normalize_url("raw").alias("clean"),
        prefixed_url("raw").alias("prefixed"),
        flattened_url("raw").alias("flat"),
    )


@query(
    "site_root",
    "N6",
    r"""select page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) as root,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\.', '') as host from pages""",
)
def site_root_query(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", site_root("url").alias("root"), bare_host("url").alias("host")
    )


@query(
    "name_case",
    "N8",
    f"""with t as (select doc_id, line_no, {WORDS.format("case when line_no % 2 = 0 then upper(regexp_replace(line, '[^A-Za-z ]', '', 'g')) else line end")} as ws from {LINES}),
       u as (select *, array_to_string(ws, ' ') as s from t)
       select doc_id, line_no, case when s = upper(s) and length(s) > 2 then array_to_string([case when w in ('THE', 'OF', 'LA') then w else upper(w[1]) || lower(w[2:]) end for w in ws], ' ') else s end as shown from u where not regexp_matches(s, 'ß')""",
)
def name_case(spark, sf):
    loud = F.upper(F.regexp_replace("line", "[^A-Za-z ]", ""))
    raw = F.when(F.pmod("line_no", F.lit(2)) == 0, loud).otherwise(F.col("line"))
    return (
        text_lines(spark, sf)
        .select("doc_id", "line_no", N.display_case(raw, ["THE", "OF", "LA"]).alias("shown"))
        .filter(~F.col("shown").contains("ß"))
    )


@query(
    "state_and_city",
    "N9",
    f"""with t as (select c_custkey, case when c_acctbal < 0 then ' n/a ' else replace(lower(n_name), '_', '-') || ' o''neil' end as ct, c_mktsegment as s
         from customer join nation on c_nationkey = n_nationkey)
       select c_custkey, case when upper(trim(s)) in ('BUILDING', 'HOUSEHOLD') then upper(trim(s)) end as state,
         case when lower(trim(ct)) not in ('null', 'none', 'n/a', '-') then {TITLE.format("trim(ct)")} end as city from t""",
)
def state_and_city(spark, sf):
    place = F.when(F.col("c_acctbal") < 0, " n/a ").otherwise(
        F.concat(F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")), F.lit(" o'neil"))
    )
    return (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            N.state("c_mktsegment", ["BUILDING", "HOUSEHOLD"]).alias("state"),
            N.city(place).alias("city"),
        )
    )


@query(
    "people_list",
    "N10",
    """select p_partkey, trim(p_name) || ':' || coalesce(case when p_size > 5 then p_type end, '')
         || case when p_size <= 30 then ';' || p_brand || ':' else '' end as people from part""",
)
def people_list(spark, sf):
    size = F.col("p_size")
    raw = F.array(
        F.struct(F.concat(F.lit(" "), "p_name").alias("name"), F.when(size > 5, F.col("p_type")).alias("title")),
        F.struct(F.when(size <= 30, F.col("p_brand")).otherwise(" ").alias("name"), F.lit(None).cast("string").alias("title")),
    )
    shown = F.transform(N.people(raw), lambda p: F.concat_ws(":", p["name"], p["title"]))
    return table(spark, sf, "part").select("p_partkey", F.array_join(shown, ";").alias("people"))


@query(
    "contact_list",
    "N11",
    """select s_suppkey, case when s_acctbal > 0 then s_name || '/low' else '' end
         || case when s_acctbal > 0 and s_suppkey % 2 = 0 then ';' else '' end
         || case when s_suppkey % 2 = 0 then '-/high' else '' end as contacts from supplier""",
)
def contact_list(spark, sf):
    none, key = F.lit(None).cast("string"), F.col("s_suppkey")

    def entry(name, email, confidence):
        return F.struct(
            name.alias("name"),
            F.lit("Partner").alias("title"),
            email.alias("email"),
            F.lit(" ").alias("phone"),
            none.alias("linkedin"),
            confidence.alias("confidence"),
        )

    raw = F.array(
        entry(F.when(F.col("s_acctbal") > 0, F.concat(F.lit(" "), "s_name")), F.lit(" "), none),
        entry(none, F.when(F.pmod(key, F.lit(2)) == 0, F.concat(key.cast("string"), F.lit("@x.com"))), F.lit("high")),
    )
    shown = F.transform(
        N.contacts(raw), lambda c: F.concat_ws("/", F.coalesce(c["name"], F.lit("-")), c["confidence"])
    )
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(shown, ";").alias("contacts"))


@query(
    "sector_list",
    "N12",
    """with t as (select p_partkey, p_type, list_filter(string_split(p_name, ' '), lambda w: w in ('red', 'blue', 'gear')) as k from part)
       select p_partkey, case when len(k) > 0 then array_to_string(k, ',') when p_type = 'PROMO' then p_type else 'general' end as sectors from t""",
)
def sector_list(spark, sf):
    out = N.sectors("p_type", F.split("p_name", " "), ["red", "blue", "gear", "PROMO"])
    return table(spark, sf, "part").select("p_partkey", F.array_join(out, ",").alias("sectors"))


@query(
    "safe_numbers",
    "N13",
    """with t as (select o_orderkey, case when o_orderstatus = 'F' then '$' || format('{:,}', cast(floor(o_totalprice) as bigint)) || '.75'
         when o_orderstatus = 'P' then o_orderpriority else '-' || o_orderkey end as raw from orders)
       select o_orderkey, cast(trunc(try_cast(regexp_replace(raw, '[,$]', '', 'g') as double)) as bigint) as whole,
         case when try_cast(regexp_replace(raw, '[,$]', '', 'g') as double) >= 1 then cast(trunc(try_cast(regexp_replace(raw, '[,$]', '', 'g') as double)) as bigint) end as positive from t""",
)
def safe_numbers(spark, sf):
    raw = (
        F.when(
            F.col("o_orderstatus") == "F",
            F.format_string("$%,d.75", F.floor("o_totalprice").cast("bigint")),
        )
        .when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit("-"), F.col("o_orderkey").cast("string")))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", safe_int(raw).alias("whole"), positive_int(raw).alias("positive")
    )


WEIGHTS = {"name": 30, "type": 25, "size": 20, "price": 40}


@query(
    "completeness_score",
    "N14",
    """select p_partkey, least(30 + case when p_type <> 'PROMO' then 25 else 0 end + case when p_size > 9 then 20 else 0 end
         + case when p_retailprice > 950 then 40 else 0 end, 100) as score from part""",
)
def completeness_score(spark, sf):
    filled = {
        "name": F.col("p_name") != "",
        "type": F.when(F.col("p_type") != "PROMO", True),
        "size": F.col("p_size") > 9,
        "price": F.col("p_retailprice") > 950,
    }
    return table(spark, sf, "part").select(
        "p_partkey", N.weighted_completeness(filled, WEIGHTS).alias("score")
    )


@query(
    "stable_ids",
    "N15",
    """select s_suppkey, 'm_' || left(md5(lower(s_name || case when s_acctbal > 0 then n_name else '' end)), 12) as id
       from supplier join nation on s_nationkey = n_nationkey""",
)
def stable_ids(spark, sf):
    place = F.when(F.col("s_acctbal") > 0, F.col("n_name"))
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", N.stable_id(["s_name", place]).alias("id"))
    )


@query(
    "clean_record",
    "N16",
    f"""with t as (select s_suppkey, upper(s_name) as nm, n_name, s_acctbal from supplier join nation on s_nationkey = n_nationkey)
       select upper(nm[1]) || lower(nm[2:]) as name, 'm_' || left(md5(lower(upper(nm[1]) || lower(nm[2:]) || n_name)), 12) as id,
         case when n_name in ('NATION_1', 'NATION_2') then 'fintech' else 'general' end as sector,
         case when s_acctbal >= 1 then cast(trunc(s_acctbal) as bigint) end as aum_usd,
         {MONEY.format("case when s_acctbal >= 1 then trunc(s_acctbal) end")} as aum_display,
         50 + case when n_name in ('NATION_1', 'NATION_2') then 30 else 0 end + case when s_acctbal >= 1 then 20 else 0 end as completeness from t""",
)
def clean_record(spark, sf):
    raw = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    name = N.display_case(F.upper("s_name"), ["LLC"])
    focused = F.col("n_name").isin("NATION_1", "NATION_2")
    rows = raw.select(
        name.alias("name"),
        F.when(focused, "fintech").otherwise("general").alias("sector"),
        positive_int("s_acctbal").alias("aum_usd"),
        F.col("n_name"),
    ).filter(F.col("name") != "")
    filled = {
        "name": F.col("name") != "",
        "sector": F.col("sector") != "general",
        "aum": F.col("aum_usd").isNotNull(),
    }
    return rows.select(
        "name",
        N.stable_id(["name", "n_name"]).alias("id"),
        "sector",
        "aum_usd",
        N.money("aum_usd").alias("aum_display"),
        N.weighted_completeness(filled, {"name": 50, "sector": 30, "aum": 20}).alias("completeness"),
    )


FULL = "p_name || case when p_size < 15 then ', Inc.' when p_size < 30 then ' Capital Management' else '' end"


@query(
    "legal_suffix_strip",
    "N17",
    """select p_partkey, case when p_size < 15 then p_name when p_size < 30 then p_name || ' Capital' else p_name end as name from part""",
)
def legal_suffix_strip(spark, sf):
    full = F.concat("p_name", F.when(F.col("p_size") < 15, ", Inc.").when(F.col("p_size") < 30, " Capital Management").otherwise(""))
    return table(spark, sf, "part").select(
        "p_partkey", N.drop_legal_suffix(full, [", LLC", ", Inc."], [" Management"]).alias("name")
    )


@query(
    "restore_acronyms",
    "N18",
    f"""select p_partkey, array_to_string([case w when 'Red' then 'RED' when 'Bolt' then 'BOLT' else w end
         for w in [upper(v[1]) || v[2:] for v in string_split(p_name, ' ')]], ' ') as name from part""",
)
def restore_acronyms(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", N.restore_acronyms(title_case("p_name"), ["RED", "BOLT"]).alias("name")
    )


@query(
    "split_compounds",
    "N19",
    """select p_partkey, p_name as name from part""",
)
def split_compounds(spark, sf):
    glued = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    nouns = ["ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod", "cog", "lever"]
    return table(spark, sf, "part").select("p_partkey", N.split_compounds(glued, nouns).alias("name"))


@query(
    "name_from_address",
    "N20",
    rf"""with t as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/?]*)', 1), '^www\.', ''), '\.[a-z]{{2,10}}$', ''), '\.[a-z]{{2,10}}$', ''), '[-_]', ' ', 'g') as s from pages)
       select page_id, case when trim(s) <> '' then {TITLE.format("s")} end as name from t""",
)
def name_from_address(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.name_from_address("url", [], []).alias("name"))


@query(
    "display_name",
    "N21",
    f"""with t as (select p_partkey, p_name as s, p_type from part)
       select p_partkey, case when s = 'red bolt' then null when starts_with(s, 'old ') then 'Thing'
         else array_to_string([case when upper(w[1]) || w[2:] = 'Hot' then 'HOT' else upper(w[1]) || w[2:] end for w in string_split(s, ' ')], ' ') end as name from t""",
)
def display_name(spark, sf):
    out = N.display_name(
        F.concat("p_name", F.lit(", Inc.")),
        F.lit("https://www.thing.example.com/x"),
        null_names=["red bolt, Inc."],
        prefixes=["old "],
        suffixes=[", Inc."],
        trailing=[],
        compounds=[],
        acronyms=["HOT"],
    )
    return table(spark, sf, "part").select("p_partkey", out.alias("name"))


RULES = M.NameRules(firm_words=["fund", "capital"], tagline_words=["of", "in"])


@query(
    "title_name_cleaner",
    "N22",
    """with t as (select p_partkey, p_name, p_size, p_type from part)
       select p_partkey, case when p_size < 15 then p_name when p_size < 20 then p_name || ' ' || p_name || ' east' when p_size < 30 then 'B1 Fund'
         when p_size < 40 then null when p_size < 45 then p_name || ' fund' else p_name end as name from t""",
)
def title_name_cleaner(spark, sf):
    size, name = F.col("p_size"), F.col("p_name")
    raw = (
        F.when(size < 10, F.concat(F.lit("About: "), name, F.lit(" - Direx profile")))
        .when(size < 15, F.concat_ws(" ", name, name))
        .when(size < 20, F.concat_ws(" ", name, name, F.lit("east")))
        .when(size < 30, F.concat(name, F.lit(" works at B1 Fund")))
        .when(size < 40, F.concat(name, F.lit(" of all things")))
        .when(size < 45, F.concat(name, F.lit("  fund | Start page")))
        .otherwise(F.concat(name, F.lit(" Home - welcome to all")))
    )
    cleaned = M.clean_title_name(raw, RULES, ["direx", "pitch"], ["about", "meet"], ["start page"])
    return text_table(spark, sf, "part", "p_partkey").select("p_partkey", cleaned.alias("name"))


@query(
    "listing_name_cleaner",
    "N23",
    """select p_partkey, case when p_size < 40 then upper(p_name[1]) || p_name[2:] || ' Fund' else 'Marie Blue Fund East' end as name from part""",
)
def listing_name_cleaner(spark, sf):
    size = F.col("p_size")
    name = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000), F.lit(" Fund"))
    raw = (
        F.when(size < 10, F.concat(name, F.lit("  12 shared")))
        .when(size < 20, F.concat(name, F.lit(" · Partner and more")))
        .when(size < 30, F.concat(name, F.lit(" - Long Words Here")))
        .when(size < 40, F.concat(F.lit("3. "), name, F.lit(" Website")))
        .otherwise("Ann Marie Blue Fund East")
    )
    cleaned = M.clean_listing_name(raw, ["General Partner", "Partner"], ["Website", "Blog"], ["fund"])
    return table(spark, sf, "part").select("p_partkey", cleaned.alias("name"))


@query(
    "manual_name_cleaner",
    "N24",
    """select p_partkey, p_name || ' fund' || case when p_size < 10 then ', Chief Buyer' else '' end as name from part""",
)
def manual_name_cleaner(spark, sf):
    size = F.col("p_size")
    name = F.concat("p_name", F.lit(" fund"))
    raw = (
        # A role behind a comma stays, one behind a dot goes.
        F.when(size < 10, F.concat(name, F.lit(", Chief Buyer")))
        .when(size < 20, F.concat(name, F.lit(" 4 shared")))
        .when(size < 40, F.concat(name, F.lit("·CHIEF buyer")))
        .otherwise(F.concat(name, F.lit(" fintech")))
    )
    cleaned = M.clean_manual_name(raw, ["·Chief Buyer", "·Buyer"], ["fund"], ["fintech"])
    return table(spark, sf, "part").select("p_partkey", cleaned.alias("name"))


@query(
    "dedup_name_keys",
    "N25",
    """with t as (select p_partkey, p_name, case when p_size < 25 then ', llc' else ' inc' end as sfx from part)
       select p_partkey, trim(replace(p_name || sfx, ' bolt', '')) as by_removal, p_name as by_suffix,
         replace(p_name, ' ', '') as by_words from t""",
)
def dedup_name_keys(spark, sf):
    full = F.concat("p_name", F.when(F.col("p_size") < 25, ", llc").otherwise(" inc"))
    return table(spark, sf, "part").select(
        "p_partkey",
        M.key_by_removal(full, [" bolt"]).alias("by_removal"),
        M.key_by_suffix(full, [", llc", " llc", " inc"]).alias("by_suffix"),
        M.key_alnum(full, ["llc", "inc"]).alias("by_words"),
    )


@query(
    "filing_flatten",
    "N26",
    """select s_suppkey, lpad(cast(s_suppkey as varchar), 10, '0') as filing_id, s_name as name, n_name as city,
         coalesce(case when s_acctbal > 5000 then cast(trunc(s_acctbal) as bigint) end, case when s_acctbal > 0 then cast(trunc(s_acctbal * 2) as bigint) end) as aum_usd,
         case when s_suppkey % 3 <> 0 then 'https://s' || s_suppkey || '.com' end as website,
         'Fund 1; Fund 2' as funds, 'https://filings.example.com/' || s_suppkey as filing_url
       from supplier join nation on s_nationkey = n_nationkey""",
)
def filing_flatten(spark, sf):
    """Nested filing rows (built from suppliers) back to flat records."""
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    nested = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.struct(
                F.struct(F.col("s_name").alias("BusNm"), key.alias("FirmCrdNb")).alias("Info"),
                F.struct(F.lit("US").alias("Cntry"), F.col("n_name").alias("City")).alias("MainAddr"),
                F.struct(
                    F.when(balance > 5000, balance).alias("Q5F2C"),
                    F.when(balance > 0, balance * 2).alias("Q5F2A"),
                ).alias("Item5F"),
                F.when(
                    F.pmod(key, F.lit(3)) != 0,
                    F.array(F.concat(F.lit("https://s"), key.cast("string"), F.lit(".com"))),
                ).alias("WebAddrs"),
                F.array(
                    F.struct(F.lit("Fund 1").alias("FundName")), F.struct(F.lit("Fund 2").alias("FundName"))
                ).alias("item7B"),
            ).alias("r")
        )
    )
    funds = F.slice(F.transform("r.item7B", lambda f: f["FundName"]), 1, 10)
    crd = F.col("r.Info.FirmCrdNb").cast("string")
    return nested.select(
        F.col("r.Info.FirmCrdNb").alias("s_suppkey"),
        F.lpad(crd, 10, "0").alias("filing_id"),
        F.trim("r.Info.BusNm").alias("name"),
        F.col("r.MainAddr.City").alias("city"),
        F.coalesce(whole_amount("r.Item5F.Q5F2C"), whole_amount("r.Item5F.Q5F2A")).alias("aum_usd"),
        F.get("r.WebAddrs", F.lit(0)).alias("website"),
        F.array_join(funds, "; ").alias("funds"),
        F.concat(F.lit("https://filings.example.com/"), crd).alias("filing_url"),
    )


@query(
    "offering_flatten",
    "N27",
    """select o_orderkey, trim(o_orderpriority) as issuer, case when o_totalprice >= 1 then cast(trunc(o_totalprice) as bigint) end as offered_usd,
         cast(year(o_orderdate) as integer) as founded_year from orders""",
)
def offering_flatten(spark, sf):
    nested = table(spark, sf, "orders").select(
        "o_orderkey",
        F.struct(
            F.struct(F.concat(F.lit(" "), "o_orderpriority").alias("entityName"), F.year("o_orderdate").alias("yearOfInc")).alias("issuerInfo"),
            F.struct(F.col("o_totalprice").cast("string").alias("totalOfferingAmount")).alias("offeringData"),
        ).alias("r"),
    )
    return nested.select(
        "o_orderkey",
        trimmed("r.issuerInfo.entityName").alias("issuer"),
        positive_int("r.offeringData.totalOfferingAmount").alias("offered_usd"),
        F.col("r.issuerInfo.yearOfInc").alias("founded_year"),
    )


@query(
    "csv_record",
    "N28",
    f"""with t as (select s_suppkey, lower(replace(s_name, '#', ' ')) as nm, '801-' || s_suppkey as sec, 's' || s_suppkey || '.com' as web from supplier)
       select {TITLE.format("nm")} as name, regexp_extract(sec, '^\\d{{3}}-(\\d+)$', 1) as cik, 'https://' || web as website from t""",
)
def csv_record(spark, sf):
    key = F.col("s_suppkey").cast("string")
    rows = table(spark, sf, "supplier").select(
        F.upper(F.replace(F.col("s_name"), F.lit("#"), F.lit(" "))).alias("name"),
        F.concat(F.lit("801-"), key).alias("sec_nb"),
        F.concat(F.lit("s"), key, F.lit(".com")).alias("web"),
    )
    return rows.select(
        title_case("name").alias("name"),
        F.regexp_extract("sec_nb", r"^\d{3}-(\d+)$", 1).alias("cik"),
        prefixed_url("web").alias("website"),
    )


@query(
    "profile_flatten",
    "N29 N35",
    f"""select c_custkey, coalesce(case when c_acctbal > 0 then c_mktsegment end, 'seed') as stage, c_mktsegment || ', ' || r_name as tags,
         case when c_acctbal > 0 then case when c_acctbal * 1000 >= 1e6 then '$' || printf('%.1f', round_even(floor(c_acctbal) * 1000 / 1e6, 1)) || 'M' else format('${{:,}}', cast(floor(c_acctbal) * 1000 as bigint)) end end as raise_display,
         n_name || ', ' || r_name as location
       from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal < 0 or c_acctbal >= 1""",
)
def profile_flatten(spark, sf):
    """Wrapped profile leaves ({value, confidence}) to flat columns."""
    wrapped = (
        table(spark, sf, "customer")
        .filter("c_acctbal < 0 or c_acctbal >= 1")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey",
            F.struct(
                F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("value")).alias("funding_stage"),
                F.struct(F.array("c_mktsegment", "r_name").alias("value")).alias("sector_tags"),
                F.struct(F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal") * 1000).alias("value")).alias("raise_amount"),
                F.struct(F.col("n_name").alias("hq_city"), F.col("r_name").alias("hq_country")).alias("geo"),
            ).alias("p"),
            F.lit("seed").alias("funding_stage"),
        )
    )
    return wrapped.select(
        "c_custkey",
        F.coalesce("p.funding_stage.value", "funding_stage").alias("stage"),
        F.array_join("p.sector_tags.value", ", ").alias("tags"),
        N.money_profile("p.raise_amount.value").alias("raise_display"),
        F.concat_ws(", ", "p.geo.hq_city", "p.geo.hq_country").alias("location"),
    )


@query(
    "browse_row",
    "N30",
    """select p_partkey, case p_type when 'SMALL' then 'NY' when 'LARGE' then 'CA' end as hq_state, string_split(p_name, ' ')[1] as sector,
         left('thesis ' || p_name || repeat(' and more', 50), 300) as description, nullif(case when p_size > 10 then p_brand else '' end, '') as portfolio from part""",
)
def browse_row(spark, sf):
    from lodeworks.functions.exprs import lookup, nonempty

    thesis = F.concat(F.lit("thesis "), "p_name", F.repeat(F.lit(" and more"), F.lit(50)))
    geo = F.array("p_type", F.lit("global"))
    companies = F.array(F.when(F.col("p_size") > 10, F.struct(F.col("p_brand").alias("name"))))
    named = F.transform(F.array_compact(companies), lambda c: c["name"])
    return table(spark, sf, "part").select(
        "p_partkey",
        lookup({"SMALL": "NY", "LARGE": "CA"}, F.get(geo, F.lit(0))).alias("hq_state"),
        F.get(F.split("p_name", " "), F.lit(0)).alias("sector"),
        F.left(thesis, F.lit(300)).alias("description"),
        nonempty(F.array_join(named, "; ")).alias("portfolio"),
    )


@query(
    "summary_line",
    "N31",
    """select p_partkey, p_brand || '(' || p_type || '), other | ' || p_name as summary from part""",
)
def summary_line(spark, sf):
    companies = F.array(
        F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("sector")),
        F.struct(F.lit("other").alias("name"), F.lit(None).cast("string").alias("sector")),
    )
    return table(spark, sf, "part").select("p_partkey", N.summary_line(companies, "p_name").alias("summary"))


@query(
    "label_prefix",
    "N32",
    """select o_orderkey, case when starts_with(o_orderpriority, '1-URGENT') then '1-URGENT' when starts_with(o_orderpriority, '4-NOT') then '4-NOT'
         else coalesce(case regexp_extract(o_orderpriority, '^([^_\\s]+)', 1) when '5-LOW' then 'low' end, regexp_extract(o_orderpriority, '^([^_\\s]+)', 1)) end as prefix from orders""",
)
def label_prefix(spark, sf):
    out = N.sector_prefix("o_orderpriority", ["1-URGENT", "4-NOT", "1"], {"5-LOW": "low"})
    return table(spark, sf, "orders").select("o_orderkey", out.alias("prefix"))


@query(
    "trim_to_null",
    "N33",
    """select o_orderkey, nullif(trim(case when o_orderstatus = 'P' then '  ' else ' ' || o_orderpriority end), '') as text, cast(o_custkey as varchar) as cust from orders""",
)
def trim_to_null(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return table(spark, sf, "orders").select(
        "o_orderkey", trimmed(raw).alias("text"), trimmed("o_custkey").alias("cust")
    )


@query(
    "embeddable_text",
    "N34",
    """select conv_id, turn, md5(case when length(trim(coalesce(nullif(case when role = 'user' then '' else text end, ''), text))) >= 20
         then coalesce(nullif(case when role = 'user' then '' else text end, ''), text) end) as digest from conversations""",
)
def embeddable_text(spark, sf):
    first = F.when(F.col("role") == "user", "").otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(N.embeddable(first, "text")).alias("digest")
    )
