"""Whole records of the builders, over nested rows made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.operators import records as R
from lodeworks.plans.normalising import MONEY, TITLE
from lodeworks.plans.registry import query, table

NOW = "2026-01-01T00:00:00Z"
STATES = ["NY", "CA", "TX"]
RULES = R.RecordRules(
    sectors=["fintech", "health"],
    sector_words={"metal": ["bolt", "gear"], "light": ["small", "ring"]},
    stage_words={"Seed": ["red", "#1"], "Growth": ["blue", "gear", "fund"]},
    focus_words=["scum", "Keiten"],
    states=STATES,
    acronyms=["LLC"],
    types_by_name={"venture capital": "vc", "pe": "private_equity"},
    types=["vc", "angel"],
    type_rules=[
        R.TypeRule("private_equity", flags=["7A.Q7A16", "big"]),
        R.TypeRule("vc", name_words=["bolt", "#11"]),
        R.TypeRule("growth", name_words=["ring", "#12"], gate="fund"),
        R.TypeRule("fund", gate="fund"),
    ],
    weights={"name": 10, "aum_usd": 20, "website": 20, "key_people": 15, "description": 15, "sectors": 10, "founded_year": 10},
    titles=["Partner", "Director"],
    portfolio_leads=[r"(?i)holdings include:?\s+([^.]{5,200})"],
    regions=[("keiten", "West"), ("scum", "East")],
    state_of_geo={"SMALL": "NY", "LARGE": "CA"},
    source_of_confidence={"high": "verified", "medium": "partial"},
)


def plain(df):
    """Lists as joined text, so that both engines print them alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.StructType):
                c = F.transform(c, lambda p: F.concat_ws(":", *[p[n] for n in f.dataType.elementType.names]))
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


@query(
    "records_clean",
    "N16",
    f"""with t as (select s_suppkey as k, s_suppkey % 6 as m, n_name, s_acctbal, s_name from supplier join nation on s_nationkey = n_nationkey),
       u as (select *, case when m = 0 then 'Supplier ' || k when m = 1 then 'ACME LLC' else s_name end as nm, case m when 0 then 'TX' when 1 then 'NY' end as st,
         case when s_acctbal >= 1 then cast(trunc(s_acctbal) as bigint) end as aum, case when m in (0, 2) then 1000000 end as lo, case when m in (0, 3) then 5000000 end as hi,
         case when m = 1 then ['fintech', 'health'] when m in (2, 3) then ['health'] else ['general'] end as secs,
         case when m = 1 then 'https://site.example' when m <> 3 then 'https://x' || k || '.com' end as web from t where m <> 5),
       v as (select *, case when m = 1 then 'Acme LLC' else nm end as name, {MONEY.format("aum::double")} as am, {MONEY.format("lo::double")} as a, {MONEY.format("hi::double")} as b from u)
       select k as row_id, case when m = 2 then 'given-' || k else 'm_' || left(md5(lower(name || coalesce(st, ''))), 12) end as id, name,
         left(regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), 80) as slug,
         case m when 0 then 'vc' when 1 then 'private_equity' when 2 then 'angel' else 'other' end as investor_type,
         case when m in (2, 3) then 'health' else 'general' end as sector, array_to_string(secs, '|') as sectors, case when m = 0 then 'seed|growth' else '' end as stage, case when m = 4 then 'a|b' else '' end as focus,
         'North America' as region, 'US' as hq_country, st as hq_state, case when m <> 4 then 'Nation_' || regexp_extract(n_name, '\\d+') end as hq_city, aum as aum_usd, am as aum_display,
         cast(lo as bigint) as check_size_min_usd, cast(hi as bigint) as check_size_max_usd,
         case when a is not null and b is not null then a || '–' || b when a is not null then a || '+' when b is not null then 'up to ' || b end as check_size_display,
         web as website, case when m = 0 then 'f' || k end as sec_filing_url, case when m = 0 then 'Ann:Partner' else '' end as key_people,
         case when m = 1 then 'Bo:b@x.io:low' else '' end as contacts, case when m = 0 then 'p1|p2' else '' end as portfolio, case when m < 3 then 'about ' || k end as description,
         cast(case when m = 2 then 1999 end as bigint) as founded_year, cast(k as varchar) as sec_crd, case when m = 3 then '801-' || k end as sec_file_num,
         case when m = 0 then 'list' else 'unknown' end as data_source, case when m = 1 then 'high' else 'medium' end as data_confidence, true as us_verified, '{NOW}' as scraped_at,
         10 + case when aum is not null then 20 else 0 end + case when web is not null then 20 else 0 end + case when m = 0 then 15 else 0 end
           + case when m < 3 then 15 else 0 end + 10 + case when m = 2 then 10 else 0 end as completeness_score from v""",
)
def records_clean(spark, sf):
    """Raw rows of mixed quality: blank and shouted names, lists as text, default fields."""
    k, m = F.col("s_suppkey"), F.pmod("s_suppkey", F.lit(6))
    text = k.cast("string")

    def when(*numbers, then):
        return F.when(m.isin(*numbers), then)

    raw = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("row_id"),
            when(0, then=F.concat(F.lit("  Supplier  "), text)).when(m == 1, "ACME LLC").when(m == 5, "  ").otherwise(F.col("s_name")).alias("name"),
            when(2, then=F.concat(F.lit("given-"), text)).otherwise(" ").alias("id"),
            when(2, 3, then="health").when(m == 4, "unheard").alias("sector"),
            when(1, then="['fintech', 'health', 'x']").when(m == 3, "['x']").alias("sectors"),
            when(0, then='[" seed ", "growth"]').alias("stage"),
            when(4, then=F.array(F.lit(" a"), F.lit("b"), F.lit(" "))).alias("focus"),
            when(0, then="Venture Capital").when(m == 1, " PE ").when(m == 2, "angel").when(m == 3, "strange").alias("investor_type"),
            when(0, then=" tx").when(m == 1, "ny").when(m == 2, "Bavaria").alias("hq_state"),
            when(4, then="N/A").otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("hq_city"),
            F.col("s_acctbal").alias("aum_usd"),
            when(0, 2, then="$1,000,000").when(m == 1, "0").alias("check_size_min_usd"),
            when(0, 3, then=5_000_000).alias("check_size_max_usd"),
            when(1, then="HTTPS://Site.Example").when(m == 3, "none").alias("website"),
            when(0, 2, 4, then=F.concat(F.lit("x"), text, F.lit(".com"))).alias("source_url"),
            when(0, then=F.concat(F.lit("f"), text)).otherwise("").alias("sec_filing_url"),
            when(0, then=F.array(F.struct(F.lit(" Ann").alias("name"), F.lit("Partner ").alias("title")), F.struct(F.lit(" ").alias("name"), F.lit("x").alias("title")))).alias("key_people"),
            when(1, then=F.array(F.struct(F.lit("Bo").alias("name"), *[F.lit(None).cast("string").alias(n) for n in ("title", "phone", "linkedin", "confidence")], F.lit("b@x.io ").alias("email")))).alias("contacts"),
            when(0, then="['p1', 'p2', ' ']").alias("portfolio"),
            when(0, 1, 2, then=F.concat(F.lit(" about "), text)).otherwise(" ").alias("description"),
            when(2, then="1999").alias("founded_year"),
            k.alias("sec_crd"),
            when(3, then=F.concat(F.lit("801-"), text)).alias("sec_file_num"),
            when(0, then="list").alias("data_source"),
            when(1, then="high").alias("data_confidence"),
        )
    )
    return plain(R.clean_records(raw, RULES, now=F.lit(NOW), keep=["row_id"]))


SHARED = f"""cast(null as varchar) as description, '' as focus, 'North America' as region, 'US' as hq_country, true as us_verified, cast(null as bigint) as check_size_min_usd,
  cast(null as bigint) as check_size_max_usd, cast(null as bigint) as founded_year, '{NOW}' as scraped_at"""
SECTORS = """case when {0} > {1} then 'metal' when {1} > 0 and {0} = {1} then 'metal' when {1} > 0 then 'light' else 'general' end as sector,
  case when {0} > 0 and {1} > 0 then case when {1} > {0} then 'light|metal' else 'metal|light' end when {0} > 0 then 'metal' when {1} > 0 then 'light' else 'general' end as sectors"""
METAL, LIGHT = "(contains(lower({0}), 'bolt')::int + contains(lower({0}), 'gear')::int)", "(contains(lower({0}), 'small')::int + contains(lower({0}), 'ring')::int)"


def stages_sql(text):
    seed = f"(contains(lower({text}), 'red') or contains(lower({text}), '#1'))"
    growth = f"(contains(lower({text}), 'blue') or contains(lower({text}), 'gear') or contains(lower({text}), 'fund'))"
    return f"case when {seed} and {growth} then 'Seed|Growth' when {seed} then 'Seed' when {growth} then 'Growth' else 'Unknown' end"


@query(
    "records_adviser_filings",
    "N26 F17 T8",
    f"""with t as (select p_partkey as k, p_partkey % 7 as m, p_name, p_brand, p_size, cast(trunc(p_retailprice) as bigint) * 10000 as price from part),
       u as (select *, case when m = 1 then p_brand else p_name end as name, case m when 5 then 'BY' else ['NY', 'CA', 'TX'][1 + k % 3] end as st,
         case when m = 2 then null when p_size % 2 = 0 then price when m = 3 then cast(50 as bigint) end as aum, p_size > 40 as pe, p_size % 4 = 1 as fund8,
         case when m in (0, 6) then 'Fund gear|Fund two' else '' end as funds from t where m <> 4),
       w as (select *, pe or fund8 as fundy from u), x as (select * from w where st in ('NY', 'CA', 'TX') and not (not fundy and coalesce(aum < 5000000, false))),
       y as (select *, case when pe then 'private_equity' when contains(name, 'bolt') or contains(name, '#11') or contains(lower(name), '#11') then 'vc'
            when fundy and (contains(name, 'ring') or contains(lower(name), '#12')) then 'growth' when fundy then 'fund' else 'other' end as kind,
          name || case when funds = '' then ' ' else ' Fund gear Fund two' end as blob, case when m = 6 then '000080' || lpad(cast(k as varchar), 4, '0') when m = 3 then null else lpad('7' || k, 10, '0') end as cik from x),
       z as (select *, {METAL.format("blob")} as mh, {LIGHT.format("blob")} as lh from y)
       select k as row_id, 'sec_' || coalesce(cik, case when m = 3 then cast(k as varchar) end) as id, name, {SHARED}, kind as investor_type, {SECTORS.format("mh", "lh")},
         {stages_sql("blob || ' ' || kind")} as stage, st as hq_state, case when m = 0 then 'New York' else '' end as hq_city,
         case when m in (0, 1) then 'https://w' || k || '.com' when m = 2 then 'https://one.example' end as website, aum as aum_usd, cast(null as bigint) as fund_size_usd,
         case when m = 1 then 'Pat Doe:Contact' else '' end as key_people, funds as portfolio, cik as sec_cik, cast(k as varchar) as sec_crd, 'ADV' as sec_form_type,
         'https://filings.example.com/' || cik as sec_filing_url, 'sec_api' as data_source, 'high' as data_confidence from z""",
)
def records_adviser_filings(spark, sf):
    k, m, size = F.col("p_partkey"), F.pmod("p_partkey", F.lit(7)), F.col("p_size")
    text = k.cast("string")
    price = F.col("p_retailprice").cast("bigint") * 10000
    state = F.when(m == 5, " by").otherwise(F.get(F.array(*[F.lit(s.lower()) for s in STATES]), F.pmod(k, F.lit(3)).cast("int")))

    def fund(name):
        return F.struct(F.lit("").alias("FundName"), F.lit(name).alias("PrivFundNm"))

    nested = table(spark, sf, "part").select(
        k.alias("row_id"),
        F.struct(
            F.when(m == 1, "").when(m == 4, " ").otherwise(F.concat("p_name", F.lit(" "))).alias("BusNm"),
            F.when(m == 4, "").otherwise(F.col("p_brand")).alias("LegalNm"),
            k.alias("FirmCrdNb"),
            F.when(m == 6, F.concat(F.lit("80"), F.lpad(text, 4, "0"))).when(m != 3, F.concat(F.lit("7"), text)).alias("SECNb"),
        ).alias("Info"),
        F.struct(F.when(m == 2, "usa").otherwise("US").alias("Cntry"), state.alias("State"), F.when(m == 0, " NEW york").alias("City")).alias("MainAddr"),
        F.struct(
            F.struct(
                F.struct(
                    F.when(m == 2, F.lit(None)).when(size % 2 == 0, price).alias("TtlRgltrAst"),
                    F.when(m == 3, "50").otherwise("0").alias("AUM"),
                ).alias("Item5F"),
                F.struct(F.when(size % 4 == 1, "Y").otherwise("N").alias("Q8A1")).alias("Item8A"),
                F.struct(F.when(size > 40, "Y").alias("Q7A16"), F.lit("Y").alias("Q7A1")).alias("Item7A"),
                F.struct(
                    F.struct(
                        F.when(m.isin(0, 1), F.array(F.concat(F.lit("w"), text, F.lit(".com")), F.lit("z"))).alias("WebAddrs"),
                        F.when(m == 2, "HTTPS://ONE.example").alias("WebAddr"),
                    ).alias("WebAddrs"),
                    F.when(m == 1, "Pat Doe").alias("Q1F1Nm"),
                ).alias("Item1"),
            ).alias("Part1A")
        ).alias("FormInfo"),
        F.struct(F.when(m.isin(0, 6), F.array(fund("Fund gear"), fund(""), fund("Fund two"))).alias("Item7B")).alias("scheduleD"),
    )
    return plain(R.adviser_filings(nested, RULES, now=F.lit(NOW), keep=["row_id"]))


@query(
    "records_offerings",
    "N27",
    f"""with t as (select o_orderkey as k, o_orderkey % 5 as m, o_orderpriority as name, o_totalprice as v from orders),
       u as (select *, case when m = 1 then null else lpad(cast(k as varchar), 10, '0') end as cik, case when v >= 1 and m <> 2 then cast(trunc(v) as bigint) end as aum,
         {METAL.format("name")} as mh, {LIGHT.format("name")} as lh from t where m <> 4)
       select k as row_id, 'sec_d_' || coalesce(cik, replace(replace(left(name, 25), ' ', '_'), ',', '')) as id, name, {SHARED}, 'other' as investor_type, {SECTORS.format("mh", "lh")},
         {stages_sql("name")} as stage, ['NY', 'CA', 'TX'][1 + k % 3] as hq_state, case when m = 3 then 'Los Angeles' else '' end as hq_city, cast(null as varchar) as website, aum as aum_usd, aum as fund_size_usd,
         '' as key_people, '' as portfolio, cik as sec_cik, cast(null as varchar) as sec_crd, 'D' as sec_form_type, 'https://filings.example.com/' || cik as sec_filing_url,
         'sec_api' as data_source, 'medium' as data_confidence from u""",
)
def records_offerings(spark, sf):
    k, m = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(5))
    state = F.get(F.array(*[F.lit(f" {s.lower()}") for s in STATES]), F.pmod(k, F.lit(3)).cast("int"))
    nested = table(spark, sf, "orders").select(
        k.alias("row_id"),
        F.struct(
            F.concat(F.lit(" "), "o_orderpriority").alias("issuerName"),
            F.struct(F.when(m == 4, "X9").otherwise(state).alias("stateOrCountry"), F.when(m == 3, "LOS angeles ").alias("city")).alias("issuerAddress"),
        ).alias("issuerInfo"),
        F.struct(F.when(m == 2, "Indefinite").otherwise(F.col("o_totalprice").cast("string")).alias("totalOfferingAmount")).alias("offeringData"),
        F.when(m != 1, k.cast("string")).otherwise("").alias("cik"),
    )
    return plain(R.offering_filings(nested, RULES, now=F.lit(NOW), keep=["row_id"]))


@query(
    "records_bulk_rows",
    "N28 T8",
    f"""with t as (select p_partkey as k, p_partkey % 4 as m, p_name, p_size, p_retailprice as v from part),
       u as (select *, case when m <> 3 then lpad(cast(k as varchar), 10, '0') end as cik from t)
       select k as row_id, 'adv_' || k as id, {TITLE.format("lower(p_name)")} as name, {SHARED},
         case when p_size > 40 then 'private_equity' when contains(p_name, 'bolt') then 'vc' when p_size % 2 = 0 and contains(p_name, 'ring') then 'growth' when p_size % 2 = 0 then 'fund' else 'other' end as investor_type,
         case when m = 0 then 'health' else 'general' end as sector, case when m = 1 then 'fintech|health' when m = 0 then 'health' else 'general' end as sectors,
         {stages_sql("p_name")} as stage, case when m = 2 then '' else 'NY' end as hq_state, cast(null as varchar) as hq_city, case m when 0 then 'https://a.example' when 1 then 'HTTP://b.example' end as website,
         case when m = 0 then cast(trunc(v) as bigint) end as aum_usd, cast(null as bigint) as fund_size_usd, '' as key_people, '' as portfolio, cast(k as varchar) as sec_crd,
         case m when 3 then '' else '801-' || k end as sec_file_num, 'ADV' as sec_form_type, 'https://filings.example.com/' || cik as sec_filing_url, 'sec_adv_bulk' as data_source, 'high' as data_confidence from u""",
)
def records_bulk_rows(spark, sf):
    k, m, size = F.col("p_partkey"), F.pmod("p_partkey", F.lit(4)), F.col("p_size")
    rows = table(spark, sf, "part").select(
        k.alias("row_id"),
        k.alias("crd"),
        F.when(m == 3, "").otherwise(F.concat(F.lit("801-"), k.cast("string"))).alias("sec_nb"),
        F.upper("p_name").alias("name"),
        F.when(m == 0, " a.example ").when(m == 1, "HTTP://b.example").when(m == 2, "").alias("website"),
        F.when(m == 0, F.col("p_retailprice").cast("string")).when(m == 1, "0").when(m == 2, "nan").alias("aum_usd"),
        F.when(m != 2, "NY").alias("state"),
        F.when(m == 0, "health").alias("sector"),
        F.when(m == 1, F.array(F.lit("fintech"), F.lit("health"))).when(m == 2, F.array().cast("array<string>")).alias("sectors"),
        (size > 40).alias("is_big"),
        (size % 2 == 0).alias("is_fund"),
    )
    flags = {"big": F.col("is_big"), "fund": F.col("is_fund")}
    return plain(R.bulk_records(rows, RULES, flags, now=F.lit(NOW), keep=["row_id"]))


RAISED = "case when {0} >= 1e6 then '$' || printf('%.1f', round_even({0} / 1e6, 1)) || 'M' when {0} <> 0 then format('${{:,}}', cast({0} as bigint)) end"


@query(
    "records_profiles",
    "N29 N35",
    f"""with t as (select c_custkey as k, c_custkey % 5 as m, c_name, c_mktsegment as seg, n_name, r_name, floor(abs(c_acctbal)) as bal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
       u as (select *, {RAISED.format("(bal * 1000)")} as one, {RAISED.format("(bal * 2000)")} as two from t)
       select k as row_id, c_name as company_name, case when m = 0 then 'we ' || seg end as tagline, case when m <> 1 then seg end as funding_stage,
         case when m = 2 and bal > 0 then one || '–' || two when m in (0, 2) and bal > 0 then one when m = 3 then 'open' end as capital_need,
         case when m <> 4 then seg || ', ' || r_name end as sector, case when m = 3 then r_name else n_name || ', ' || r_name end as geography, case when m = 2 then 'vc' end as investor_type_preference,
         case m when 0 then true when 1 then false end as seeking_lead, 'equity' as instrument, case when m = 1 then 'b2b, saas' end as business_model, case when m = 2 then 'smb' end as customer_type,
         case when m <> 3 then bal end::double as arr_usd, cast(null as double) as mrr_usd, case when m = 0 then k end::bigint as paying_customers, m = 4 as pre_revenue, case when m = 1 then 'fast' end as key_traction,
         cast(null as varchar) as team_background, case when m = 0 then 'hiring' end as use_of_funds, case when m in (0, 1) then lower(seg) end as sub_sector_tags, 'story of ' || c_name as narrative_text,
         case when m = 0 then 0.5 else 0.0 end::double as overall_confidence, case when m = 4 then 'arr|team' else '' end as missing_signals from u""",
)
def records_profiles(spark, sf):
    k, m = F.col("c_custkey"), F.pmod("c_custkey", F.lit(5))
    value = F.floor(F.abs("c_acctbal")).cast("double")

    def leaf(v, kind="string"):
        return F.struct(v.cast(kind).alias("value"), F.lit("high").alias("confidence"))

    none = F.lit(None)
    words = "array<string>"
    nested = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("row_id"),
            F.col("c_name").alias("company_name"),
            F.when(m == 0, F.concat(F.lit("we "), "c_mktsegment")).alias("tagline"),
            F.struct(
                leaf(F.when(m != 1, F.col("c_mktsegment"))).alias("funding_stage"),
                F.struct(
                    F.when(m == 2, value * 1000).alias("value_min"),
                    F.when(m == 2, value * 2000).alias("value_max"),
                    F.when(m == 0, value * 1000).alias("value"),
                    F.when(m == 3, "open").alias("note"),
                ).alias("raise_amount_usd"),
                leaf(F.when(m != 4, F.array("c_mktsegment", "r_name")), words).alias("sector_tags"),
                F.struct(F.when(m == 3, "").otherwise(F.col("n_name")).alias("hq_city"), F.col("r_name").alias("hq_country")).alias("geo"),
                leaf(F.when(m == 2, F.array(F.lit("vc"))).otherwise(F.array()), words).alias("investor_type_preference"),
                leaf(F.when(m == 0, True).when(m == 1, False), "boolean").alias("seeking_lead"),
                F.lit("equity").alias("instrument"),
            ).alias("tier1"),
            F.struct(
                leaf(F.when(m == 1, F.array(F.lit("b2b"), F.lit("saas"))), words).alias("business_model"),
                leaf(F.when(m == 2, "smb")).alias("customer_type"),
                F.struct(
                    F.when(m != 3, value).alias("arr_usd"),
                    F.when(m == 0, k).alias("paying_customers"),
                    F.when(m == 4, True).when(m == 0, False).alias("pre_revenue"),
                    F.when(m == 1, "fast").alias("note"),
                ).alias("traction"),
                leaf(none, words).alias("team_background"),
                leaf(F.when(m == 0, "hiring")).alias("use_of_funds"),
                leaf(F.when(m.isin(0, 1), F.array(F.lower("c_mktsegment"))), words).alias("sub_sector_tags"),
            ).alias("tier2"),
            F.struct(F.concat(F.lit("story of "), "c_name").alias("narrative_text")).alias("tier3"),
            F.when(m == 0, 0.5).alias("overall_confidence"),
            F.when(m == 4, F.array(F.lit("arr"), F.lit("team"))).alias("missing_signals"),
        )
    )
    return plain(R.profile_records(nested, keep=["row_id"]))


@query(
    "records_browse",
    "N30",
    """with t as (select p_partkey as k, p_partkey % 4 as m, * from part)
       select k as row_id, case when m = 0 then 'Shown ' || p_name else p_name end as name, case when m = 1 then 'https://p.example' end as website, p_type as type,
         case when m <> 3 then case p_type when 'SMALL' then 'NY' when 'LARGE' then 'CA' end end as hq_state, case m when 0 then 'verified' when 1 then 'partial' else 'unverified' end as data_source,
         case when m = 0 then 'seed' end as stages, case when m = 2 then '' else replace(p_name, ' ', '|') end as sectors, case when m <> 2 then string_split(p_name, ' ')[1] end as sector,
         case when m <> 3 then p_type || '|any' else '' end as geo_focus, case when m = 1 then 'both' end as lead_investor, case when m = 2 then '$1M' end as check_size, cast(p_size as bigint) as check_size_min_usd,
         cast(case when m = 0 then p_size * 2 end as bigint) as check_size_max_usd, case when m <> 1 then 'thesis ' || p_name || repeat(' and more', 50) end as description,
         case when m = 0 then 'Ann:GP|Bo' end as key_people, case when p_size > 10 then p_brand end as portfolio, cast(case when m = 3 then 0 else p_size end as bigint) as completeness_score,
         cast(0 as bigint) as tier2_completeness, cast(7 as bigint) as contacts_completeness, case when m = 1 then 'https://p.example/apply' end as submission_url, cast(null as varchar) as general_email from t""",
)
def records_browse(spark, sf):
    k, m = F.col("p_partkey"), F.pmod("p_partkey", F.lit(4))
    none = F.lit(None).cast("string")

    def person(name, title):
        return F.struct(F.lit(name).alias("name"), F.lit(title).cast("string").alias("title"), F.lit("x").alias("email"))

    firms = table(spark, sf, "part").select(
        k.alias("row_id"),
        F.when(m == 0, F.concat(F.lit("Shown "), "p_name")).otherwise("").alias("display_name"),
        F.col("p_name").alias("name"),
        F.when(m == 1, "https://p.example").alias("official_website"),
        F.col("p_type").alias("investor_type"),
        F.when(m != 3, F.array("p_type", F.lit("any"))).alias("geo_focus"),
        F.when(m == 0, "high").when(m == 1, "medium").when(m == 2, "odd").alias("overall_confidence"),
        F.when(m == 0, F.array(F.lit("seed"))).alias("stages"),
        F.when(m != 2, F.split("p_name", " ")).alias("sectors"),
        F.when(m == 1, "both").alias("lead_investor"),
        F.when(m == 2, "$1M").alias("check_size_display"),
        F.col("p_size").cast("bigint").alias("check_size_min_usd"),
        F.when(m == 0, F.col("p_size") * 2).cast("bigint").alias("check_size_max_usd"),
        F.when(m == 1, "").otherwise(F.concat(F.lit("thesis "), "p_name", F.repeat(F.lit(" and more"), F.lit(50)))).alias("thesis_text"),
        F.when(m == 0, F.array(person("Ann", "GP"), person("", "x"), person("Bo", None))).alias("partner_contacts"),
        F.array(F.struct(F.when(F.col("p_size") > 10, F.col("p_brand")).alias("name"))).alias("portfolio_companies"),
        F.when(m != 3, F.col("p_size")).cast("bigint").alias("tier1_completeness"),
        F.lit(7).cast("bigint").alias("contacts_completeness"),
        F.when(m == 1, "https://p.example/apply").otherwise(none).alias("submission_url"),
    )
    return plain(R.browse_records(firms, RULES, keep=["row_id"]))


BODY = "(coalesce(text, '') || case when doc_id % 3 = 0 then ' Ann Lee, Partner. Founded in ' || (1950 + doc_id % 90) || '. Holdings include: Alpha, Beta Co, A.' else '' end)"
PERSON = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]{1,20}(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]{1,20})\s*[,\-–]?\s*(Partner|Director)"


@query(
    "records_pages",
    "T23",
    rf"""with t as (select doc_id as k, {BODY} as body, case when doc_id % 5 <> 0 then 'About ' || source end as title, doc_id % 3 = 0 as told, doc_id from documents where doc_id % 5 <> 0 or doc_id % 2 = 0),
       u as (select *, body || ' ' || coalesce(title, '') as whole, trim(regexp_replace(body, '\s+', ' ', 'g')) as flat,
         regexp_extract_all(body, '{PERSON}', 1) as nms, regexp_extract_all(body, '{PERSON}', 2) as tts from t),
       v as (select *, list_filter([{{'n': trim(regexp_replace(nms[i], '\s+', ' ', 'g')), 't': tts[i]}} for i in range(1, len(nms) + 1)], lambda p: len(string_split(p.n, ' ')) between 2 and 4) as ps,
         regexp_extract_all(whole, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:founded|established|since)\s+(?:in\s+)?(\d{{4}})(?:$|[^\p{{L}}\p{{N}}_])', 1) as ys,
         flatten([list_filter([trim(x) for x in string_split(m, ',')], lambda x: length(x) between 2 and 40)[1:5] for m in regexp_extract_all(body, '(?i)holdings include:?\s+([^.]{{5,200}})', 1)]) as hs from u)
       select k as row_id, 'Firm ' || k as name, case when length(flat) > 50 then left(flat, 300) end as description,
         case when contains(lower(whole), 'red') or contains(lower(whole), '#1') then 'Seed' when contains(lower(whole), 'blue') or contains(lower(whole), 'gear') or contains(lower(whole), 'fund') then 'Growth' end as stage,
         case when contains(lower(whole), 'keiten') then 'West' when contains(lower(whole), 'scum') then 'East' end as region,
         case when contains(lower(whole), 'keiten') and contains(lower(whole), 'scum') then 'Keiten|scum' when contains(lower(whole), 'keiten') then 'Keiten' when contains(lower(whole), 'scum') then 'scum' else '' end as focus,
         'asked' as sector, array_to_string([p.n || ':' || p.t for p in list_filter(ps, lambda p, i: list_position([lower(q.n) for q in ps], lower(p.n)) = i)[1:8]], '|') as key_people,
         array_to_string(list_filter(hs, lambda x, i: list_position(hs, x) = i)[1:15], '|') as portfolio, case when cast(ys[1] as integer) between 1970 and 2026 then cast(ys[1] as integer) end as founded_year,
         case when k % 2 = 0 then 'https://site' || k || '.example' else 'odd address' end as website, case when k % 2 = 0 then 'https://site' || k || '.example/a?b' else 'odd address' end as source_url, '{NOW}' as scraped_at from v""",
)
def records_pages(spark, sf):
    k = F.col("doc_id")
    told = F.concat(
        F.lit(" Ann Lee, Partner. Founded in "), (F.pmod(k, F.lit(90)) + 1950).cast("string"), F.lit(". Holdings include: Alpha, Beta Co, A.")
    )
    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.pmod(k, F.lit(3)) == 0, told).otherwise(""))
    even = F.pmod(k, F.lit(2)) == 0
    found = table(spark, sf, "documents").select(
        k.alias("row_id"),
        body.alias("text"),
        F.when(F.pmod(k, F.lit(5)) != 0, F.concat(F.lit("About "), "source")).alias("title"),
        F.when(even, F.concat(F.lit("https://site"), k.cast("string"), F.lit(".example/a?b"))).otherwise("odd address").alias("url"),
    )
    named = F.when((F.pmod("row_id", F.lit(5)) != 0) | (F.pmod("row_id", F.lit(2)) == 0), F.concat(F.lit("Firm "), F.col("row_id").cast("string")))
    return plain(R.page_records(found, RULES, named, F.lit("asked"), now=F.lit(NOW), keep=["row_id"]))
