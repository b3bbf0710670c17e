"""Validation and merge operators over nested results built from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions.exprs import str_array
from lodeworks.operators import validate as V
from lodeworks.plans.filtering import WORDS
from lodeworks.plans.normalising import SHORT
from lodeworks.plans.registry import query, table, text_table

ALLOWED = V.Allowed(
    types=["SMALL", "LARGE"],
    stages=["red", "blue", "hot"],
    sectors=["bolt", "gear", "ring"],
    geo=["global"],
    models=["b2b"],
    team=["phd"],
    lead=["both"],
    refusals=["cannot find"],
    domains=[".com", ".io"],
    title_starts=["managing partner"],
    fragments=["partner 1"],
)


def raw_results(spark, sf):
    """One messy payload per part, parsed back from JSON text with an explicit schema."""
    size, name = F.col("p_size"), F.split("p_name", " ")
    null = F.lit(None).cast("string")

    def partner(who, link, email):
        return F.struct(who.alias("name"), F.lit("GP").alias("title"), link.alias("linkedin_url"), email.alias("email"))

    payload = F.struct(
        F.struct(
            F.when(size % 9 == 0, False).when(size % 9 != 1, True).alias("is_real_investor"),
            F.when(size % 2 == 0, "not a fund").alias("rejection_reason"),
            F.lit(" https://x.com ").alias("official_website"),
            F.col("p_type").alias("investor_type"),
        ).alias("verification"),
        F.struct(
            F.array(name[0]).alias("stages"),
            F.array(name[1]).alias("sectors"),
            F.when(size % 3 == 0, str_array(["global", "mars"])).alias("geo_focus"),
            F.when(size % 4 != 0, F.concat(F.lit("$"), (size * 1000).cast("string"))).alias("check_size_min_usd"),
            F.when(size % 5 != 0, (F.lit(20) * size * size * 100).cast("string")).alias("check_size_max_usd"),
            F.when(size % 2 == 0, F.create_map(F.lit("stages"), F.lit("site"))).alias("evidence"),
        ).alias("tier1"),
        F.struct(
            F.when(size % 7 == 0, "too short")
            .when(size % 7 == 1, F.concat(F.lit("We cannot find anything about this firm on the open web: "), "p_name"))
            .when(size % 7 == 2, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(120)))
            .otherwise(F.concat(F.lit("A thesis that is easily longer than fifty characters about "), "p_name"))
            .alias("thesis_text"),
            F.when(size % 2 == 0, str_array(["b2b", "zzz"])).alias("business_model_preference"),
            F.when(size % 3 == 0, "both").otherwise("none").alias("lead_investor"),
            F.struct(F.when(size % 4 == 1, True).alias("pre_revenue_ok")).alias("traction_requirement"),
            F.struct(F.when(size % 4 == 2, 5.0).otherwise(0.0).alias("min_pct")).alias("ownership_target"),
            F.transform(
                F.sequence(F.lit(1), F.pmod(size, F.lit(7)) + 1),
                lambda i: F.struct(
                    F.when(i != 2, F.concat(F.lit("c"), i.cast("string"))).alias("name"), name[1].alias("sector")
                ),
            ).alias("portfolio_companies"),
        ).alias("tier2"),
        F.struct(
            F.when(size % 4 == 0, "https://x.com/apply").when(size % 4 == 1, "x.com").when(size % 4 == 2, "http://a b").alias("submission_url"),
            F.when(size % 3 == 0, "a@x.com").when(size % 3 == 1, "x.io").otherwise("a@x.zz").alias("general_email"),
            F.array(
                partner(F.lit("Ann Lee"), F.when(size % 2 == 0, "https://linkedin.com/in/ann"), F.lit("ann")),
                partner(F.lit("Partner 1"), null, null),
                partner(F.when(size % 5 == 0, "Bo (B) Ray").otherwise("Bo Ray"), F.lit("linkedin.com/in/bo"), F.lit("bo@x.com")),
            ).alias("partner_contacts"),
        ).alias("contacts"),
    )
    text = F.when(size % 13 == 0, F.lit("no json")).otherwise(F.to_json(payload))
    # A row costs much more than its bytes: spread over the cores, also where the table is one small file.
    return text_table(spark, sf, "part", "p_partkey").select(
        "p_partkey", F.from_json(text, V.PAYLOAD).alias("r")
    ).select("p_partkey", "r.*")


def results(spark, sf):
    return V.validate(raw_results(spark, sf), ALLOWED)


BASE = f"""with b as (select *, string_split(p_name, ' ')[1] as w1, string_split(p_name, ' ')[2] as w2, p_size % 13 = 0 as bad, p_size % 9 = 0 as rej from part),
   n as (select *, case when not bad and p_size % 4 <> 0 then p_size * 1000 end as lo0, case when not bad and p_size % 5 <> 0 then p_size * p_size * 2000 end as hi0 from b),
   v as (select *, case when coalesce(lo0 > hi0, false) or coalesce(hi0 / lo0::double > 50, false) then null else lo0 end as lo,
       case when coalesce(lo0 > hi0, false) or coalesce(hi0 / lo0::double > 50, false) then null else hi0 end as hi,
       not bad and w1 in ('red', 'blue', 'hot') as st, not bad and w2 in ('bolt', 'gear', 'ring') as se, not bad and p_size % 3 = 0 as ge,
       case when bad then null when p_size % 7 = 0 then null when p_size % 7 = 1 then null when p_size % 7 = 2 then trim(repeat(p_name || ' ', 120))
         else 'A thesis that is easily longer than fifty characters about ' || p_name end as th,
       not bad and p_size % 2 = 0 as bm, not bad and p_size % 3 = 0 as ld, not bad and p_size % 4 = 1 as tr, not bad and p_size % 4 = 0 as url, not bad and p_size % 3 = 0 as mail,
       case when bad then 0 else p_size % 7 + 1 - case when p_size % 7 >= 1 then 1 else 0 end end as np,
       case when bad then 0 when p_size % 2 = 0 then 1 else 0 end + case when bad or p_size % 5 = 0 then 0 else 1 end as nl from n),
   w as (select *, st::int * 25 + se::int * 25 + (lo is not null or hi is not null)::int * 25 + ge::int * 25 as t1,
       (coalesce(len({WORDS.format("th")}), 0) >= 200)::int * 35 + bm::int * 15 + tr::int * 15 + ld::int * 20 + (np >= 5)::int * 15 as t2 from v)"""


@query(
    "validate_results",
    "V1 V4 V5 V7 U5 F21",
    BASE
    + f""" select p_partkey, case when bad then 'failed' when rej then 'rejected' else 'enriched' end as status,
       case when not bad and rej then case when p_size % 2 = 0 then 'not a fund' else 'flagged as non-investor by model' end end as reason,
       case when not bad and p_type in ('SMALL', 'LARGE') then p_type end as kind, case when st then w1 end as stages, case when se then w2 end as sectors,
       cast(lo as bigint) as lo, cast(hi as bigint) as hi, md5(th) as thesis, case when np > 0 then np end as n_companies, t1, t2,
       case when t1 >= 75 and not bad and p_size % 2 = 0 then 'high' when t1 >= 50 then 'medium' else 'low' end as overall,
       case when {SHORT.format("lo")} is not null and {SHORT.format("hi")} is not null then {SHORT.format("lo")} || '–' || {SHORT.format("hi")}
         when {SHORT.format("lo")} is not null then {SHORT.format("lo")} || '+' when {SHORT.format("hi")} is not null then 'up to ' || {SHORT.format("hi")} end as shown from w""",
)
def validate_results(spark, sf):
    return results(spark, sf).select(
        "p_partkey",
        "status",
        F.col("rejection_reason").alias("reason"),
        F.col("investor_type").alias("kind"),
        F.array_join("stages", ",").alias("stages"),
        F.array_join("sectors", ",").alias("sectors"),
        F.col("check_size_min_usd").alias("lo"),
        F.col("check_size_max_usd").alias("hi"),
        F.md5("thesis_text").alias("thesis"),
        F.size("portfolio_companies").alias("n_companies"),
        F.col("tier1_completeness").alias("t1"),
        F.col("tier2_completeness").alias("t2"),
        F.col("overall_confidence").alias("overall"),
        F.col("check_size_display").alias("shown"),
    )


@query(
    "validate_contacts",
    "V2 V3 F12",
    BASE
    + """ select p_partkey, case when url then 'https://x.com/apply' end as url, case when mail then 'a@x.com' end as email,
       case when bad then '' else array_to_string(list_filter([case when p_size % 3 = 2 then 'invalid_email_format' end, case when p_size % 3 = 1 then 'invalid_email_no_at' end,
         'placeholder_partner_name:Partner 1', case when p_size % 5 = 0 then 'placeholder_partner_name:Bo (B) Ray' end,
         case when p_size % 4 = 1 then 'invalid_submission_url' end, case when p_size % 4 = 2 then 'dirty_submission_url' end], lambda f: f is not null), ',') end as flags,
       case when bad then '' else 'Ann Lee/' || (p_size % 2 = 0) || case when p_size % 5 <> 0 then ';Bo Ray/true' else '' end end as partners,
       url::int * 30 + (nl >= 1)::int * 40 + (nl >= 2)::int * 20 + mail::int * 10 as completeness from w""",
)
def validate_contacts(spark, sf):
    shown = F.transform(
        "partner_contacts",
        lambda p: F.concat_ws("/", p["name"], p["linkedin_url"].isNotNull().cast("string")),
    )
    return results(spark, sf).select(
        "p_partkey",
        F.col("submission_url").alias("url"),
        F.col("general_email").alias("email"),
        F.array_join("contact_flags", ",").alias("flags"),
        F.array_join(shown, ";").alias("partners"),
        F.col("contacts_completeness").alias("completeness"),
    )


@query(
    "missing_fields",
    "V6",
    BASE
    + """ select p_partkey, array_to_string(list_filter([case when not st then 'stages' end, case when not se then 'sectors' end, case when lo is null and hi is null then 'check_size' end,
       case when not ge then 'geo_focus' end, case when th is null then 'thesis_text' end, case when not ld then 'lead_investor' end, case when not bm then 'business_model' end,
       case when not tr then 'traction' end, case when not url then 'submission_url' end, case when bad then 'partner_contacts' end], lambda f: f is not null), ',') as missing from w""",
)
def missing_fields(spark, sf):
    return results(spark, sf).select("p_partkey", F.array_join("missing_fields", ",").alias("missing"))


@query(
    "result_lanes",
    "V7 U5 S10",
    BASE
    + """ select case when bad then 'failed' when rej then 'rejected' else 'enriched' end as status, count(*) as n_rows,
       count(*) filter (where not bad) as n_done, round(avg(t1), 3) as mean_t1 from w group by 1""",
)
def result_lanes(spark, sf):
    # Failed rows are not marked done, so the next run retries only them.
    return (
        results(spark, sf)
        .groupBy("status")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("status") != "failed").alias("n_done"),
            F.round(F.avg("tier1_completeness"), 3).alias("mean_t1"),
        )
    )


@query(
    "merge_authoritative",
    "V8",
    BASE
    + """ select p_partkey as id, p_name as name, case when not bad and not rej then t1 else 0 end as t1,
       case when not bad and not rej then case when t1 >= 75 and p_size % 2 = 0 then 'high' when t1 >= 50 then 'medium' else 'low' end else 'low' end as overall from w""",
)
def merge_authoritative(spark, sf):
    original = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    good = results(spark, sf).filter("status = 'enriched'").select(
        F.col("p_partkey").alias("id"), F.lit("other").alias("name"), "tier1_completeness", "overall_confidence"
    )
    merged = V.merge_results(original, good)
    return merged.select(
        "id", "name", F.col("tier1_completeness").alias("t1"), F.col("overall_confidence").alias("overall")
    )


@query(
    "merge_by_policy",
    "V9 V10",
    """with o as (select doc_id, source, case when n_chars % 2 = 0 then lang end as lang from documents),
       f as (select doc_id, case when quality = 1 then 'found' else '' end as source, 'xx' as lang from labels)
       select o.doc_id, coalesce(nullif(f.source, ''), nullif(o.source, '')) as source, coalesce(nullif(o.lang, ''), nullif(f.lang, '')) as lang
       from o left join f on o.doc_id = f.doc_id""",
)
def merge_by_policy(spark, sf):
    old = table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("lang")
    )
    new = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "found").otherwise("").alias("source"), F.lit("xx").alias("lang")
    )
    joined = old.alias("old").join(new.alias("new"), "doc_id", "left")
    return joined.select(
        "doc_id", *V.merge_fields({"source": V.ALWAYS, "lang": V.IF_MISSING}, "old", "new")
    )


@query(
    "tag_write_back",
    "V11 J3 F21",
    """with d as (select doc_id, source, lang from documents), t as (select doc_id, case quality when 1 then ['Good', 'zzz'] else ['zzz'] end as tags from labels)
       select d.doc_id, array_to_string(case when t.doc_id is null then ['old'] else coalesce(nullif(list_filter([lower(x) for x in tags], lambda v: v in ('good', 'bad')), []), ['generalist']) end, ',') as tags
       from d left join t on d.doc_id = t.doc_id""",
)
def tag_write_back(spark, sf):
    from lodeworks.operators.filters import tags_or_default

    fresh = table(spark, sf, "labels").select(
        "doc_id",
        tags_or_default(
            F.when(F.col("quality") == 1, str_array(["Good", "zzz"])).otherwise(str_array(["zzz"])), ["good", "bad"]
        ).alias("sub_tags"),
    )
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(fresh, "doc_id", "left").select(
        "doc_id", F.array_join(F.coalesce("sub_tags", F.array(F.lit("old"))), ",").alias("tags")
    )


# --- merges by policy -----------------------------------------------------------------

NEWS = """select p_partkey as id, case when p_size % 4 = 0 then 'found' when p_size % 4 = 1 then '  ' end as website,
    case when p_size % 3 = 0 then 'general' else 'metal' end as sector, string_split(p_name, ' ')[1:2] as focus, case when p_size % 2 = 0 then 'NY' end as hq_state, 'Town' as hq_city,
    case when p_size % 5 <> 0 then repeat('d', p_size * 2) end as description, case when p_size % 7 = 0 then [p_brand] else cast([] as varchar[]) end as portfolio from part where p_partkey % 6 <> 0"""


def merge_sides(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey").alias("id")
    known = table(spark, sf, "part").select(
        key,
        F.concat(F.lit("old "), "p_brand").alias("website"),
        F.lit("kept").alias("sector"),
        F.array(F.lit("old")).alias("focus"),
        F.when(size > 25, "CA").otherwise("").alias("hq_state"),
        F.when(size > 25, "LA").alias("hq_city"),
        F.when(size > 40, "known").alias("description"),
        F.array(F.lit("old")).alias("portfolio"),
    )
    news = table(spark, sf, "part").filter("p_partkey % 6 <> 0").select(
        key,
        F.when(size % 4 == 0, "found").when(size % 4 == 1, "  ").alias("website"),
        F.when(size % 3 == 0, "general").otherwise("metal").alias("sector"),
        F.slice(F.split("p_name", " "), 1, 2).alias("focus"),
        F.when(size % 2 == 0, "NY").alias("hq_state"),
        F.lit("Town").alias("hq_city"),
        F.when(size % 5 != 0, F.repeat(F.lit("d"), size * 2)).alias("description"),
        F.when(size % 7 == 0, F.array("p_brand")).otherwise(str_array([])).alias("portfolio"),
    )
    return known, news


@query(
    "merge_policies",
    "V10",
    f"""with n as ({NEWS}), p as (select *, p_partkey as pid, 'old ' || p_brand as website0, case when p_size > 25 then 'CA' else '' end as st, case when p_size > 25 then 'LA' end as ct, case when p_size > 40 then 'known' end as ds from part)
       select pid as id, coalesce(nullif(trim(n.website), ''), website0) as website, case when n.sector <> 'general' then n.sector else 'kept' end as sector,
         array_to_string(case when n.sector <> 'general' then n.focus else ['old'] end, ',') as focus, case when st = '' then coalesce(n.hq_state, st) else st end as hq_state,
         case when st = '' then coalesce(n.hq_city, ct) else ct end as hq_city, coalesce(ds, case when length(n.description) > 50 then n.description end) as description,
         array_to_string(coalesce(nullif(n.portfolio, []), ['old']), ',') as portfolio from p left join n on n.id = pid""",
)
def merge_policies(spark, sf):
    """Found address and portfolio win, sectors as a group, places only where the state is open."""
    from lodeworks.operators import merge as G

    known, news = merge_sides(spark, sf)
    policies = [
        G.Policy("website", G.ALWAYS),
        G.Policy("sector", G.ALWAYS, group="sectors"),
        G.Policy("focus", G.ALWAYS, group="sectors"),
        G.Policy("hq_state", G.ALWAYS, group="place"),
        G.Policy("hq_city", G.ALWAYS, group="place"),
        G.Policy("description", G.IF_MISSING, longer_than=50),
        G.Policy("portfolio", G.ALWAYS),
    ]
    groups = {
        "sectors": lambda old, new: new("sector") != "general",
        "place": lambda old, new: old("hq_state").isNull(),
    }
    merged = G.merge_by_policies(known, news, "id", policies, groups)
    return merged.withColumns({c: F.array_join(c, ",") for c in ("focus", "portfolio")})


@query(
    "published_rows",
    "V8 N21",
    """with t as (select *, p_partkey % 3 <> 0 as hit, p_partkey % 3 = 1 as one, p_name || case when p_size > 20 then ' Inc' else '' end as nm from part)
       select p_partkey as id, nm as name, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') as display_name, case when one then p_size > 9 else true end as is_real_investor,
         case when hit then 'https://a.example' end as official_website, case when hit then p_type end as investor_type, cast(null as varchar) as confidence, case when one then 'seed|b' else null end as stages,
         cast(null as varchar) as sectors, cast(case when hit then p_size end as bigint) as check_size_min_usd, cast(null as varchar) as check_size_max_usd, cast(null as varchar) as check_size_display,
         cast(null as varchar) as geo_focus, case when one then 'thesis' end as thesis_text, cast(null as varchar) as business_model_preference, cast(null as varchar) as traction_requirement,
         cast(null as varchar) as team_background_preference, cast(null as varchar) as lead_investor, cast(null as varchar) as ownership_target, cast(null as varchar) as portfolio_companies,
         cast(null as varchar) as submission_url, cast(null as varchar) as general_email, '' as partner_contacts, case when one then 'url=' || p_brand else '' end as tier1_evidence, '' as tier2_evidence,
         case when one then p_size else 0 end as tier1_completeness, 0 as tier2_completeness, 0 as contacts_completeness, case when one then 'high' else 'low' end as overall_confidence,
         case when one then 'thesis_text' else '' end as missing_fields, '' as contact_flags, cast(null as varchar) as research_notes, 'now' as enriched_at from t""",
)
def published_rows(spark, sf):
    """All fields of the published row: a third of the rows have no result at all."""
    from lodeworks.functions import normalize as N
    from lodeworks.operators import merge as G

    one, size = F.col("p_partkey") % 3 == 1, F.col("p_size")
    parts = table(spark, sf, "part")
    original = parts.select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.when(size > 20, " Inc").otherwise("")).alias("name")
    )
    enriched = parts.filter("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("id"),
        F.lit("not the name").alias("name"),
        F.when(one, size > 9).alias("is_real_investor"),
        F.lit("https://a.example").alias("official_website"),
        F.col("p_type").alias("investor_type"),
        F.when(one, str_array(["seed", "b"])).alias("stages"),
        size.cast("bigint").alias("check_size_min_usd"),
        F.when(one, "thesis").alias("thesis_text"),
        F.when(one, F.create_map(F.lit("url"), F.col("p_brand"))).alias("tier1_evidence"),
        F.when(one, size).cast("int").alias("tier1_completeness"),
        F.when(one, "high").alias("overall_confidence"),
        F.when(one, str_array(["thesis_text"])).alias("missing_fields"),
    )

    def display(name, url):
        return N.display_name(
            name, url, null_names=[], prefixes=[], suffixes=[" Inc"], trailing=[], compounds=[], acronyms=[]
        )

    rows = G.merge_authoritative(original, enriched, display, now=F.lit("now"))
    pairs = F.transform(F.map_entries("tier1_evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    none = F.map_entries("tier2_evidence")
    return rows.withColumns(
        {
            **{c: F.array_join(c, "|") for c in ("stages", "partner_contacts", "missing_fields", "contact_flags")},
            "tier1_evidence": F.array_join(pairs, "|"),
            "tier2_evidence": F.array_join(F.transform(none, lambda e: e["key"]), "|"),
        }
    )


@query(
    "top_up_lanes",
    "V12",
    """select 'usual' as mode, doc_id, case when doc_id in (select doc_id from labels) then 'stored' else 'new ' || source end as result from documents
       union all select 'usual', doc_id, 'stored' from labels where doc_id not in (select doc_id from documents)
       union all select 'forced', doc_id, 'new ' || source from documents union all select 'forced', doc_id, 'stored' from labels where doc_id not in (select doc_id from documents)""",
)
def top_up_lanes(spark, sf):
    """Results of all rows: only those missing are computed, or all when forced."""
    from lodeworks.operators import merge as G

    rows = table(spark, sf, "documents").select("doc_id", "source")
    stored = table(spark, sf, "labels").select("doc_id", F.lit("stored").alias("result"))

    def compute(missing):
        return missing.select("doc_id", F.concat(F.lit("new "), "source").alias("result"))

    usual = G.top_up(rows, stored, "doc_id", compute)
    forced = G.top_up(rows, stored, "doc_id", compute, force=True)
    return usual.select(F.lit("usual").alias("mode"), "doc_id", "result").unionByName(
        forced.select(F.lit("forced").alias("mode"), "doc_id", "result")
    )
