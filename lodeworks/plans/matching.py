"""The matcher bound to customers (profiles) and parts (firms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions.exprs import str_array
from lodeworks.operators import match as M
from lodeworks.plans.registry import query, table, text_table

STOP = ["with", "that", "back"]
VOCAB = M.MatchVocab(
    synonyms={"africa": "south", "tiny": "small"},
    domains=[
        M.Domain("hard", ["south", "asia"], ["anvil", "plate"], ["bolt", "gear"], ["small"]),
        M.Domain("soft", ["europe", "america"], ["rod"], ["ring"], ["blue"]),
    ],
    city_tags={"nation_1": "metro", "nation_2": "coast", "nation_3": "metro"},
    portfolio_tags=[("brand#1", "ring"), ("small", "gear"), ("anvil", "red")],
    indications={"tiny": ["small", "gear"], "hot": ["hot", "ring"]},
    valued_team=["repeat", "phd"],
    stopwords=STOP,
)


def pick(key, options, default):
    """Value chosen by an integer key."""
    out = None
    for k, v in options.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def no_text():
    return str_array([])


def profiles(spark, sf):
    # A row's features cost much more than its bytes: spread over the cores, also where a table is one small file.
    rows = (
        text_table(spark, sf, "customer", "c_custkey")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    n, money, segment = F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_mktsegment")
    raised = (F.greatest(F.lit(0), F.floor(money / 1000)) * 1000).cast("bigint")
    stage = (
        F.when(segment == "BUILDING", "seed")
        .when(segment == "MACHINERY", "series_a")
        .when(segment == "FURNITURE", "growth")
    )
    region = F.lower("r_name")
    sectors = (
        F.when(segment == "AUTOMOBILE", no_text())
        .when(segment == "HOUSEHOLD", F.array(region, F.lit("home")))
        .otherwise(F.array(region))
    )
    subs = pick(
        n % 4,
        {0: str_array(["Red", "bolt"]), 1: str_array(["gear", "small ", "gear"]), 2: no_text()},
        str_array(["blue", "widget", "ring"]),
    )
    conf = pick(n % 4, {0: F.lit("high"), 1: F.lit("medium"), 2: F.lit("low")}, F.lit(None))
    story = F.concat(
        F.lit("The "), F.lower(segment), F.lit(" market with "), F.array_join(subs, " "), F.lit(" demand, makers.")
    )
    return rows.select(
        F.col("c_custkey").alias("profile_id"),
        stage.alias("funding_stage"),
        F.lit(None).cast("bigint").alias("raise_min"),
        F.when(n % 2 == 0, raised * 2).alias("raise_max"),
        raised.alias("raise_value"),
        sectors.alias("sector_tags"),
        F.concat(F.lower("n_name"), F.lit(", X")).alias("geo_city"),
        F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("seeking_lead"),
        pick(n % 4, {0: no_text(), 1: str_array(["b2b"])}, str_array(["b2b", "saas"])).alias("business_model"),
        F.when(money > 0, F.floor(money / 2500) * 250000.0).alias("arr_usd"),
        (money < 2500).alias("pre_revenue"),
        pick(n % 5, {0: str_array(["repeat", "phd"]), 1: str_array(["operator"])}, no_text()).alias("team_background"),
        subs.alias("sub_sector_tags"),
        story.alias("narrative_text"),
        conf.alias("conf_stage"),
        F.lit("high").alias("conf_sector"),
        conf.alias("conf_geo"),
        F.lit("low").alias("conf_raise"),
        (F.col("c_custkey") % 10 != 0).alias("has_profile"),
    )


def firms(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    brand = F.substring("p_brand", 7, 3).cast("int")
    name = F.split("p_name", " ")
    sectors = pick(
        brand % 6,
        {
            0: no_text(),
            1: str_array(["south", "europe"]),
            2: str_array(["africa", "asia"]),
            3: str_array(["america", "home"]),
            4: str_array(["middle east"]),
        },
        str_array(["europe", "home", "asia"]),
    )
    geo = pick(
        size % 5,
        {
            0: no_text(),
            1: str_array(["global"]),
            2: str_array(["us_agnostic", "metro"]),
            3: str_array(["metro"]),
        },
        str_array(["coast", "global"]),
    )
    tags = pick(
        size % 6,
        {0: str_array(["generalist"]), 1: no_text(), 2: F.slice(name, 1, 1)},
        F.concat(name, str_array(["Generalist"])),
    )
    thesis = F.concat(
        F.lit("We back "), "p_name", F.lit(" makers"), F.when(kind == "SMALL", " small gear market demand").otherwise("")
    )
    return text_table(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("firm_id"),
        F.col("p_partkey").alias("ord"),
        "p_name",
        F.when(size % 11 == 0, False).when(size % 7 != 0, True).alias("is_real_investor"),
        F.when(kind == "PROMO", "other").otherwise("vc").alias("investor_type"),
        pick(
            size % 4,
            {0: no_text(), 1: str_array(["seed"]), 2: str_array(["seed", "series_a"])},
            str_array(["growth"]),
        ).alias("stages"),
        sectors.alias("sectors"),
        F.when(size >= 10, (size % 5 + 1) * 1000).cast("bigint").alias("check_size_min_usd"),
        F.when(size % 3 != 0, (size % 5 + 1) * 2500).cast("bigint").alias("check_size_max_usd"),
        geo.alias("geo_focus"),
        thesis.alias("thesis_text"),
        F.when((kind == "PROMO") & (size % 2 == 0), "https://x/grant-submission").alias("submission_url"),
        pick(size % 3, {0: no_text(), 1: str_array(["b2b"])}, str_array(["b2b", "saas", "hardware"])).alias(
            "business_model_preference"
        ),
        F.when(size % 5 == 0, False).when(size % 5 == 1, True).alias("pre_revenue_ok"),
        F.when(size % 4 == 3, 500000).cast("bigint").alias("min_arr_usd"),
        pick(size % 3, {1: str_array(["repeat", "operator"])}, no_text()).alias("team_background_preference"),
        pick(size % 4, {0: F.lit("lead_only"), 1: F.lit("both"), 2: F.lit("follow_ok")}, F.lit(None)).alias(
            "lead_investor"
        ),
        F.array(
            F.struct(
                F.col("p_brand").alias("name"),
                kind.alias("sector"),
                F.concat(F.lit("founder of "), "p_name").alias("founder_background"),
            )
        ).alias("portfolio_companies"),
        ((size % 5) * 25).alias("tier1_completeness"),
        tags.alias("sub_tags"),
    )


TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[,.;]', '', 'g'), '\\s+'), lambda w: length(w) > 3 and w not in ('with', 'that', 'back')))"


def sql_map(tags):
    return f"[case t when 'africa' then 'south' when 'tiny' then 'small' else t end for t in {tags}]"


def hits(text, terms):
    return "(" + " + ".join(f"contains({text}, '{t}')::int" for t in terms) + ")"


PROFILE_SQL = f"""select c_custkey as pid, case c_mktsegment when 'BUILDING' then 'seed' when 'MACHINERY' then 'series_a' when 'FURNITURE' then 'growth' end as stage,
   nullif(case when c_nationkey % 2 = 0 then raised * 2 else raised end, 0) as rmax, nullif(raised, 0) as rmin,
   list_distinct({sql_map("case c_mktsegment when 'AUTOMOBILE' then cast([] as varchar[]) when 'HOUSEHOLD' then [lower(r_name), 'home'] else [lower(r_name)] end")}) as sectors,
   case lower(n_name) when 'nation_1' then 'metro' when 'nation_2' then 'coast' when 'nation_3' then 'metro' end as geo,
   case c_nationkey % 3 when 0 then true when 1 then false end as seeking,
   case c_nationkey % 4 when 0 then cast([] as varchar[]) when 1 then ['b2b'] else ['b2b', 'saas'] end as models,
   case when c_acctbal > 0 then floor(c_acctbal / 2500) * 250000.0::double end as arr, c_acctbal < 2500 as pre,
   case c_nationkey % 5 when 0 then ['repeat', 'phd'] when 1 then ['operator'] else cast([] as varchar[]) end as team,
   case c_nationkey % 4 when 0 then ['red', 'bolt'] when 1 then ['gear', 'small', 'gear'] when 2 then cast([] as varchar[]) else ['blue', 'widget', 'ring'] end as subs,
   'the ' || lower(c_mktsegment) || ' market with ' || case c_nationkey % 4 when 0 then 'red bolt' when 1 then 'gear small  gear' when 2 then '' else 'blue widget ring' end || ' demand, makers.' as story,
   case when c_custkey % 10 = 0 then 0.8::double else (0.0::double + cf + 1.0::double + cf + 0.65::double) / 4.0::double end as conf
   from (select *, cast(greatest(0, floor(c_acctbal / 1000)) * 1000 as bigint) as raised,
     case c_nationkey % 4 when 0 then 1.0::double when 1 then 0.85::double when 2 then 0.65::double else 0.4::double end as cf
     from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
FIRM_SQL = f"""select p_partkey as fid, p_name,
   case p_size % 4 when 0 then cast([] as varchar[]) when 1 then ['seed'] when 2 then ['seed', 'series_a'] else ['growth'] end as stages,
   list_distinct({sql_map("case brand % 6 when 0 then cast([] as varchar[]) when 1 then ['south', 'europe'] when 2 then ['africa', 'asia'] when 3 then ['america', 'home'] when 4 then ['middle east'] else ['europe', 'home', 'asia'] end")}) as sectors,
   case when p_size >= 10 then (p_size % 5 + 1) * 1000.0::double end as cmin, case when p_size % 3 <> 0 then (p_size % 5 + 1) * 2500.0::double end as cmax,
   case p_size % 5 when 0 then cast([] as varchar[]) when 1 then ['global'] when 2 then ['us_agnostic', 'metro'] when 3 then ['metro'] else ['coast', 'global'] end as geo,
   thesis, case p_size % 3 when 0 then cast([] as varchar[]) when 1 then ['b2b'] else ['b2b', 'saas', 'hardware'] end as models,
   case p_size % 5 when 0 then false when 1 then true end as pre_ok, case when p_size % 4 = 3 then 500000.0::double end as min_arr,
   case p_size % 3 when 1 then ['repeat', 'operator'] else cast([] as varchar[]) end as team,
   case p_size % 4 when 0 then 'lead_only' when 1 then 'both' when 2 then 'follow_ok' end as lead,
   case when p_size % 5 = 0 then 70 else p_size % 5 * 25 end as filled, p_size % 6 = 0 as generalist,
   list_distinct({sql_map("case p_size % 6 when 0 then cast([] as varchar[]) when 1 then cast([] as varchar[]) when 2 then string_split(p_name, ' ')[1:1] else string_split(p_name, ' ') end")}) as own,
   list_distinct(list_filter([case when contains(lower(p_brand), 'brand#1') then 'ring' end, case when contains(lower(p_brand || ' founder of ' || p_name || ' ' || p_type), 'small') then 'gear' end,
     case when contains(p_name, 'anvil') then 'red' end], lambda t: t is not null)) as inferred
   from (select *, cast(substr(p_brand, 7) as int) as brand, 'we back ' || p_name || ' makers' || case when p_type = 'SMALL' then ' small gear market demand' else '' end as thesis from part)
   where not (p_size % 11 = 0) and not (p_type = 'PROMO' and (p_size % 2 = 0))"""
INTENT = f"""case dom when 0 then case when {hits("thesis", ["anvil", "plate"])} >= 2 then 0.0 when {hits("thesis", ["anvil", "plate"])} = 1 then 0.4
      when {hits("thesis", ["bolt", "gear"])} >= 2 and not contains(thesis, 'small') then 0.0 when {hits("thesis", ["bolt", "gear"])} >= 1 and not contains(thesis, 'small') then 0.6 else 1.0 end
    when 1 then case when contains(thesis, 'rod') then 0.4 when contains(thesis, 'ring') and not contains(thesis, 'blue') then 0.6 else 1.0 end else 1.0 end::double"""
OVER = "len(list_intersect({0}, {1}))"
UNION = "(len({0}) + len({1}) - len(list_intersect({0}, {1})))"
MATCH_SQL = f"""with pr as materialized (select *, list_distinct(subs) as usubs, case when {OVER.format("sectors", "['south', 'asia']")} > 0 then 0
     when {OVER.format("sectors", "['europe', 'america']")} > 0 then 1 end as dom from ({PROFILE_SQL})), fi as materialized ({FIRM_SQL}),
   a as (select p.pid, f.fid, f.p_name, dom, p.geo as pgeo, p.seeking, p.models as pm, p.arr, p.pre, p.team as pt, p.subs, p.usubs, p.story, p.conf, p.sectors as ps,
     f.sectors as fs, f.geo as fg, f.thesis, f.models as fm, f.pre_ok, f.min_arr, f.team as ft, f.lead, f.filled, f.generalist, f.own, f.inferred,
     coalesce(f.cmin, 0) as amin, f.cmax as amax, coalesce(p.rmin, 0)::double as bmin, coalesce(p.rmax, p.rmin, 0)::double as bmax,
     (f.cmin is null and f.cmax is null) or (p.rmin is null and p.rmax is null) as open
     from pr p join fi f on (p.stage is null or len(f.stages) = 0 or list_contains(f.stages, p.stage))
       and (len(p.sectors) = 0 or len(f.sectors) = 0 or list_has_any(p.sectors, f.sectors))
       and (len(f.geo) = 0 or list_has_any(f.geo, ['global', 'us_agnostic']) or coalesce(list_contains(f.geo, p.geo), false))),
   b as (select *, case when open or (bmax >= amin and (amax is null or bmin <= amax)) then 1.0
       when greatest(case when bmax <> 0 then amin / bmax else 'infinity'::double end, coalesce(bmin / amax, 0)) <= 3 then 0.7
       when greatest(case when bmax <> 0 then amin / bmax else 'infinity'::double end, coalesce(bmin / amax, 0)) <= 8 then 0.4 else 0.0 end::double as amount,
     {INTENT} as intent,
     case when coalesce(not pre_ok, false) and pre then 0.0 when min_arr is not null and arr is null then 0.2 when min_arr is not null and arr >= min_arr then 1.0
       when min_arr is not null then greatest(0.1, arr / min_arr) when arr >= 1e6 then 1.0 when arr >= 1e5 then 0.85 when arr > 0 then 0.7
       when not pre then 0.6 when pre_ok then 0.5 when pre_ok is null then 0.3 else 0.2 end::double as traction from a),
   c as (select *, case when len(ps) = 0 or len(fs) = 0 then 1.0::double else 0.75::double * ({OVER.format("ps", "fs")}::double / len(ps)) + 0.25::double * ({OVER.format("ps", "fs")}::double / {UNION.format("ps", "fs")}) end as sector,
     case when len(fm) = 0 then 0.5 when len(pm) = 0 then 0.2 else {OVER.format("pm", "fm")}::double / {UNION.format("pm", "fm")} end::double as bm,
     case when len(ft) = 0 then 0.5::double when len(pt) = 0 then 0.2::double when {OVER.format("pt", "ft")} = 0 then 0.0::double
       else least(1.0::double, {OVER.format("pt", "ft")}::double / {UNION.format("pt", "ft")} + least(0.2::double, 0.1::double * {OVER.format("list_intersect(pt, ft)", "['repeat', 'phd']")})) end as team,
     case when seeking is null or lead is null then 0.5 when seeking then case lead when 'lead_only' then 1.0 when 'both' then 0.85 else 0.1 end
       else case lead when 'follow_ok' then 1.0 when 'both' then 0.7 else 0.2 end end::double as ld,
     case when len(fg) = 0 then 0.5 when coalesce(list_contains(fg, pgeo), false) then 1.0 when list_contains(fg, 'us_agnostic') then 0.7 when list_contains(fg, 'global') then 0.6 else 0.0 end::double as gs,
     len(inferred) > 0 and (len(own) < 2 or {OVER.format("usubs", "own")} = 0) as rescued from b where amount > 0 and intent > 0 and traction > 0),
   d as (select *, (0.0::double + bm * 0.25::double + traction * 0.30::double + team * 0.20::double + ld * 0.10::double + gs * 0.15::double)
       * ((0.30::double + sector * 0.70::double) * intent) * (0.75::double + (filled / 100.0::double) * 0.25::double) * amount as tier2,
     case when rescued then list_distinct(list_concat(own, inferred)) else own end as tags from c),
   e as (select *, list_sort(list_intersect(usubs, tags)) as hit from d),
   g as (select *, case when generalist or len(subs) = 0 or len(tags) = 0 then 'no_data' when len(hit) = 0 then 'confirmed_mismatch' when rescued then 'inferred' else 'matched' end as status from e),
   h as (select *, case when status in ('matched', 'inferred') then round((len(hit)::double / len(subs)) * 0.7::double + least(len(hit) / 3.0::double, 1.0::double) * 0.3::double, 4)
       when status = 'no_data' then 0.2::double else 0.03::double end
       * case when ({hits("thesis", ["small", "gear"])} >= 2 and not contains(story, 'small') and not contains(story, 'gear'))
              or ({hits("thesis", ["hot", "ring"])} >= 2 and not contains(story, 'hot') and not contains(story, 'ring')) then 0.6::double else 1.0::double end as base,
     case when status in ('matched', 'inferred') then round(2 * (len(hit)::double / len(subs)) * (len(hit)::double / len(tags)) / ((len(hit)::double / len(subs)) + (len(hit)::double / len(tags))), 4) else 0.0::double end as f1 from g),
   i as (select *, round(base * (0.60::double + tier2 * 0.80::double) * conf, 4) as score from h),
   j as (select *, row_number() over (partition by pid order by score desc, fid) as rank from i qualify rank <= 15),
   k as (select j.*, u.embedding as pv, v.embedding as fv, {TOK.format("story")} as ptk, {TOK.format("thesis")} as ftk from j left join embeddings u on j.pid = u.vec_id left join embeddings v on j.fid = v.vec_id),
   l as (select *, case when pv is not null and fv is not null then least(1.0, greatest(0.0, (list_cosine_similarity(cast(pv as double[]), cast(fv as double[])) - 0.20) / 0.25))
     when len(ptk) = 0 or len(ftk) = 0 then 0.5 else least(1.0, ({OVER.format("ptk", "ftk")}::double / {UNION.format("ptk", "ftk")}) / 0.12::double) end::double as sem from k)"""


def matches(spark, sf, top_n=15):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return M.match(
        profiles(spark, sf),
        firms(spark, sf),
        VOCAB,
        top_n=top_n,
        firm_vectors=vectors.withColumnRenamed("vec_id", "firm_id"),
        profile_vectors=vectors.withColumnRenamed("vec_id", "profile_id"),
        show=["p_name"],
    )


@query(
    "match_top",
    "J1 J2 J10 W8 M1-M22",
    MATCH_SQL
    + """ select pid as profile_id, rank, fid as firm_id, p_name, score, round(tier2, 4) as tier2_score, round(sem, 4) as semantic_score, round(sector, 4) as sector_score,
     f1 as sub_bonus, round(base, 4) as sub_f1_base, array_to_string(case when status in ('matched', 'inferred') then hit else [] end, ',') as tags, status, round(0.60::double + tier2 * 0.80::double, 4) as tier2_mod,
     case dom when 0 then 'hard' when 1 then 'soft' end as intent_domain, intent as intent_mult, round(bm, 3) as d_model, round(traction, 3) as d_traction, round(team, 3) as d_team,
     round(ld, 3) as d_lead, round(gs, 3) as d_geo from l""",
)
def match_top(spark, sf):
    dims = {"d_model": "business_model", "d_traction": "traction", "d_team": "team", "d_lead": "lead", "d_geo": "geo_soft"}
    return matches(spark, sf).select(
        "profile_id",
        "rank",
        "firm_id",
        "p_name",
        "score",
        "tier2_score",
        "semantic_score",
        "sector_score",
        "sub_bonus",
        "sub_f1_base",
        F.array_join("sub_tags_matched", ",").alias("tags"),
        F.col("sub_sector_status").alias("status"),
        "tier2_mod",
        "intent_domain",
        "intent_mult",
        *[F.col(f"dim_scores.{v}").alias(k) for k, v in dims.items()],
    )


@query(
    "match_reasons",
    "M22",
    MATCH_SQL
    + """, r as (select pid, rank, case when status in ('matched', 'inferred') then hit else [] end as mt, sector, bm, traction, team, ld, gs, sem from l)
     select pid as profile_id, rank, array_to_string(list_filter([case when len(mt) > 0 then 'sub-sector match: ' || array_to_string(mt[1:3], ', ')
       when sector >= 0.4 then 'sector match (' || printf('%.0f', round_even(sector * 100, 0)) || '%)' end,
       case when bm >= 0.4 then 'business model aligned' end, case when traction >= 0.6 then 'traction requirements met' end,
       case when team >= 0.4 then 'team background match' end, case when ld >= 0.7 then 'lead preference aligned' end, case when gs >= 0.9 then 'city-level geo match' end,
       case when sem >= 0.5 then 'thesis alignment (' || printf('%.0f', round_even(sem * 100, 0)) || '%)' end], lambda x: x is not null), '; ') as reasons from r""",
)
def match_reasons(spark, sf):
    return matches(spark, sf).select(
        "profile_id", "rank", F.array_join("match_reasons", "; ").alias("reasons")
    )


@query(
    "match_score_stats",
    "A17",
    MATCH_SQL.replace(" qualify rank <= 15", "")
    + """, v as (select round(sem, 4) as s from l)
     select count(*) as n, min(s) as min_sem, max(s) as max_sem, round(avg(s), 3) as mean_sem, round(quantile_cont(s, 0.5), 4) as median_sem, count(*) filter (where s = 0) as n_zero from v""",
)
def match_score_stats(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return M.semantic_stats(
        profiles(spark, sf),
        firms(spark, sf),
        VOCAB,
        firm_vectors=vectors.withColumnRenamed("vec_id", "firm_id"),
        profile_vectors=vectors.withColumnRenamed("vec_id", "profile_id"),
    )


def unchecked_profiles(spark, sf):
    """Profiles as they come in: some lack the structured form, some the tags, some both."""
    kind = F.col("profile_id") % 7
    return profiles(spark, sf).select(
        *[c for c in profiles(spark, sf).columns if c not in ("has_profile", "sub_sector_tags")],
        F.when(kind == 0, F.lit(None).cast("boolean")).otherwise(kind % 2 == 0).alias("has_profile"),
        F.when(kind.isin(0, 1, 2), F.lit(None)).otherwise(F.col("sub_sector_tags")).alias("sub_sector_tags"),
    )


@query(
    "profile_lanes",
    "M23",
    """select c_custkey as profile_id, case when c_custkey % 7 in (0, 1) then 'refused' else 'accepted' end as lane,
         case when c_custkey % 7 in (0, 1) then 'neither profile nor sub_sector_tags' end as reason from customer""",
)
def profile_lanes(spark, sf):
    accepted, refused = M.split_profiles(unchecked_profiles(spark, sf))
    return accepted.select(
        "profile_id", F.lit("accepted").alias("lane"), F.lit(None).cast("string").alias("reason")
    ).unionByName(refused.select("profile_id", F.lit("refused").alias("lane"), "reason"))
