"""Joins, set operations and duplicate removal bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions.exprs import lookup
from lodeworks.operators import dedup as D
from lodeworks.operators import fuzzy as Z
from lodeworks.operators import joins as J
from lodeworks.plans.filtering import LINES, text_lines
from lodeworks.plans.registry import query, table, text_table


@query(
    "range_overlap_penalty",
    "J2 M6",
    """with t as (select l_orderkey, l_linenumber, case when p_size > 5 then p_size * 1000.0::double end as fmin,
         case when p_size < 45 then p_size * 2000.0::double end as fmax,
         case when l_discount < 0.01 then null else round(l_quantity) * 1000 end as wmin,
         case when l_discount < 0.01 then null when l_tax > 0.05 then round(l_quantity) * 1500 end as wmax
         from lineitem join part on l_partkey = p_partkey),
       u as (select *, coalesce(fmin, 0) as a, fmax as b, coalesce(wmin, 0) as c, coalesce(nullif(wmax, 0), coalesce(wmin, 0)) as d from t)
       select l_orderkey, l_linenumber, case
         when fmin is null and fmax is null then 1.0 when wmin is null and wmax is null then 1.0
         when d >= a and (b is null or c <= b) then 1.0
         when greatest(case when d <> 0 then a / d else 'infinity'::double end, coalesce(c / b, 0)) <= 3 then 0.7
         when greatest(case when d <> 0 then a / d else 'infinity'::double end, coalesce(c / b, 0)) <= 8 then 0.4
         else 0.0 end::double as multiplier from u""",
)
def range_overlap_penalty(spark, sf):
    items = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey"
    )
    size, known = F.col("p_size"), F.col("l_discount") >= 0.01
    asked = F.round("l_quantity")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        J.amount_multiplier(
            F.when(size > 5, size * 1000.0),
            F.when(size < 45, size * 2000.0),
            F.when(known, asked * 1000),
            F.when(known & (F.col("l_tax") > 0.05), asked * 1500),
        ).alias("multiplier"),
    )


@query(
    "label_lookup_default",
    "J3",
    """select d.doc_id, d.source, coalesce(l.quality, -1) as quality, coalesce(l.toxic, 0) as toxic
       from documents d left join labels l on d.doc_id = l.doc_id""",
)
def label_lookup_default(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return J.patch_from(docs, table(spark, sf, "labels"), "doc_id", {"quality": -1, "toxic": 0})


@query(
    "skip_done",
    "J4 S10 V12",
    "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
)
def skip_done(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return J.not_done(docs, table(spark, sf, "labels"), "doc_id")


NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def ascii_key(c):
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(plain, " +", " "))


def part_names(spark, sf):
    """Names with a reading position, where they come from and a language."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("bigint").alias("ord"),
        ascii_key(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("nm"),
        F.when(F.col("p_size") % 5 < 2, "src1").otherwise("src2").alias("source"),
        F.when(F.col("p_size") % 3 == 0, "en").when(F.col("p_size") % 3 == 1, "es").otherwise("de").alias("lang"),
    )


PART_NAMES = f"""(select cast(p_partkey as bigint) as ord, {NORM.format("p_name || ' ' || p_brand || ' ' || p_type")} as nm,
   case when p_size % 5 < 2 then 'src1' else 'src2' end as source, case p_size % 3 when 0 then 'en' when 1 then 'es' else 'de' end as lang from part)"""
SIM = "(1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::double)"


@query(
    "restore_best_match",
    "J5",
    f"""with n as (select * from {PART_NAMES}),
       w as (select distinct replace(nm, 'ring', 'rinq') as a from n where source < 'src2'),
       b as (select nm as b, min(ord) as ord from n where source >= 'src2' group by 1),
       e as (select a, b, ord, 1.0::double as sim from w join b on a = b),
       f as (select a, b, ord, {SIM.format("a", "b")} as sim from w join b on length(a) >= 0.85 * length(b) - 1 and length(b) >= 0.85 * length(a) - 1
             where a not in (select a from e) and {SIM.format("a", "b")} >= 0.85
             qualify row_number() over (partition by a order by {SIM.format("a", "b")} desc, ord) = 1)
       select a as wanted, b as restored, round(sim, 4) as sim from (select * from e union all select * from f)""",
)
def restore_best_match(spark, sf):
    names = part_names(spark, sf)
    wanted = names.filter("source < 'src2'").select(
        F.replace(F.col("nm"), F.lit("ring"), F.lit("rinq")).alias("a")
    )
    backup = names.filter("source >= 'src2'").select(F.col("nm").alias("b"), "ord")
    found = Z.best_match(wanted, backup, 0.85)
    return found.select(
        F.col("a").alias("wanted"), F.col("b").alias("restored"), F.round("sim", 4).alias("sim")
    )


@query(
    "restore_missing_names",
    "J5",
    f"""with n as (select * from {PART_NAMES}), s as (select nm, min(ord) as ord from n where source >= 'src2' group by 1),
       w as (select distinct ord as target, replace(nm, 'ring', 'rinq') as a from n where source < 'src2'),
       m as (select w.target, w.a, s.nm, s.ord, {SIM.format("w.a", "s.nm")} as sim from w join s on abs(length(w.a) - length(s.nm)) <= 6),
       p as (select * from w where a not in (select nm from n where ord % 3 = 0)),
       f as (select p.target, p.a, m.ord from p left join (select * from m where sim >= 0.82) m on m.target = p.target qualify row_number() over (partition by p.target order by m.sim desc nulls last, m.ord) = 1)
       select target, a as name, ord as restored_from from f where ord is not null""",
)
def restore_missing_names(spark, sf):
    """Names not present any more get the most similar backup row, under the wanted name."""
    names = part_names(spark, sf)
    wanted = names.filter("source < 'src2'").select(
        F.col("ord").alias("target"), F.replace(F.col("nm"), F.lit("ring"), F.lit("rinq")).alias("name")
    )
    present = names.filter("ord % 3 = 0").select("nm")
    backup = names.filter("source >= 'src2'").select(F.col("nm").alias("b"), "ord")
    restored = Z.restore_missing(wanted, "name", present, "nm", backup, 0.82)
    return restored.select("target", "name", F.col("ord").alias("restored_from"))


@query(
    "fuzzy_known_names",
    "J6",
    f"""with n as (select nm, lang, source from {PART_NAMES}),
       a as (select distinct nm, case when lang <> 'en' then lang end as st from n where source < 'src2'),
       b as (select distinct nm, case when lang <> 'es' then lang end as st from n where source >= 'src2')
       select nm, st, exists (select 1 from b where (b.st is null or a.st is null or a.st = b.st)
         and (a.nm = b.nm or (abs(length(a.nm) - length(b.nm)) <= 9 and {SIM.format("a.nm", "b.nm")} > 0.90))) as known from a""",
)
def fuzzy_known_names(spark, sf):
    names = part_names(spark, sf)
    state = F.col("lang")
    new = names.filter("source < 'src2'").select("nm", F.when(state != "en", state).alias("st")).distinct()
    old = (
        names.filter("source >= 'src2'")
        .select(F.col("nm").alias("b"), F.when(state != "es", state).alias("old_st"))
        .distinct()
    )
    pairs = Z.similar_names(new.select(F.col("nm").alias("a")), old.select("b"), 0.90).select("a", "b")
    # States met by each new name, as a small set: the states of its similar names.
    met = pairs.join(old, "b").groupBy(F.col("a").alias("nm")).agg(
        F.collect_set("old_st").alias("states"), F.max(F.col("old_st").isNull()).alias("any_state")
    )
    joined = new.join(met, "nm", "left")
    hit = F.col("any_state") | F.col("st").isNull() | F.array_contains("states", F.col("st"))
    return joined.select(
        "nm", "st", F.coalesce(F.col("states").isNotNull() & hit, F.lit(False)).alias("known")
    )


@query(
    "fuzzy_prefix_duplicates",
    "J7",
    f"""with n as (select distinct nm from {PART_NAMES})
       select a.nm as name, b.nm as twin, round({SIM.format("a.nm", "b.nm")}, 4) as sim from n a join n b
         on left(a.nm, 4) = left(b.nm, 4) and a.nm < b.nm and abs(length(a.nm) - length(b.nm)) <= 8
       where {SIM.format("a.nm", "b.nm")} > 0.88""",
)
def fuzzy_prefix_duplicates(spark, sf):
    names = part_names(spark, sf).select("nm").distinct()
    pairs = Z.similar_names(
        names.select(F.col("nm").alias("a")),
        names.select(F.col("nm").alias("b")),
        0.88,
        same_prefix=4,
        max_length_gap=8,
    )
    return pairs.filter("a < b").select(
        F.col("a").alias("name"), F.col("b").alias("twin"), F.round("sim", 4).alias("sim")
    )


@query("fuzzy_block_ratio_duplicates", "J7")
def fuzzy_block_ratio_duplicates(spark, sf):
    names = part_names(spark, sf).select("nm").distinct()
    pairs = Z.similar_names(
        names.select(F.col("nm").alias("a")),
        names.select(F.col("nm").alias("b")),
        0.88,
        measure=Z.RATIO,
        same_prefix=4,
        max_length_gap=8,
    )
    return pairs.filter("a < b").select(
        F.col("a").alias("name"), F.col("b").alias("twin"), F.round("sim", 4).alias("sim")
    )


@query(
    "rename_first_row",
    "J8",
    """with m(old, new) as (values ('red bolt', 'crimson bolt'), ('blue gear', null), ('hot ring', 'ring')),
       t as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as r from part)
       select p_partkey, case when r = 1 then coalesce(m.new, p_name) else p_name end as p_name
       from t left join m on t.p_name = m.old where not (m.old is not null and m.new is null)""",
)
def rename_first_row(spark, sf):
    mapping = spark.createDataFrame(
        [("red bolt", "crimson bolt"), ("blue gear", None), ("hot ring", "ring")],
        "old string, new string",
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return J.rename_first(parts, mapping, "p_name", "p_partkey")


@query(
    "dimension_lookup",
    "J9 N7",
    """select c_custkey, coalesce(case c_mktsegment when 'BUILDING' then 'Venture' when 'MACHINERY' then 'Growth' end,
         case when c_mktsegment in ('FURNITURE', 'Venture') then c_mktsegment end, 'Adviser') as kind, r_name as region
       from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
)
def dimension_lookup(spark, sf):
    segment = F.col("c_mktsegment")
    kind = F.coalesce(
        lookup({"BUILDING": "Venture", "MACHINERY": "Growth"}, segment),
        F.when(segment.isin("FURNITURE", "Venture"), segment),
        F.lit("Adviser"),
    )
    return (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", kind.alias("kind"), F.col("r_name").alias("region"))
    )


@query(
    "embedding_attach",
    "J10",
    """select d.doc_id, case when e.vec_id is null then 'keyword' else 'vector' end as tier, coalesce(len(e.embedding), 0) as dims
       from documents d left join embeddings e on d.doc_id = e.vec_id""",
)
def embedding_attach(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return (
        table(spark, sf, "documents")
        .select("doc_id")
        .join(vectors, "doc_id", "left")
        .select(
            "doc_id",
            F.when(F.col("embedding").isNull(), "keyword").otherwise("vector").alias("tier"),
            F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"),
        )
    )


@query(
    "user_scoped_items",
    "J11 S11",
    """select c_custkey, count(o_orderkey) as n_items, round(coalesce(max(o_totalprice), 0), 2) as largest
       from customer left join orders on c_custkey = o_custkey group by c_custkey""",
)
def user_scoped_items(spark, sf):
    # Aggregate before the join: the items side shrinks to one row per user.
    items = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_items"), F.max("o_totalprice").alias("largest"))
    )
    return (
        table(spark, sf, "customer")
        .select("c_custkey")
        .join(items, "c_custkey", "left")
        .select(
            "c_custkey",
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.round(F.coalesce("largest", F.lit(0.0)), 2).alias("largest"),
        )
    )


@query(
    "verdict_batches",
    "J12 V9",
    """with d as (select doc_id, doc_id // 10 as batch, doc_id % 10 as i, source from documents),
       v as (select doc_id // 10 as batch, doc_id % 10 as i, toxic = 0 as valid, case when quality = 1 then 'good' else '' end as source from labels)
       select doc_id, case when v.source is not null and v.source <> '' then v.source else d.source end as source
       from d left join v on d.batch = v.batch and d.i = v.i where v.valid is distinct from false""",
)
def verdict_batches(spark, sf):
    def placed(df):
        return df.withColumn("batch", F.floor(F.col("doc_id") / 10)).withColumn(
            "i", F.pmod("doc_id", F.lit(10))
        )

    docs = placed(table(spark, sf, "documents").select("doc_id", "source"))
    verdicts = placed(table(spark, sf, "labels")).select(
        "batch",
        "i",
        (F.col("toxic") == 0).alias("valid"),
        F.when(F.col("quality") == 1, "good").otherwise("").alias("source"),
    )
    return J.apply_verdicts(docs, verdicts, ["batch", "i"], "batch", ["source"]).select(
        "doc_id", "source"
    )


@query(
    "verdict_or_reject",
    "J12",
    """select d.doc_id, coalesce(l.toxic = 0, false) as accepted,
         case when not coalesce(l.toxic = 0, false) then coalesce(case when l.toxic = 1 then 'toxic' end, 'no_verdict') end as reject_reason
       from documents d left join labels l on d.doc_id = l.doc_id""",
)
def verdict_or_reject(spark, sf):
    verdicts = table(spark, sf, "labels").select(
        "doc_id", (F.col("toxic") == 0).alias("valid"), F.when(F.col("toxic") == 1, "toxic").alias("reason")
    )
    docs = table(spark, sf, "documents").select("doc_id")
    return J.verdict_or_reject(docs, verdicts, "doc_id", "no_verdict")


@query(
    "list_not_found",
    "J13 U4",
    """select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)""",
)
def list_not_found(spark, sf):
    known = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_partkey").distinct().join(known, "l_partkey", "left_anti")


@query(
    "bag_union_lanes",
    "U1 U2 U5",
    """select doc_id, null as source, 'cleaned' as lane from documents where source < 'src2'
       union all select doc_id, source, 'untouched' from documents where source >= 'src2'
       union all select doc_id, source, 'new' from documents join labels using (doc_id)""",
)
def bag_union_lanes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return J.lane_union(
        {
            "cleaned": docs.filter("source < 'src2'").select("doc_id"),
            "untouched": docs.filter("source >= 'src2'"),
            "new": docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id"),
        }
    )


@query(
    "array_set_counts",
    "U3",
    """with t as (select p_partkey, list_distinct(string_split(p_name, ' ')) as a, list_distinct([lower(p_type), 'red', 'bolt', 'red']) as b from part)
       select p_partkey, len(list_intersect(a, b)) as n_both, len(list_distinct(list_concat(a, b))) as n_any,
         len(list_filter(a, lambda x: not list_contains(b, x))) as n_only from t""",
)
def array_set_counts(spark, sf):
    a, b = F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("red"), F.lit("bolt"), F.lit("red"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.size(F.array_intersect(a, b)).alias("n_both"),
        F.size(F.array_union(a, b)).alias("n_any"),
        F.size(F.array_except(a, b)).alias("n_only"),
    )


@query(
    "key_list_difference",
    "U4",
    "select o_custkey from orders except all select c_custkey from customer where c_acctbal > 0",
)
def key_list_difference(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").exceptAll(rich)


# --- keep-best and greedy duplicate removal -------------------------------------------


@query(
    "keep_best_by_name_state",
    "W1 N25",
    """with t as (select p_partkey, replace(replace(trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')), ' bolt', ''), ' gear', '') as k,
         case when p_type <> 'PROMO' then p_type else '' end as st, p_size from part)
       select p_partkey, k, st from t qualify row_number() over (partition by trim(k), st order by p_size desc, p_partkey) = 1""",
)
def keep_best_by_name_state(spark, sf):
    from lodeworks.functions.names import key_by_removal

    keyed = table(spark, sf, "part").select(
        "p_partkey",
        key_by_removal("p_name", [" bolt", " gear"]).alias("k"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).otherwise("").alias("st"),
        "p_size",
    )
    return D.keep_best(keyed, ["k", "st"], [F.desc("p_size"), F.asc("p_partkey")]).select(
        "p_partkey", "k", "st"
    )


@query(
    "keep_best_display_name",
    "W2",
    """select p_partkey, p_name from part qualify row_number() over (partition by p_name order by p_retailprice desc, p_partkey) = 1""",
)
def keep_best_display_name(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return D.keep_best(parts, ["p_name"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select(
        "p_partkey", "p_name"
    )


@query(
    "keep_best_normalised_key",
    "W3 N25",
    """with t as (select doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w not in ('the', 'of', 'and')), '') as k,
         upper(lang) as st, n_chars from documents)
       select doc_id, st from t qualify row_number() over (partition by k, st order by n_chars desc, doc_id) = 1""",
)
def keep_best_normalised_key(spark, sf):
    from lodeworks.functions.names import key_alnum

    # The key is as long as the text; its digest is what the shuffle carries.
    keyed = text_table(spark, sf, "documents", "doc_id").select(
        "doc_id",
        F.sha2(key_alnum("text", ["the", "of", "and"]), 256).alias("k"),
        F.upper("lang").alias("st"),
        "n_chars",
    )
    return D.keep_best(keyed, ["k", "st"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "st")


@query(
    "greedy_name_or_url",
    "W4",
    """with recursive t as (select distinct l_orderkey * 10 + l_linenumber as ord, coalesce(cast(l_partkey as varchar), '') as name,
         case when l_suppkey > 3 then cast(l_suppkey as varchar) || '/' || strftime(l_shipdate, '%Y-%m-%d') end as url from lineitem),
       r(ord, name, url, kept) as (select ord, name, url, false from t union all
         select ord, name, url, root from (select *, max(root) over (partition by name) as by_name,
             max(root and url is not null) over (partition by url) and url is not null as by_url
           from (select ord, name, url, row_number() over (partition by name order by ord, url nulls first) = 1
               and (url is null or row_number() over (partition by url order by ord, name) = 1) as root
             from r where not kept)) where root or not (by_name or by_url))
       select ord, name, url from r where kept""",
)
def greedy_name_or_url(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.col("l_partkey").cast("string").alias("name"),
        F.when(F.col("l_suppkey") > 3, F.concat_ws("/", "l_suppkey", F.to_date("l_shipdate"))).alias("url"),
    )
    return D.greedy_by_keys(rows, "ord", "name", "url")


@query(
    "greedy_fuzzy_names",
    "W4 J7",
    f"""with n as (select nm, min(ord) as ord from {PART_NAMES} group by 1),
       l as (select list({{'nm': nm, 'ord': ord}} order by ord) as rows from n),
       k as (select list_reduce(rows, lambda kept, x: case when len(list_filter(kept, lambda y: left(y.nm, 4) = left(x[1].nm, 4)
             and abs(length(y.nm) - length(x[1].nm)) <= 8 and {SIM.format("y.nm", "x[1].nm")} > 0.88)) > 0 then kept else list_concat(kept, x) end,
           cast([] as struct(nm varchar, ord bigint)[])) as kept from (select list_transform(rows, lambda r: [r]) as rows from l))
       select unnest(kept).nm as nm, unnest(kept).ord as ord from k""",
)
def greedy_fuzzy_names(spark, sf):
    names = part_names(spark, sf).select("nm", "ord")
    nodes, edges = Z.conflict_edges(names, "nm", "ord", 0.88, same_prefix=4, max_length_gap=8)
    return D.greedy_by_edges(nodes, edges, "ord")


@query(
    "first_per_id",
    "W5",
    "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1",
)
def first_per_id(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return D.keep_best(events, ["user_id", "event_type"], [F.asc("event_id")])


@query(
    "latest_per_user",
    "W6 S11",
    """select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
)
def latest_per_user(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return J.latest_per(events, "user_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")
