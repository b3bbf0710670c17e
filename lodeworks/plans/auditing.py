"""Audit measures bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.operators import audit as A
from lodeworks.plans.registry import query, table

PLACEHOLDERS = ["unknown", "n/a", "general", "idiot", "hot"]


def audited(spark, sf):
    """Orders with gaps made on purpose: null, blank and placeholder values."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("Unknown")))
        .otherwise(F.array("o_orderpriority", F.lit("n/a")))
        .alias("stages"),
    )


AUDITED = """(select o_orderkey, case when o_totalprice > 50000 then o_totalprice end as amount,
   case when o_orderstatus = 'P' then ' ' else o_orderstatus end as status,
   case when o_orderpriority = '5-LOW' then cast([] as varchar[])
        when o_orderpriority = '1-URGENT' then ['Unknown'] else [o_orderpriority, 'n/a'] end as stages
   from orders)"""


@query(
    "field_completeness",
    "A1",
    f"""with t as (select count(*) as n, count(amount) as pa,
         count(*) filter (where trim(status) <> '') as ps, count(*) filter (where len(stages) > 0) as pt,
         count(*) filter (where len(list_filter(stages, lambda v: lower(v) not in ('unknown', 'n/a', 'general', 'idiot', 'hot'))) > 0) as mt
         from {AUDITED}),
       u as (select n, unnest([{{'field': 'amount', 'p': pa, 'm': pa}}, {{'field': 'status', 'p': ps, 'm': ps}},
         {{'field': 'stages', 'p': pt, 'm': mt}}]) as r from t)
       select r.field as field, r.p as n_present, r.m as n_meaningful,
         round(100.0::double * r.p / n, 1) as pct_present, round(100.0::double * r.m / n, 1) as pct_meaningful from u""",
)
def field_completeness(spark, sf):
    return A.completeness(audited(spark, sf), ["amount", "status", "stages"], PLACEHOLDERS)


@query(
    "list_value_distribution",
    "A2",
    """select value, count(*) as n_rows from (select unnest(string_split(p_name, ' ')) as value from part)
       where lower(value) not in ('unknown', 'n/a', 'general', 'idiot', 'hot')
       group by value order by n_rows desc, value limit 30""",
)
def list_value_distribution(spark, sf):
    return A.value_counts(
        table(spark, sf, "part"), F.explode(F.split("p_name", " ")), top=30, drop=PLACEHOLDERS
    )


@query(
    "amount_summary",
    "A3",
    """select count(o_totalprice) as n, round(min(o_totalprice), 4) as min_value, round(max(o_totalprice), 4) as max_value,
         round(avg(o_totalprice), 2) as mean_value, round(quantile_cont(o_totalprice, 0.25), 4) as p25,
         round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.75), 4) as p75,
         round(quantile_cont(o_totalprice, 0.95), 4) as p95 from orders""",
)
def amount_summary(spark, sf):
    out = A.number_summary(table(spark, sf, "orders"), "o_totalprice")
    shape = [F.round(c, 4).alias(c) for c in ("min_value", "max_value", "p25", "median", "p75", "p95")]
    return out.select("n", *shape, F.round("mean_value", 2).alias("mean_value"))


@query(
    "amount_percentiles_by_group",
    "A3",
    """select o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) as p25,
         round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.9), 4) as p90
       from orders group by o_orderpriority""",
)
def amount_percentiles_by_group(spark, sf):
    out = A.percentile_columns(
        table(spark, sf, "orders"),
        "o_totalprice",
        {"p25": 0.25, "median": 0.5, "p90": 0.9},
        ["o_orderpriority"],
    )
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("p25", "median", "p90")])


@query(
    "quantity_histogram",
    "A4",
    """select cast(floor(l_quantity / 10) * 10 as bigint) as bucket, count(*) as n_rows from lineitem group by 1""",
)
def quantity_histogram(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), "l_quantity", 10)


@query(
    "price_ratio_distribution",
    "A5",
    """with r as (select case when l_extendedprice <> 0 and l_quantity > 0 then l_extendedprice / l_quantity end as ratio from lineitem),
       q as (select count(ratio) as n, quantile_cont(ratio, 0.1) as p10, quantile_cont(ratio, 0.25) as p25,
         quantile_cont(ratio, 0.5) as median, quantile_cont(ratio, 0.75) as p75, quantile_cont(ratio, 0.9) as p90 from r)
       select n, round(p10, 3) as p10, round(p25, 3) as p25, round(median, 3) as median, round(p75, 3) as p75,
         round(p90, 3) as p90, (p75 - p25) / median < 1.5 as is_tight from q where n >= 10""",
)
def price_ratio_distribution(spark, sf):
    out = A.ratio_distribution(
        table(spark, sf, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity")
    )
    shape = [F.round(c, 3).alias(c) for c in ("p10", "p25", "median", "p75", "p90")]
    return out.select("n", *shape, "is_tight")


@query(
    "core_field_gaps",
    "A6",
    f"""with t as (select coalesce(amount is not null, false) as a, trim(status) <> '' as s, len(stages) > 0 as g,
         o_orderkey > 100 as fb from {AUDITED})
       select count(*) as n_rows, count(*) filter (where a and s and g) as n_all_core,
         count(*) filter (where not a) as gap_amount, count(*) filter (where not a and s) as fillable_amount,
         count(*) filter (where not s) as gap_status, count(*) filter (where not g) as gap_stages,
         count(*) filter (where not g and s) as fillable_stages from t""",
)
def core_field_gaps(spark, sf):
    df = audited(spark, sf)
    status = A.present(df, "status")
    return A.core_gaps(
        df,
        {"amount": A.present(df, "amount"), "status": status, "stages": A.present(df, "stages")},
        {"amount": status, "stages": status},
    )


@query(
    "grouped_counts",
    "A7",
    """with c as (select case when grouping(o_orderstatus) = 0 then 'o_orderstatus' else 'o_orderpriority' end as facet,
         coalesce(o_orderstatus, o_orderpriority) as value, count(*) as n_rows
         from orders group by grouping sets ((o_orderstatus), (o_orderpriority)))
       select facet, value, n_rows, row_number() over (partition by facet order by n_rows desc, value) as place
       from c qualify place <= 10""",
)
def grouped_counts(spark, sf):
    counts = A.grouped_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return A.top_per_facet(counts, 10)


@query(
    "coverage_floor_percent",
    "A8",
    f"""with t as (select count(*) as n, count(amount) as a, count(*) filter (where trim(status) <> '') as s from {AUDITED})
       select unnest(['amount', 'status']) as field, unnest([a, s]) as n_rows,
         unnest([cast(floor(100 * a / n) as bigint), cast(floor(100 * s / n) as bigint)]) as pct from t""",
)
def coverage_floor_percent(spark, sf):
    df = audited(spark, sf)
    return A.coverage(df, {c: A.present(df, c) for c in ("amount", "status")})


@query(
    "floored_average",
    "A8",
    """select l_returnflag, cast(floor(sum(cast(l_quantity as bigint)) / count(*)) as bigint) as avg_floor
       from lineitem group by 1""",
)
def floored_average(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.floor(F.sum(q) / F.count("*")).cast("bigint").alias("avg_floor"))
    )


@query(
    "score_bands",
    "A9",
    """select count(*) filter (where s >= 80) as n_high, count(*) filter (where s >= 50 and s < 80) as n_mid,
         count(*) filter (where s < 50) as n_low, round(avg(s), 4) as mean_score
       from (select cast(p_size * 2 as bigint) as s from part)""",
)
def score_bands(spark, sf):
    scored = table(spark, sf, "part").select((F.col("p_size") * 2).cast("bigint").alias("s"))
    return A.score_bands(scored, "s")


STATUS = {"error": "failed", "view": "rejected"}


@query(
    "enrichment_run_report",
    "A10",
    """with t as (select case event_type when 'error' then 'failed' when 'view' then 'rejected' else 'enriched' end as status,
         value, case when value > 400 then 'high' when value > 200 then 'medium' else 'low' end as conf from events),
       n as (select count(*) as n from t)
       select status, count(*) as n_rows, round(100.0::double * count(*) / (select n from n), 1) as pct,
         count(*) filter (where conf = 'high') as n_high, count(*) filter (where conf = 'medium') as n_medium,
         count(*) filter (where conf = 'low') as n_low, count(*) filter (where value > 50) as n_with_contact,
         round(avg(value), 3) as mean_elapsed from t group by status""",
)
def enrichment_run_report(spark, sf):
    value = F.col("value")
    events = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "rejected")
        .otherwise("enriched")
        .alias("status"),
        "value",
        F.when(value > 400, "high").when(value > 200, "medium").otherwise("low").alias("conf"),
    )
    lanes = events.groupBy("status").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("conf") == "high").alias("n_high"),
        F.count_if(F.col("conf") == "medium").alias("n_medium"),
        F.count_if(F.col("conf") == "low").alias("n_low"),
        F.count_if(value > 50).alias("n_with_contact"),
        F.round(F.avg("value"), 3).alias("mean_elapsed"),
    )
    # Three lanes at most, so the share needs no second pass over the events.
    from pyspark.sql import Window

    total = F.sum("n_rows").over(Window.partitionBy())
    return lanes.withColumn("pct", F.round(100.0 * F.col("n_rows") / total, 1))


@query(
    "completeness_step_buckets",
    "A10 A4",
    """select cast(floor(least(p_size * 2.5::double, 100) / 25) * 25 as bigint) as bucket, count(*) as n_rows
       from part group by 1""",
)
def completeness_step_buckets(spark, sf):
    score = F.col("p_size") * 2.5
    return (
        table(spark, sf, "part")
        .groupBy(A.step_bucket(score).alias("bucket"))
        .agg(F.count("*").alias("n_rows"))
    )


@query(
    "column_profile",
    "A11",
    f"""with t as (select 'status' as "column", nullif(trim(status), '') as value from {AUDITED}
         union all select 'priority', stages[1] from {AUDITED})
       select "column", count(*) - count(value) as n_null, count(distinct value) as n_unique,
         round(100.0::double * (count(*) - count(value)) / count(*), 2) as pct_null from t group by 1""",
)
def column_profile(spark, sf):
    df = audited(spark, sf).select(
        F.nullif(F.trim("status"), F.lit("")).alias("status"),
        F.get("stages", F.lit(0)).alias("priority"),
    )
    return A.column_profile(df, ["status", "priority"])


@query(
    "column_top_values",
    "A11",
    """with t as (select 'p_brand' as "column", p_brand as value from part union all select 'p_type', p_type from part),
       c as (select "column", value, count(*) as n from t group by 1, 2)
       select "column", value, n, row_number() over (partition by "column" order by n desc, value) as place
       from c qualify place <= 5""",
)
def column_top_values(spark, sf):
    return A.top_values(table(spark, sf, "part"), ["p_brand", "p_type"], 5)


@query(
    "numeric_column_stats",
    "A11",
    """select 'l_quantity' as "column", count(l_quantity) as n, round(avg(l_quantity), 4) as mean_value,
         min(l_quantity) as min_value, max(l_quantity) as max_value from lineitem
       union all select 'l_discount', count(l_discount), round(avg(l_discount), 4), min(l_discount), max(l_discount) from lineitem""",
)
def numeric_column_stats(spark, sf):
    columns = ["l_quantity", "l_discount"]
    totals = table(spark, sf, "lineitem").agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("n"),
                F.round(F.avg(c), 4).alias("mean_value"),
                F.min(c).alias("min_value"),
                F.max(c).alias("max_value"),
            ).alias(c)
            for c in columns
        ]
    )
    return totals.select(F.explode(F.array(*columns)).alias("r")).select("r.*")


@query(
    "target_validation",
    "A12",
    """with c as (select o_orderpriority, count(*) as n_rows from orders where o_orderstatus = 'F' group by 1),
       t as (select r_name as o_orderpriority, 100 as target from region
         union select distinct o_orderpriority, 100 from orders)
       select t.o_orderpriority, target, coalesce(n_rows, 0) as n_rows, coalesce(n_rows, 0) >= target as passed
       from t left join c on t.o_orderpriority = c.o_orderpriority""",
)
def target_validation(spark, sf):
    orders = table(spark, sf, "orders")
    counts = (
        orders.filter("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n_rows"))
    )
    names = table(spark, sf, "region").select(F.col("r_name").alias("o_orderpriority"))
    targets = names.unionByName(orders.select("o_orderpriority")).distinct()
    return A.meets_targets(counts, targets.withColumn("target", F.lit(100)), "o_orderpriority")


@query(
    "subset_stats",
    "A15",
    f"""select count(*) as n_rows, count(amount) as n_with_amount, count(*) filter (where trim(status) <> '') as n_labelled,
         round(avg(case when len(stages) > 0 then len(stages) end), 4) as avg_list from {AUDITED}""",
)
def subset_stats(spark, sf):
    n = F.size("stages")
    return audited(spark, sf).agg(
        F.count("*").alias("n_rows"),
        F.count("amount").alias("n_with_amount"),
        F.count_if(F.trim("status") != "").alias("n_labelled"),
        F.round(F.avg(F.when(n > 0, n)), 4).alias("avg_list"),
    )


@query("facet_values", "A16", "select distinct p_type as value from part where p_type is not null")
def facet_values(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("value")).dropna().distinct().orderBy("value")


@query(
    "flattened_facet_values",
    "A16",
    "select distinct unnest(string_split(p_name, ' ')) as value from part",
)
def flattened_facet_values(spark, sf):
    return (
        table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("value")).distinct()
    )


@query(
    "score_vector_stats",
    "A17",
    """with t as (select round(l_discount * 10, 4) as s from lineitem)
       select count(*) as n, min(s) as min_score, max(s) as max_score, round(avg(s), 4) as mean_score,
         round(quantile_cont(s, 0.5), 4) as median_score, count(*) filter (where s = 0) as n_zero from t""",
)
def score_vector_stats(spark, sf):
    scores = table(spark, sf, "lineitem").select(F.round(F.col("l_discount") * 10, 4).alias("s"))
    base = scores.agg(
        F.count("*").alias("n"),
        F.min("s").alias("min_score"),
        F.max("s").alias("max_score"),
        F.round(F.avg("s"), 4).alias("mean_score"),
        F.count_if(F.col("s") == 0).alias("n_zero"),
    ).withColumn("_k", F.lit(1))
    mid = A.percentile_columns(scores, "s", {"median_score": 0.5}).select(
        F.round("median_score", 4).alias("median_score"), F.lit(1).alias("_k")
    )
    return base.join(F.broadcast(mid), "_k").drop("_k")


@query(
    "cleaning_reconciliation",
    "A18",
    """with r as (select case when p_size <= 2 then null else p_name || p_type end as k from part),
       c as (select count(*) as n_raw, count(*) - count(k) as n_null, count(distinct k) as n_final from r)
       select n_raw, n_null, n_raw - n_null - n_final as n_duplicate, n_final from c""",
)
def cleaning_reconciliation(spark, sf):
    keys = table(spark, sf, "part").select(
        F.when(F.col("p_size") > 2, F.concat("p_name", "p_type")).alias("k")
    )
    # One shuffle on the key; the totals add up the per-key counts.
    per_key = keys.groupBy("k").agg(F.count("*").alias("n"))
    missing = F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0))
    return per_key.agg(
        F.sum("n").alias("n_raw"), missing.alias("n_null"), F.count("k").alias("n_final")
    ).select(
        "n_raw",
        "n_null",
        (F.col("n_raw") - F.col("n_null") - F.col("n_final")).alias("n_duplicate"),
        "n_final",
    )


@query(
    "result_counter",
    "A19",
    "select count(*) filter (where p_type = 'SMALL' and contains(p_name, 'red')) as n_shown, count(*) as n_total from part",
)
def result_counter(spark, sf):
    shown = (F.col("p_type") == "SMALL") & F.col("p_name").contains("red")
    return table(spark, sf, "part").agg(F.count_if(shown).alias("n_shown"), F.count("*").alias("n_total"))


@query(
    "contact_quality_counts",
    "A20",
    r"""with t as (select regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}') as mails from documents)
       select count(*) as n_rows, count(*) filter (where len(mails) > 0) as n_with_contact,
         count(*) filter (where len(list_filter(mails, lambda m: contains(m, 'mail3') or contains(m, 'mail5'))) > 0) as n_high from t""",
)
def contact_quality_counts(spark, sf):
    mails = F.regexp_extract_all("text", F.lit(r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}"), F.lit(0))
    contacts = F.transform(
        mails,
        lambda m: F.struct(
            m.alias("email"),
            F.when(m.contains("mail3") | m.contains("mail5"), "high").otherwise("low").alias("confidence"),
        ),
    )
    docs = table(spark, sf, "documents").select(contacts.alias("contacts"))
    return docs.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.size("contacts") > 0).alias("n_with_contact"),
        F.count_if(F.exists("contacts", lambda c: c["confidence"] == "high")).alias("n_high"),
    )


@query(
    "priority_stratified_sample",
    "W7",
    """select o_orderkey, o_orderpriority from orders qualify row_number() over
         (partition by o_orderpriority order by md5(cast(o_orderkey as varchar) || '42'), o_orderkey) <= 100""",
)
def priority_stratified_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return A.stratified_sample(orders, "o_orderpriority", "o_orderkey", 100, "42")
