"""Sources and sinks: tables are written, read back and compared with what they were."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.operators import report as R
from lodeworks.plans.registry import query, table
from lodeworks.session import run_dir
from lodeworks.sources import tables as S
from lodeworks.streaming import ingest

PART = "p_partkey bigint, p_name string, p_size bigint"


def small_parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("p_size"))


@query(
    "json_lines_round_trip",
    "S1 S7",
    "select p_partkey, p_name, cast(p_size as bigint) as p_size from part",
)
def json_lines_round_trip(spark, sf):
    """Two appended batches of JSON lines with blank lines between them."""
    out = run_dir(spark, "lines")
    parts = small_parts(spark, sf)
    for rest in (0, 1):
        half = parts.filter(F.col("p_partkey") % 2 == rest)
        line = F.when(F.col("p_size") % 3 == 0, F.concat(F.to_json(F.struct("*")), F.lit("\n"))).otherwise(F.to_json(F.struct("*")))
        half.select(line.alias("value")).write.mode("append").text(out)
    return S.read_json_lines(spark, out, PART)


def arrays(df, size: int):
    """A JSON array per ``size`` keys, each in a file of its own."""
    chunk = F.floor(F.col("p_partkey") / size)
    return df.groupBy(chunk.alias("chunk")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))


@query(
    "json_arrays_round_trip",
    "S2",
    "select p_partkey, p_name, cast(p_size as bigint) as p_size from part",
)
def json_arrays_round_trip(spark, sf):
    out = run_dir(spark, "arrays")
    arrays(small_parts(spark, sf), 500).write.partitionBy("chunk").text(out)
    return S.read_json_array(spark, out, PART).select("p_partkey", "p_name", "p_size")


@query(
    "wrapped_lists",
    "S3",
    "select p_partkey, p_name, cast(p_size as bigint) as p_size from part",
)
def wrapped_lists(spark, sf):
    """Bare lists beside lists wrapped under different keys."""
    out = run_dir(spark, "wrapped")
    chunks = arrays(small_parts(spark, sf), 300)
    key = F.get(F.array(F.lit("data"), F.lit("records"), F.lit("investors")), F.pmod("chunk", F.lit(3)).cast("int"))
    wrapped = F.concat(F.lit('{"n": 1, "'), key, F.lit('": '), "value", F.lit("}"))
    value = F.when(F.pmod("chunk", F.lit(4)) == 0, F.col("value")).otherwise(wrapped)
    chunks.select("chunk", value.alias("value")).write.partitionBy("chunk").text(out)
    return S.read_wrapped(spark, out, PART)


@query(
    "csv_round_trip",
    "S4 S8",
    "select cast(p_partkey as varchar) as p_partkey, replace(p_name, ' ', '; ') as words, case when p_size > 9 then p_type end as kind from part",
)
def csv_round_trip(spark, sf):
    out = run_dir(spark, "csv")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.split("p_name", " ").alias("words"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("kind")
    )
    S.write_csv_joined(rows, out)
    return S.read_csv_strings(spark, out)


@query(
    "two_copies",
    "S5 S6",
    "select p_partkey, p_name from part where p_size > 10",
)
def two_copies(spark, sf):
    """A full run and its overwrite; the reader takes the first copy that exists."""
    root = run_dir(spark, "copies")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    for least in (0, 10):
        S.write_copies(parts.filter(F.col("p_size") > least).drop("p_size"), f"{root}/rows", f"{root}/json")
    found = S.first_existing(spark, [f"{root}/absent", f"{root}/json", f"{root}/rows"])
    return S.read_json_lines(spark, found, "p_partkey bigint, p_name string")


@query(
    "newest_version",
    "S9",
    "select p_partkey, case when p_size > 25 then upper(p_name) else p_name end as p_name from part where p_size <> 7",
)
def newest_version(spark, sf):
    """Three versions, each made from the one before, and a newer folder without a pointer."""
    root = run_dir(spark, "versions")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    S.write_version(parts, root, 9)
    S.write_version(S.read_latest(spark, root).filter("p_size <> 7"), root)
    shown = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))
    S.write_version(S.read_latest(spark, root).select("p_partkey", shown.alias("p_name")), root)
    parts.limit(0).write.parquet(f"{root}/data/version-99-unfinished")
    return S.read_latest(spark, root)


@query(
    "payload_rows",
    "S11",
    """select user_id, event_id, case when event_id % 10 = 0 then null when event_id % 10 = 1 then null else cast(json_extract_string(props, '$.k') as bigint) end as k,
         event_id % 10 > 1 and json_extract_string(props, '$.k') is not null as has_k from events where user_id % 3 = 0""",
)
def payload_rows(spark, sf):
    """Payload texts, some null or unreadable, as structs; read for a third of the users."""
    n = F.col("event_id") % 10
    raw = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(n == 1, "{broken").when(n > 1, F.col("props")).alias("payload")
    )
    rows = S.with_payload(raw, "payload", "k bigint").filter("user_id % 3 = 0")
    return rows.select("user_id", "event_id", F.col("payload.k").alias("k"), F.col("payload.k").isNotNull().alias("has_k"))


@query(
    "owner_sync",
    "S12",
    """select user_id % 40 as owner, event_id, case when user_id % 40 % 4 = 1 then 'second' else 'first' end as version
       from events where user_id % 40 % 4 <> 2 and (user_id % 40 % 4 <> 1 or event_type = 'view')""",
)
def owner_sync(spark, sf):
    """All owners' rows, then a sync that replaces some owners' rows and clears others'."""
    path = run_dir(spark, "owners")
    events = table(spark, sf, "events").select((F.col("user_id") % 40).alias("owner"), "event_id", "event_type")
    S.replace_owner_rows(events.select("owner", "event_id", F.lit("first").alias("version")), path, "owner")
    again = events.filter("owner % 4 = 1 and event_type = 'view'").select("owner", "event_id", F.lit("second").alias("version"))
    synced = events.filter("owner % 4 in (1, 2)").select("owner")
    S.replace_owner_rows(again, path, "owner", synced)
    return S.read_owner_rows(spark, path).select(F.col("owner").cast("bigint").alias("owner"), "event_id", "version")


@query(
    "legacy_import",
    "S13",
    "select p_partkey, p_name, cast(p_size as bigint) as p_size from part",
)
def legacy_import(spark, sf):
    """Legacy files imported twice: the second time adds what the first did not have."""
    root = run_dir(spark, "legacy")
    chunks = arrays(small_parts(spark, sf), 400)
    chunks.filter("chunk % 2 = 0").write.partitionBy("chunk").text(f"{root}/files")
    S.import_once(spark, f"{root}/files", PART, f"{root}/table", "p_partkey")
    chunks.filter("chunk % 2 = 1").write.mode("append").partitionBy("chunk").text(f"{root}/files")
    S.import_once(spark, f"{root}/files", PART, f"{root}/table", "p_partkey")
    return spark.read.parquet(f"{root}/table").select("p_partkey", "p_name", "p_size")


@query(
    "exported_documents",
    "S14",
    "select c_custkey, c_name, 'of ' || c_mktsegment as note from customer",
)
def exported_documents(spark, sf):
    out = run_dir(spark, "export")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit("of "), "c_mktsegment").alias("note"))
    S.export_json(rows, out, "c_custkey", rows_per_file=400)
    return S.read_json_lines(spark, out, "c_custkey bigint, c_name string, note string")


@query(
    "resumed_stream",
    "E5 S10",
    "select event_type, count(*) as n_rows, count(distinct event_id) as n_ids, sum(event_id)::bigint as id_sum from events group by 1",
)
def resumed_stream(spark, sf):
    """Several files, two a batch; the stream stops, more files come, and it is started again."""
    root = run_dir(spark, "resumed")
    events = table(spark, sf, "events").select("event_id", "event_type")

    def arrive(rest):
        events.filter(F.col("event_id") % 2 == rest).repartition(5, "event_id").write.mode("append").parquet(f"{root}/in")

    def run():
        stream = ingest.open_stream(spark, f"{root}/in", events.schema, files_per_batch=2)
        return ingest.write_batches(stream, f"{root}/out", f"{root}/checkpoint")

    arrive(0)
    run()
    arrive(1)
    run()
    run()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_ids"), F.sum("event_id").alias("id_sum")
    )


@query(
    "run_report_one_pass",
    "A10 A18",
    """with t as (select *, case when p_size % 10 = 0 then 'failed' when p_size % 10 = 1 then 'rejected' else 'enriched' end as status,
         case when p_size > 30 then 'high' when p_size > 15 then 'medium' else 'low' end as conf, least(p_size * 3, 100) as t1, p_size % 100 as t2,
         p_size % 3 as links, case when p_size % 4 <> 0 then p_size end as tokens, p_retailprice as elapsed from part),
       g as (select * from t where status = 'enriched'),
       c as (select count(*) as n, count(*) filter (where status = 'enriched') as e, count(*) filter (where status = 'rejected') as r, count(*) filter (where status = 'failed') as f from t),
       m as (select count(*) filter (where p_type <> 'PROMO') as fk, count(*) filter (where p_size > 20) as fs, count(*) filter (where links > 0) as cl, count(*) filter (where p_size % 2 = 0) as ce, sum(links) as nl from g),
       s as (select unnest([0, 25, 50, 75, 100]) as s),
       steps as (select 'tier1_completeness_' || s as measure, (select count(*) from g where floor(least(t1, 100) / 25) * 25 = s)::double as value from s
         union all select 'tier2_completeness_' || s, (select count(*) from g where floor(least(t2, 100) / 25) * 25 = s)::double from s),
       conf as (select 'confidence_' || k as measure, (select count(*) from g where conf = k)::double as value from (select unnest(['high', 'medium', 'low']) as k))
       select * from steps union all select * from conf
       union all select unnest(['n_rows', 'n_enriched', 'n_rejected', 'n_failed', 'field_kind', 'field_size', 'contact_link', 'contact_email', 'n_links']), unnest([n, e, r, f, fk, fs, cl, ce, nl])::double from c, m
       union all select unnest(['pct_enriched', 'pct_rejected', 'pct_failed', 'pct_field_kind', 'pct_field_size', 'pct_contact_link', 'pct_contact_email']),
         unnest([round(100.0::double * e / n, 1), round(100.0::double * r / n, 1), round(100.0::double * f / n, 1), round(100.0::double * fk / e, 1), round(100.0::double * fs / e, 1), round(100.0::double * cl / e, 1), round(100.0::double * ce / e, 1)]) from c, m
       union all select 'links_per_row', round(nl::double / e, 3) from c, m
       union all select unnest(['mean_elapsed', 'mean_tokens']), unnest([round(avg(elapsed), 3), round(avg(tokens), 3)]) from t""",
)
def run_report_one_pass(spark, sf):
    size = F.col("p_size")
    results = table(spark, sf, "part").select(
        "p_partkey",
        "p_type",
        "p_size",
        F.when(size % 10 == 0, "failed").when(size % 10 == 1, "rejected").otherwise("enriched").alias("status"),
        F.when(size > 30, "high").when(size > 15, "medium").otherwise("low").alias("overall_confidence"),
        F.least(size * 3, F.lit(100)).alias("tier1_completeness"),
        (size % 100).alias("tier2_completeness"),
        F.slice(F.array("p_type", "p_brand"), F.lit(1), (size % 3).cast("int")).alias("partner_contacts"),
        F.when(size % 4 != 0, size).alias("tokens"),
        F.col("p_retailprice").alias("elapsed"),
    )
    fields = {"kind": F.col("p_type") != "PROMO", "size": size > 20}
    contacts = {"link": F.size("partner_contacts") > 0, "email": size % 2 == 0}
    return R.write_lanes(results, run_dir(spark, "lanes"), fields, contacts)
