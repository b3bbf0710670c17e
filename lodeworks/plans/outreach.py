"""Outreach items bound to the events table, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.operators import funnel as P
from lodeworks.plans.registry import query, table
from lodeworks.streaming import ingest, outreach

STATUSES = ["new", "contacted", "replied", "meeting", "term_sheet", "closed"]
STEP = "case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 3 else least(greatest(cast(floor(value / 100) as int), 1), 6) end"
OP = "case when event_type = 'error' and value > 350 then 'delete' else 'move' end"


def changes(events):
    kind = F.col("event_type")
    step = (
        F.when(kind == "signup", 1)
        .when(kind == "view", 2)
        .when(kind == "click", 3)
        .otherwise(P.clamp_step(F.floor(F.col("value") / 100).cast("int")))
    )
    op = F.when((kind == "error") & (F.col("value") > 350), "delete").otherwise("move")
    return events.select("event_id", "ts", "user_id", step.cast("int").alias("step"), op.alias("op"))


LATEST = f"""(select user_id, step, ts from (select user_id, {STEP} as step, {OP} as op, ts from events
   qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where op <> 'delete')"""


def state(spark, sf):
    return P.current_state(
        changes(table(spark, sf, "events")), "user_id", ["ts", "event_id"], ["step", "ts"], "op"
    )


@query(
    "add_items",
    "E1",
    """select p_partkey, trim(p_name) as company, cast(least(greatest(p_size % 9 - 1, 1), 6) as integer) as step,
         ['new', 'contacted', 'replied', 'meeting', 'term_sheet', 'closed'][least(greatest(p_size % 9 - 1, 1), 6)] as status from part where p_type <> 'PROMO'""",
)
def add_items(spark, sf):
    company = F.when(F.col("p_type") == "PROMO", "  ").otherwise(F.concat(F.lit(" "), "p_name"))
    rows = table(spark, sf, "part").select(
        "p_partkey", company.alias("company"), (F.col("p_size") % 9 - 1).alias("step")
    )
    return P.new_items(rows, "company", "step", STATUSES)


@query(
    "item_state",
    "E2",
    f"""select l.user_id, l.step, n.n_events from {LATEST} l join (select user_id, count(*) as n_events from events group by 1) n on l.user_id = n.user_id""",
)
def item_state(spark, sf):
    return state(spark, sf).select("user_id", "step", "n_events")


@query(
    "item_history",
    "E3",
    """select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events""",
)
def item_history(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    rows = P.history(events, "user_id", [F.desc("ts"), F.desc("event_id")])
    return rows.select("user_id", "event_id", "position")


@query(
    "funnel_steps",
    "A13 E4",
    f"""with s as (select unnest(generate_series(1, 6))::int as step), c as (select step, count(*) as n from {LATEST} group by 1),
       f as (select s.step, coalesce(n, 0) as n_rows from s left join c on s.step = c.step),
       r as (select step, n_rows, cast(sum(n_rows) over (order by step desc) as bigint) as reached, sum(n_rows) over () as total from f)
       select step, n_rows, reached, round(100.0::double * n_rows / total, 2) as pct,
         round(100.0::double * lead(reached) over (order by step) / nullif(reached, 0), 2) as advance_pct from r""",
)
def funnel_steps(spark, sf):
    return P.funnel(state(spark, sf), "step")


@query(
    "funnel_totals",
    "A14 E4",
    f"""select count(*) as n_total, count(*) filter (where step < 6) as n_active, count(*) filter (where step = 6) as n_done,
         count(*) filter (where step < 6 and floor((epoch(timestamp '2024-02-06 00:00:00') - floor(epoch(ts))) / 86400) >= 7) as n_stale from {LATEST}""",
)
def funnel_totals(spark, sf):
    as_of = F.lit("2024-02-06 00:00:00").cast("timestamp")
    return P.funnel_totals(state(spark, sf), "step", "ts", as_of)


@query(
    "delete_owned_items",
    "E7",
    """select o_orderkey, owner, case when owner = o_custkey then 'deleted' else 'not_found' end as outcome
       from (select o_orderkey, o_custkey, case when o_orderpriority = '5-LOW' then -1 else o_custkey end as owner from orders where o_orderstatus = 'F')""",
)
def delete_owned_items(spark, sf):
    orders = table(spark, sf, "orders")
    owner = F.when(F.col("o_orderpriority") == "5-LOW", -1).otherwise(F.col("o_custkey"))
    requests = orders.filter("o_orderstatus = 'F'").select("o_orderkey", owner.alias("owner"))
    items = orders.select("o_orderkey", F.col("o_custkey").alias("owner"))
    return P.delete_owned(items, requests, "o_orderkey", "owner")[1]


@query(
    "kept_after_delete",
    "E7 S12",
    "select o_orderkey from orders where not (o_orderstatus = 'F' and o_orderpriority <> '5-LOW')",
)
def kept_after_delete(spark, sf):
    orders = table(spark, sf, "orders")
    owner = F.when(F.col("o_orderpriority") == "5-LOW", -1).otherwise(F.col("o_custkey"))
    requests = orders.filter("o_orderstatus = 'F'").select("o_orderkey", owner.alias("owner"))
    items = orders.select("o_orderkey", F.col("o_custkey").alias("owner"))
    return P.delete_owned(items, requests, "o_orderkey", "owner")[0].select("o_orderkey")


def event_stream(spark, sf):
    return ingest.open_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


@query(
    "stream_ingest",
    "E5 S7 S10",
    "select event_type, count(*) as n_rows, min(event_id) as first_id, max(event_id) as last_id from events group by 1",
)
def stream_ingest(spark, sf):
    rows = ingest.run_to_table(event_stream(spark, sf).select("event_id", "event_type"), "ingest")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "stream_first_seen",
    "E6 W5",
    "select distinct user_id, event_type from events",
)
def stream_first_seen(spark, sf):
    keyed = event_stream(spark, sf).select("user_id", "event_type", "ts")
    seen = ingest.first_seen(keyed, ["user_id", "event_type"])
    return ingest.run_to_table(seen, "seen").select("user_id", "event_type")


@query("stream_item_state", "E2", f"select user_id, step from {LATEST}")
def stream_item_state(spark, sf):
    return outreach.fold_to_table(
        changes(event_stream(spark, sf)), "user_id", ["ts", "event_id"], ["step"], "op"
    )
