"""Exact and keyed duplicate removal, including greedy first-wins removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.skew import keyed_lookup
from lodeworks.session import cut_lineage


def keep_best(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    ``row_number() = 1`` lets Spark keep one row per key and partition before the
    shuffle, so a hot key moves one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return keep_best(df, [key], [F.asc(order)])


def settle_chains(pointers: DataFrame, key: str) -> DataFrame:
    """``key, kept`` of the rows whose chain of deciders ends in a row that is kept for certain.

    ``pointers``: ``key``, ``to`` (the one earlier row that decides it, null: none, it is kept);
    rows with two open deciders are not listed, and chains that end in one stay open. A row is
    kept if its decider is not, so a chain alternates from its end. Every pass doubles the
    distance a row looks along its chain: a chain of n rows takes log2(n) passes.
    """
    state = cut_lineage(pointers.select(key, "to", F.lit(False).alias("odd")))
    while True:
        ahead = state.filter(F.col("to").isNotNull())
        if ahead.isEmpty():
            break
        step = state.select(F.col(key).alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
        moved = ahead.join(step, "to").select(
            key, F.col("_to").alias("to"), (F.col("odd") == F.col("_odd")).alias("odd")
        )
        state = cut_lineage(state.filter(F.col("to").isNull()).unionByName(moved))
    # The end of a chain is kept; a row an odd number of steps away is not.
    return state.select(key, (~F.col("odd")).alias("kept"))


def _first_two(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The first two rows of each group, with the first one's order; a task sends two at most."""
    w = Window.partitionBy(group).orderBy(order)
    return (
        rows.filter(F.col(group).isNotNull())
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= 2)
        .withColumn("_head", F.first(order).over(w))
        .select(order, "_n", "_head")
    )


# Passes that look for names whose first row may go; after them all rows are decided in rounds.
FIRST_ROW_PASSES = 4


def _contested(heads: DataFrame, rows: DataFrame):
    """``_first`` of the names whose first row may lose its second key, or None if the passes
    do not find them all.

    ``heads``: the first row of each name; ``rows``: all rows. The first row of any other name is
    kept: an earlier kept row with its second key would be the first row of such a name too, or a
    row of a contested name, and both are looked for here.
    """
    at = heads.select("_first", "_second", "_at").filter(F.col("_second").isNotNull())
    w = Window.partitionBy("_second").orderBy("_at")
    new = at.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > 1).select("_first")
    found = new = cut_lineage(new)
    for _ in range(FIRST_ROW_PASSES):
        if new.isEmpty():
            return found
        theirs = rows.join(new, "_first", "left_semi").filter(F.col("_second").isNotNull())
        theirs = theirs.groupBy("_second").agg(F.min("_at").alias("_by"))
        late = at.join(theirs, "_second").filter(F.col("_by") < F.col("_at")).select("_first")
        new = cut_lineage(late.join(found, "_first", "left_anti"))
        found = cut_lineage(found.unionByName(new))
    return found if new.isEmpty() else None


def greedy_by_keys(df: DataFrame, order: str, first_key: str, second_key: str) -> DataFrame:
    """Greedy first-wins removal where sharing either key is a conflict.

    A row stays when no earlier kept row shares its first key (null counts as the empty
    text) or its second key (null and empty share with nobody); a dropped row cannot drop
    others. Rows that tie in ``order`` follow one another by their keys; of rows that agree in
    all three one stays.

    At most one row of a first key stays, mostly its first one: those whose second key no other
    name can take before (``_contested``) are kept at once, and only the rows of the other names
    are decided. They are folded to one per key pair (a later copy always loses). Then, in rounds: a row that is first under both its keys is kept; a row that is first under
    one and second under the other is kept if that other key's first row is not, which
    ``settle_chains`` follows along whole chains of such rows; and all rows that share a key with
    a kept one are dropped. A chain, however long, takes one round; rounds count only
    how often rows with two open deciders follow one another. No pair of rows is ever built.
    """
    first = F.coalesce(F.col(first_key).cast("string"), F.lit(""))
    second = F.nullif(F.col(second_key).cast("string"), F.lit(""))
    first_key, second_key, given, order = "_first", "_second", order, "_at"
    place = F.struct(F.col(given).alias("o"), first.alias("a"), F.coalesce(second, F.lit("")).alias("b"))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(first.alias(first_key), second.alias(second_key), place.alias(order), whole)
    heads = cut_lineage(
        rows.groupBy(first_key).agg(F.min_by(F.struct(second_key, order, "_row"), order).alias("_r")).select(first_key, "_r.*")
    )
    contested, sure = _contested(heads, rows), None
    if contested is not None:
        sure = heads.join(contested, first_key, "left_anti")
        taken = sure.select(second_key).filter(F.col(second_key).isNotNull())
        rows = cut_lineage(rows.join(contested, first_key, "left_semi"))
        undecided = rows.join(taken, second_key, "left_anti").select(first_key, second_key, order)
        sure = sure.select("_row.*")
    else:
        undecided = rows
    undecided = cut_lineage(undecided.groupBy(first_key, second_key).agg(F.min(order).alias(order)))
    kept = None
    while not undecided.isEmpty():
        one = _first_two(undecided, first_key, order).withColumnsRenamed({"_n": "_n1", "_head": "_h1"})
        two = _first_two(undecided, second_key, order).withColumnsRenamed({"_n": "_n2", "_head": "_h2"})
        alone = undecided.filter(F.col(second_key).isNull()).select(
            order, F.lit(1).alias("_n2"), F.col(order).alias("_h2")
        )
        heads = one.join(two.unionByName(alone), order)
        # Rows that are second twice, or deeper under a key, have two deciders or more.
        pointers = heads.filter(F.col("_n1") + F.col("_n2") < 4).select(
            order, F.when(F.col("_n1") == 2, F.col("_h1")).when(F.col("_n2") == 2, F.col("_h2")).alias("to")
        )
        stay = settle_chains(pointers, order).filter("kept").select(order)
        stay = cut_lineage(undecided.join(stay, order))
        kept = stay.select(order) if kept is None else kept.unionByName(stay.select(order))
        gone1 = stay.select(first_key).distinct().withColumn("_g1", F.lit(True))
        gone2 = (
            stay.select(second_key)
            .filter(F.col(second_key).isNotNull())
            .distinct()
            .withColumn("_g2", F.lit(True))
        )
        left = keyed_lookup(undecided, gone1, first_key).filter(F.col("_g1").isNull()).drop("_g1")
        left = keyed_lookup(left, gone2, second_key).filter(F.col("_g2").isNull()).drop("_g2")
        undecided = cut_lineage(left.select(first_key, second_key, order))
    if kept is None:
        return df if sure is None else sure
    rest = rows.join(kept, order, "left_semi").dropDuplicates([order]).select("_row.*")
    return rest if sure is None else sure.unionByName(rest)


def greedy_by_edges(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Greedy first-wins removal on a conflict edge table (earlier, later).

    In rounds: a node that is never the later end is kept; a node that is the later end of one
    edge is kept if its partner is not, along whole chains (``settle_chains``); the later
    partners of kept nodes are dropped, and edges touching a decided node are removed.
    """
    edges = cut_lineage(edges.select("earlier", "later").distinct())
    dropped = None
    while not edges.isEmpty():
        into = edges.groupBy(F.col("later").alias("n")).agg(F.min("earlier").alias("to"), F.count("*").alias("open"))
        roots = edges.select(F.col("earlier").alias("n")).distinct().join(into.select("n"), "n", "left_anti")
        pointers = (
            into.filter("open = 1")
            .select("n", "to")
            .unionByName(roots.select("n", F.lit(None).cast(edges.schema["later"].dataType).alias("to")))
        )
        stay = settle_chains(pointers, "n").filter("kept").select(F.col("n").alias("earlier"))
        stay = cut_lineage(stay)
        gone = cut_lineage(edges.join(stay, "earlier", "left_semi").select("later").distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        edges = cut_lineage(
            edges.join(stay, "earlier", "left_anti")
            .join(stay.select(F.col("earlier").alias("later")), "later", "left_anti")
            .join(gone.select(F.col("later").alias("earlier")), "earlier", "left_anti")
            .join(gone, "later", "left_anti")
        )
    if dropped is None:
        return nodes
    return nodes.join(dropped.select(F.col("later").alias(key)), key, "left_anti")
