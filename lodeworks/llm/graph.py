"""Connected groups from candidate buckets: star-shaped edges, verified links, components.

No step gathers a bucket, a group of copies or a component in one task or the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of a link ``a, b``; component is the smallest id reached.

    Alternates large-star and small-star rounds until the edges are stars: no node has two
    smaller ones, and none both a smaller and a larger one. The minima are
    stored before they are joined, so that the join may be split where a node is hot (after a
    large-star round only centres that are minima still are, and they have no smaller node).
    """
    edges = store(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    while True:
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(store(least, "minima"), "u").where("v > u")
        edges = store(
            large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges"
        )
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(
            small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct(),
            "edges",
        )
    tips = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tips)


def linked_groups(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id, component`` of all ids linked through ``members`` (``bucket, id``, distinct rows).

    ``verify`` takes candidate pairs ``a, b`` and returns those that are links. Each round
    joins a few hubs of every bucket with the members after them, 1, 16, 256, ... hubs at a
    time; a bucket whose members are all in one component by then is done, and so is a pair
    that a component already joins. When the loop ends, every pair of every bucket has been
    verified or lies in one component, so no link between components is lost, while a
    bucket of n near copies costs about n pairs.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    live = store(members.join(store(sizes.select("bucket"), "buckets"), "bucket"), "members")
    links = None
    groups = None
    passed, step = 0, 1
    while True:
        marked = live.withColumn("c", F.col("id"))
        if groups is not None:
            marked = live.join(groups, "id", "left").withColumn(
                "c", F.coalesce("component", "id")
            )
        marked = store(marked.select("bucket", "id", "c"), "marked")
        mixed = marked.groupBy("bucket").agg(
            F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")
        )
        mixed = store(mixed.where((F.col("lo") < F.col("hi")) & (F.col("n") > passed + 1)), "mixed")
        if mixed.isEmpty():
            break
        live = store(marked.join(mixed.select("bucket"), "bucket"), "live")
        if step == 1:
            hubs = live.groupBy("bucket").agg(F.min(F.struct("id", "c")).alias("h"))
        else:
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
            hubs = live.withColumn("rank", rank).where(F.col("rank") <= passed + step)
            hubs = hubs.where(F.col("rank") > passed).select(
                "bucket", F.struct("id", "c").alias("h")
            )
        hubs = store(hubs.select("bucket", F.col("h.id").alias("a"), F.col("h.c").alias("ac")), "hubs")
        pairs = store(
            live.join(hubs, "bucket")
            .where((F.col("id") > F.col("a")) & (F.col("c") != F.col("ac")))
            .select("a", F.col("id").alias("b"))
            .distinct(),
            "pairs",
        )
        found = store(verify(pairs).select("a", "b"), "links")
        links = found if links is None else store(links.unionByName(found), "links")
        groups = store(components(links), "groups")
        live = live.select("bucket", "id")
        passed, step = passed + step, step * 16
    if groups is None:
        return members.select("id", F.col("id").alias("component")).limit(0)
    return groups
