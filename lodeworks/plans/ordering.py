"""Sorts and small list operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions.exprs import distinct_slice
from lodeworks.plans.registry import query, table


@query(
    "composite_order",
    "W9",
    "select p_partkey, p_type, p_size, p_name from part",
)
def composite_order(spark, sf):
    """Focused types first, then score descending, then name."""
    focused = F.when(F.col("p_type") == "PROMO", 1).otherwise(0)
    return (
        table(spark, sf, "part")
        .select("p_partkey", "p_type", "p_size", "p_name")
        .orderBy(focused, F.desc("p_size"), F.asc("p_name"))
    )


@query(
    "facet_order",
    "W10",
    "select p_partkey, p_brand, case when p_size > 5 then p_type end as region from part",
)
def facet_order(spark, sf):
    """Chosen column by locale order; a null region sorts last, other nulls first."""
    rows = table(spark, sf, "part").select(
        "p_partkey", "p_brand", F.when(F.col("p_size") > 5, F.col("p_type")).alias("region")
    )
    return rows.orderBy(
        F.collate(F.coalesce("region", F.lit("zzz")), "UNICODE"), F.collate("p_brand", "UNICODE")
    )


@query(
    "distinct_first_items",
    "W11",
    """with t as (select doc_id, regexp_extract_all(text, '[A-Z][a-z]+') as w from documents)
       select doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], ',') as items from t""",
)
def distinct_first_items(spark, sf):
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(distinct_slice(found, 5), ",").alias("items")
    )


@query(
    "user_latest_analysis",
    "W6 S11",
    """select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
)
def user_latest_analysis(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")
        )
        .select("o_custkey", "r.o_orderkey", "r.o_totalprice")
    )
