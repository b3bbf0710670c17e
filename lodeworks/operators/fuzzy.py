"""Fuzzy name matching without comparing all pairs.

Two names within edit distance d share at least one of the d + 1 even segments of
the shorter-indexed name at nearly the same place (the pass-join filter, Li et
al., 2011). Names are folded to distinct values, one side is indexed by (length,
segment number, segment), the other probes the few places where that segment may
stand, and only then is the similarity computed. The filter loses no pair.

A segment that very many names share would make their pairs candidates. Names that hold
such a segment are cut into ``SPARE`` segments more; d edits still leave all but d of them
intact, so any d + 1 serve as an index, and the rarest are taken (a prefix filter): the
common segments stay out of the index as long as no more than ``SPARE`` of a name are common.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.operators.skew import salted_join
from lodeworks.session import cut_lineage

# Names a segment may lie in before it counts as common.
COMMON = 100
SPARE = 4
# A prefix of up to so many names a side gives all their pairs at once: the segments of one name are looked
# up in about as many places. The names of a prefix are dealt to SALTS tasks.
BLOCK = 2000
SALTS = 8

EDIT = "edit"
RATIO = "ratio"


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def block_ratio(a: str, b: str) -> Column:
    """Matching-block ratio of the standard library, on filtered pairs only."""

    # A local function travels to the tasks by value, without this package.
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return F.pandas_udf(score, T.DoubleType())(a, b)


def ratio_open(a: Column, b: Column, threshold: float) -> Column:
    """False where the edit distance rules a block ratio of ``threshold`` out.

    What the matching blocks leave over can be deleted and inserted, and the edit distance is
    no larger: a ratio r leaves ``(1 - r) * (length of a + length of b)`` characters.
    """
    most = F.floor((F.length(a) + F.length(b)) * (1 - threshold) + 1e-9).cast("int")
    return F.call_function("levenshtein", a, b, most) >= 0


def _budget(length: Column, threshold: float, measure: str) -> Column:
    """Largest edit distance any partner above the threshold can have."""
    if measure == EDIT:
        slack = (1 - threshold) / threshold
    else:
        slack = 2 * (1 - threshold) / threshold
    return F.floor(length * slack + 1e-9).cast("int")


def _partner_lengths(length: Column, threshold: float, measure: str) -> Column:
    """Lengths a partner above the threshold can have."""
    low = threshold if measure == EDIT else threshold / (2 - threshold)
    return F.sequence(
        F.greatest(F.ceil(length * low - 1e-9).cast("int"), F.lit(1)),
        F.floor(length / low + 1e-9).cast("int"),
    )


def _segment_start(length: Column, parts: Column, i: Column) -> Column:
    """Zero-based start of even segment ``i``."""
    return F.floor(length * i / parts).cast("int")


def _key(length: Column, part: Column, segment: Column) -> Column:
    """One long per (length, part, segment); a collision only adds a candidate."""
    return F.xxhash64(length, part, segment)


def index_segments(names: DataFrame, name: str, threshold: float, measure: str, spare: int = 0) -> DataFrame:
    """One row per segment: its number ``i`` and its key ``k``."""
    length = F.length(name)
    parts = F.least(_budget(length, threshold, measure) + 1 + spare, length)

    def segment(i: Column) -> Column:
        start = _segment_start(length, parts, i)
        size = _segment_start(length, parts, i + 1) - start
        return F.struct(i.alias("i"), _key(length, i + 1000 * spare, F.substring(F.col(name), start + 1, size)).alias("k"))

    keys = F.transform(F.sequence(F.lit(0), parts - 1), segment)
    return names.filter(length > 0).select(*names.columns, F.explode(keys).alias("s")).select(*names.columns, "s.i", "s.k")


def common_segments(indexed: DataFrame, keys: list[str], common: int) -> DataFrame:
    """Keys that lie in more than ``common`` names: at most 1 / ``common`` of the rows."""
    return indexed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > common).select(*keys)


def rarest_segments(names: DataFrame, name: str, threshold: float, measure: str, keys: list[str]) -> DataFrame:
    """The d + 1 rarest of the finer segments of each name."""
    fine = index_segments(names, name, threshold, measure, SPARE)
    counted = fine.join(fine.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    rarest = Window.partitionBy(name).orderBy("_n", "i")
    wanted = _budget(F.length(name), threshold, measure) + 1
    return counted.withColumn("_r", F.row_number().over(rarest)).filter(F.col("_r") <= wanted).drop("_n", "_r")


def probe_segments(names: DataFrame, name: str, threshold: float, measure: str) -> DataFrame:
    """Every place where a segment of a partner of each possible length may stand.

    The two short lists (partner length, segment number) are exploded row by row,
    so the inner work stays in generated code.
    """
    width = F.length(name)
    rows = names.filter(width > 0).select(
        *names.columns, F.explode(_partner_lengths(width, threshold, measure)).alias("_m")
    )
    m = F.col("_m")
    rows = rows.withColumn("_p", F.least(_budget(m, threshold, measure) + 1, m))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_i"))
    i, parts, shift = F.col("_i"), F.col("_p"), width - m
    start = _segment_start(m, parts, i)
    size = _segment_start(m, parts, i + 1) - start
    # A segment moves by at most the edits on its left and on its right.
    room = parts - 1 - i
    first = F.greatest(start - i, start + shift - room, F.lit(0))
    last = F.least(start + i, start + shift + room, width - size)
    rows = rows.select("*", size.alias("_s"), first.alias("_f"), last.alias("_l")).filter("_f <= _l")
    rows = rows.select("*", F.explode(F.sequence("_f", "_l")).alias("_at"))
    segment = F.substring(F.col(name), F.col("_at") + 1, F.col("_s"))
    return rows.select(*names.columns, _key(m, i, segment).alias("k"))


def probe_finer(names: DataFrame, name: str, threshold: float, measure: str, lengths: DataFrame) -> DataFrame:
    """Every place of a finer segment of a partner whose length is listed in ``lengths``.

    A segment that is intact moves by the edits on its left; those and the ones on its right
    come to the budget at most, and differ by the difference of the lengths.
    """
    width = F.length(name)
    rows = names.filter(width > 0).select(
        *names.columns, F.explode(_partner_lengths(width, threshold, measure)).alias("_m")
    )
    m = F.col("_m")
    # At most one row per length of a name.
    rows = rows.join(F.broadcast(lengths.select(F.col("length").alias("_m"))), "_m")
    budget = _budget(m, threshold, measure)
    rows = rows.withColumn("_p", F.least(budget + 1 + SPARE, m))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_i"))
    i, parts, shift = F.col("_i"), F.col("_p"), width - m
    start = _segment_start(m, parts, i)
    size = _segment_start(m, parts, i + 1) - start
    first = F.greatest(start + F.ceil((shift - budget) / 2).cast("int"), F.lit(0))
    last = F.least(start + F.floor((shift + budget) / 2).cast("int"), width - size)
    rows = rows.select("*", size.alias("_s"), first.alias("_f"), last.alias("_l")).filter("_f <= _l")
    rows = rows.select("*", F.explode(F.sequence("_f", "_l")).alias("_at"))
    segment = F.substring(F.col(name), F.col("_at") + 1, F.col("_s"))
    return rows.select(*names.columns, _key(m, i + 1000 * SPARE, segment).alias("k"))


def block_pairs(a_names: DataFrame, b_names: DataFrame, near: Column) -> DataFrame:
    """The pairs (a, b) of each prefix that are ``near``."""
    parts = int(a_names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    a_side = a_names.filter(F.length("a") > 0).withColumn("_salt", salt)
    b_side = b_names.filter(F.length("b") > 0).withColumn("_salt", every)
    keys = ["pre", "_salt"]
    # Few bytes, much work: a number of partitions that is not merged again.
    met = a_side.repartition(parts, *keys).join(b_side.repartition(parts, *keys), keys)
    return met.filter(near).select("a", "b")


def candidate_pairs(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    measure: str,
    near: Column,
    same_prefix: int = 0,
    common: int = COMMON,
    block: int = BLOCK,
) -> DataFrame:
    """Distinct pairs (a, b) that share a segment and are ``near``; no similar pair is missing.

    With ``same_prefix``, the names of a prefix with up to twice ``block`` on both sides are compared at once.
    """

    def with_prefix(names: DataFrame, name: str) -> DataFrame:
        return names.withColumn("pre", F.left(name, F.lit(same_prefix))) if same_prefix else names

    keys = ["k", "pre"] if same_prefix else ["k"]
    # Stored once: the rows behind the distinct names are read again for every use otherwise.
    a_names = cut_lineage(with_prefix(left.select("a").distinct(), "a"))
    b_names = cut_lineage(with_prefix(right.select("b").distinct(), "b"))
    if same_prefix:
        wide = a_names.select("pre").unionByName(b_names.select("pre"))
        wide = wide.groupBy("pre").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * block).select("pre")
        wide = cut_lineage(wide)
        at_once = block_pairs(a_names.join(wide, "pre", "left_anti"), b_names.join(wide, "pre", "left_anti"), near)
        if wide.isEmpty():
            return at_once
        a_names, b_names = (x.join(wide, "pre", "left_semi") for x in (a_names, b_names))
        return at_once.unionByName(_segment_pairs(a_names, b_names, keys, threshold, measure, near, common))
    return _segment_pairs(a_names, b_names, keys, threshold, measure, near, common)


def _segment_pairs(
    a_names: DataFrame, b_names: DataFrame, keys: list[str], threshold: float, measure: str, near: Column, common: int
) -> DataFrame:
    """Distinct pairs that share a segment and are ``near``."""
    index = index_segments(b_names, "b", threshold, measure)
    often = cut_lineage(common_segments(index, keys, common))
    if often.isEmpty():
        pairs = probe_segments(a_names, "a", threshold, measure).join(index.drop("i"), keys)
        return pairs.filter(near).select("a", "b").distinct()
    held = cut_lineage(index.join(often, keys, "left_semi").select(*b_names.columns).distinct())
    plain = index.join(held.select("b"), "b", "left_anti").drop("i")
    fine = rarest_segments(held, "b", threshold, measure, keys).drop("i")
    lengths = held.select(F.length("b").alias("length")).distinct()
    probes = probe_segments(a_names, "a", threshold, measure)
    finer = probe_finer(a_names, "a", threshold, measure, lengths)
    # What is common even among the rarest segments is spread over tasks.
    found = salted_join(probes, plain, keys, "a", near, counted=plain).select("a", "b")
    more = salted_join(finer, fine, keys, "a", near, counted=fine).select("a", "b")
    return found.unionByName(more).distinct()


def similar_names(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    *,
    measure: str = EDIT,
    strict: bool = True,
    same_prefix: int = 0,
    max_length_gap: int | None = None,
    common: int = COMMON,
) -> DataFrame:
    """Pairs (a, b, sim) of distinct names from two one-column tables ``a`` and ``b``."""
    ca, cb = F.col("a"), F.col("b")
    near = F.lit(True)
    if max_length_gap is not None:
        near = F.abs(F.length(ca) - F.length(cb)) <= max_length_gap
    if measure == EDIT:
        sim = edit_similarity(ca, cb)
        near = near & ((sim > threshold) if strict else (sim >= threshold))
        return candidate_pairs(left, right, threshold, measure, near, same_prefix, common).withColumn("sim", sim)
    pairs = candidate_pairs(left, right, threshold, measure, near & ratio_open(ca, cb, threshold), same_prefix, common)
    scored = pairs.withColumn("sim", block_ratio("a", "b"))
    return scored.filter(F.col("sim") > threshold if strict else F.col("sim") >= threshold)


def conflict_edges(
    df: DataFrame, name: str, order: str, threshold: float, **options
) -> tuple[DataFrame, DataFrame]:
    """Distinct names with their first position, and (earlier, later) conflict edges."""
    nodes = df.groupBy(name).agg(F.min(order).alias(order))
    pairs = similar_names(
        nodes.select(F.col(name).alias("a")),
        nodes.select(F.col(name).alias("b")),
        threshold,
        **options,
    ).filter(F.col("a") != F.col("b"))
    at_a = nodes.select(F.col(name).alias("a"), F.col(order).alias("pa"))
    at_b = nodes.select(F.col(name).alias("b"), F.col(order).alias("pb"))
    placed = pairs.join(at_a, "a").join(at_b, "b")
    edges = placed.select(
        F.least("pa", "pb").alias("earlier"), F.greatest("pa", "pb").alias("later")
    )
    return nodes, edges


def best_match(
    wanted: DataFrame, backup: DataFrame, threshold: float, measure: str = EDIT
) -> DataFrame:
    """For each wanted name: the exact backup name, else the most similar one.

    ``wanted`` has ``a``; ``backup`` has ``b`` and ``ord``. Ties go to the earlier row.
    """
    firsts = backup.groupBy("b").agg(F.min("ord").alias("ord"))
    names = wanted.select("a").distinct()
    exact = names.join(firsts, F.col("a") == F.col("b")).select(
        "a", "b", "ord", F.lit(1.0).alias("sim")
    )
    rest = names.join(exact.select("a"), "a", "left_anti")
    pairs = similar_names(rest, firsts, threshold, measure=measure, strict=False).join(firsts, "b")
    best = (
        pairs.groupBy("a")
        .agg(F.max_by(F.struct("b", "ord", "sim"), F.struct("sim", -F.col("ord"))).alias("m"))
        .select("a", "m.b", "m.ord", "m.sim")
    )
    return exact.unionByName(best)


def restore_missing(
    wanted: DataFrame, name: str, present: DataFrame, present_name: str, backup: DataFrame, threshold: float
) -> DataFrame:
    """Wanted rows whose name is not present, with the best backup row (``ord``) from the threshold on.

    The restored row goes by the wanted name; rows without a similar backup stay out.
    """
    gone = wanted.join(present.select(F.col(present_name).alias(name)).distinct(), name, "left_anti")
    found = best_match(gone.select(F.col(name).alias("a")), backup, threshold)
    return gone.join(found.select(F.col("a").alias(name), "ord", "sim"), name)
