"""Ranking firms for many request profiles at once.

The score of a pair is ``base * (0.60 + 0.80 * tier2) * confidence``: ``tier2`` and all gates
depend on the *soft* features of both sides, ``base`` on their *anchors* (sub-sector tags).
Both sides are folded to signatures of each kind, so soft pairs are gated and scored once
(blocked on sector and stage), and anchor pairs that share a tag once (joined on the tag; all
others are one of two fixed bases). The two meet by a threshold rule instead of by all pairs:

1. a firm's soft signature is a block; its best anchor for a profile bounds the block's scores,
   and a part of that bound is known to be reached;
2. per profile, the ``top_n``-th best reached score is the threshold;
3. only blocks whose bound is not below it are opened, firm signature by firm signature.

Every opened pair gets its exact score, and equal scores rank by input order, so the result
equals scoring every profile against every firm. Only ranked firms meet texts and vectors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as X
from lodeworks.functions.exprs import (
    STRINGS,
    all_of,
    any_of,
    contains_any,
    count_hits,
    labels,
    lookup,
    nonzero,
    round_to,
    str_array,
)
from lodeworks.operators.joins import amount_multiplier
from lodeworks.operators.skew import salted_join
from lodeworks.session import cut_lineage

# Fixed values of the scoring rules.
DIM_WEIGHTS = {"business_model": 0.25, "traction": 0.30, "team": 0.20, "lead": 0.10, "geo_soft": 0.15}
CONFIDENCE = {"high": 1.0, "medium": 0.85, "low": 0.65}
CONFIDENCE_UNKNOWN = 0.4
CONFIDENCE_NO_PROFILE = 0.8
BASE_NO_DATA = 0.20
BASE_MISMATCH = 0.03
NARROWED = 0.6
COMPLETENESS_DEFAULT = 70
GENERALIST = "generalist"
ANYWHERE = ("global", "us_agnostic")


@dataclass(frozen=True)
class Domain:
    name: str
    tags: Sequence[str]
    strong: Sequence[str] = ()
    weak: Sequence[str] = ()
    signals: Sequence[str] = ()


@dataclass(frozen=True)
class MatchVocab:
    """Vocabularies of the matcher; all are inputs."""

    synonyms: Mapping[str, str] = field(default_factory=dict)
    domains: Sequence[Domain] = ()
    city_tags: Mapping[str, str] = field(default_factory=dict)
    portfolio_tags: Sequence[tuple[str, str]] = ()
    indications: Mapping[str, Sequence[str]] = field(default_factory=dict)
    valued_team: Sequence[str] = ()
    stopwords: Sequence[str] = ()
    grant_words: Sequence[str] = ("grant",)
    grant_path: str = "/grant-submission"


def canonical(tags: Column, synonyms: Mapping[str, str]) -> Column:
    """Synonyms applied, distinct, sorted; null becomes empty."""
    base = F.coalesce(tags, F.array().cast(STRINGS))
    if synonyms:
        base = F.transform(base, lambda t: F.coalesce(lookup(dict(synonyms), t), t))
    return F.sort_array(F.array_distinct(base))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def infer_tags(portfolio: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Tags whose keyword occurs in the joined texts of the portfolio, sorted."""
    texts = F.transform(
        portfolio,
        lambda c: F.concat_ws(
            " ",
            F.coalesce(F.lower(c["name"]), F.lit("")),
            F.coalesce(F.lower(c["founder_background"]), F.lit("")),
            F.coalesce(F.lower(c["sector"]), F.lit("")),
        ),
    )
    joined = F.coalesce(F.array_join(texts, " "), F.lit(""))
    return F.sort_array(F.array_distinct(labels((joined.contains(k), t) for k, t in pairs)))


def intent_multipliers(thesis: Column, domains: Sequence[Domain]) -> Column:
    """One multiplier per domain from the thesis text; 0 drops the firm."""
    low = F.lower(F.coalesce(thesis, F.lit("")))
    out = []
    for d in domains:
        strong, weak = count_hits(low, d.strong), count_hits(low, d.weak)
        silent = ~contains_any(low, d.signals)
        out.append(
            F.when(strong >= 2, 0.0)
            .when(strong == 1, 0.4)
            .when((weak >= 2) & silent, 0.0)
            .when((weak >= 1) & silent, 0.6)
            .otherwise(1.0)
        )
    return F.array(*out) if out else F.array().cast("array<double>")


def detect_domain(tags: Column, domains: Sequence[Domain]) -> Column:
    """Index of the domain with most tag overlap, ties to the earlier one, null if none."""
    if not domains:
        return F.lit(None).cast("int")
    rows = [
        F.struct(
            F.size(F.array_intersect(tags, str_array(d.tags))).alias("n"), F.lit(-i).alias("at")
        )
        for i, d in enumerate(domains)
    ]
    best = F.array_max(F.array(*rows))
    return F.when(best["n"] > 0, -best["at"])


def profile_confidence(has_profile: Column, levels: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for c in levels:
        value = F.lit(CONFIDENCE_UNKNOWN)
        for name, v in CONFIDENCE.items():
            value = F.when(c == name, v).otherwise(value)
        total = total + value
    return F.when(has_profile, total / float(len(levels))).otherwise(CONFIDENCE_NO_PROFILE)


def signature(*columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def split_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles that can be scored, and those refused: neither a structured profile nor tags.

    The refused lane carries a ``reason``; the matcher never scores its rows.
    """
    scorable = F.coalesce(F.col("has_profile"), F.lit(False)) | F.col("sub_sector_tags").isNotNull()
    return profiles.filter(scorable), profiles.filter(~scorable).withColumn(
        "reason", F.lit("neither profile nor sub_sector_tags")
    )


def profile_features(profiles: DataFrame, vocab: MatchVocab) -> DataFrame:
    """Profile id and the features that decide its scores, all computed once per profile.

    ``p`` holds the soft features, ``pa`` the anchor; ``psig`` names both and the confidence.
    """
    c = F.col
    narrative = F.lower(F.coalesce(c("narrative_text"), F.lit("")))
    asked = nonzero(c("raise_value"))
    city = F.trim(F.split(F.lower(F.coalesce(c("geo_city"), F.lit(""))), ",")[0])
    lowered = F.transform(F.coalesce(c("sector_tags"), F.array().cast(STRINGS)), F.lower)
    silent = [~contains_any(narrative, s) for s in vocab.indications.values()]
    return (
        profiles.select(
            "profile_id",
            F.struct(
                c("funding_stage").alias("stage"),
                F.coalesce(nonzero(c("raise_min")), asked).alias("raise_min"),
                F.coalesce(nonzero(c("raise_max")), asked).alias("raise_max"),
                canonical(c("sector_tags"), vocab.synonyms).alias("sectors"),
                lookup(dict(vocab.city_tags), city).alias("geo"),
                c("seeking_lead").alias("lead"),
                F.sort_array(F.array_distinct(F.coalesce(c("business_model"), F.array().cast(STRINGS)))).alias("models"),
                c("arr_usd").alias("arr"),
                F.coalesce(c("pre_revenue"), F.lit(False)).alias("pre"),
                F.sort_array(F.array_distinct(F.coalesce(c("team_background"), F.array().cast(STRINGS)))).alias("team"),
                detect_domain(canonical(lowered, vocab.synonyms), vocab.domains).alias("domain"),
            ).alias("p"),
            F.struct(
                F.sort_array(
                    F.filter(
                        F.transform(
                            F.coalesce(c("sub_sector_tags"), F.array().cast(STRINGS)),
                            lambda t: F.lower(F.trim(t)),
                        ),
                        lambda t: t != "",
                    )
                ).alias("subs"),
                (F.array(*silent) if silent else F.array().cast("array<boolean>")).alias("silent"),
            ).alias("pa"),
            profile_confidence(
                c("has_profile"), [c("conf_stage"), c("conf_sector"), c("conf_geo"), c("conf_raise")]
            ).alias("confidence"),
        )
        .withColumn("psoft", signature("p"))
        .withColumn("panch", signature("pa"))
        .withColumn("psig", F.md5(F.concat("psoft", "panch", F.col("confidence").cast("string"))))
    )


def firm_features(firms: DataFrame, vocab: MatchVocab) -> DataFrame:
    """Firms that can match at all, with the features that decide their scores.

    ``f`` holds the soft features, ``fa`` the anchor; ``fsig`` names both.
    """
    c = F.col
    thesis = F.lower(F.coalesce(c("thesis_text"), F.lit("")))
    grant_giver = (c("investor_type") == "other") & (
        contains_any(thesis, vocab.grant_words)
        | F.endswith(F.coalesce(c("submission_url"), F.lit("")), F.lit(vocab.grant_path))
    )
    tags = canonical(
        F.transform(F.coalesce(c("sub_tags"), F.array().cast(STRINGS)), F.lower), vocab.synonyms
    )
    narrow = F.array_except(tags, F.array(F.lit(GENERALIST)))
    focused = [
        count_hits(thesis, s) >= 2 for s in vocab.indications.values()
    ]

    def listed(name: str) -> Column:
        return F.sort_array(F.array_distinct(F.coalesce(c(name), F.array().cast(STRINGS))))

    kept = firms.filter(
        ~c("is_real_investor").eqNullSafe(F.lit(False)) & ~F.coalesce(grant_giver, F.lit(False))
    )
    return (
        kept.select(
            "*",
            F.struct(
                listed("stages").alias("stages"),
                c("check_size_min_usd").alias("check_min"),
                c("check_size_max_usd").alias("check_max"),
                canonical(c("sectors"), vocab.synonyms).alias("sectors"),
                listed("geo_focus").alias("geo"),
                intent_multipliers(c("thesis_text"), vocab.domains).alias("intent"),
                listed("business_model_preference").alias("models"),
                c("pre_revenue_ok").alias("pre_ok"),
                c("min_arr_usd").alias("min_arr"),
                listed("team_background_preference").alias("team"),
                c("lead_investor").alias("lead"),
                F.coalesce(nonzero(c("tier1_completeness")), F.lit(COMPLETENESS_DEFAULT)).alias("filled"),
            ).alias("f"),
            F.struct(
                (F.array(*focused) if focused else F.array().cast("array<boolean>")).alias("focused"),
                narrow.alias("subs"),
                ((F.size(tags) > 0) & (F.size(narrow) == 0)).alias("generalist"),
                infer_tags(c("portfolio_companies"), vocab.portfolio_tags).alias("inferred"),
            ).alias("fa"),
        )
        .withColumn("fsoft", signature("f"))
        .withColumn("fanch", signature("fa"))
        .withColumn("fsig", F.md5(F.concat("fsoft", "fanch")))
    )


# Profile signatures up to this many key rows (a few tens of MB) are broadcast.
BROADCAST_ROWS = 100_000
NONE_KEY, ALL_KEY = "*none", "*all"


def _offered(values: Column) -> Column:
    """Block keys of a firm: its values (or the empty mark) and the catch-all."""
    own = F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(NONE_KEY)))
    return F.concat(own, F.array(F.lit(ALL_KEY)))


def _asked(values: Column) -> Column:
    """Block keys of a profile: its values and the empty mark, or only the catch-all."""
    return F.when(F.size(values) > 0, F.concat(values, F.array(F.lit(NONE_KEY)))).otherwise(
        F.array(F.lit(ALL_KEY))
    )


def blocked_pairs(profile_sigs: DataFrame, firm_sigs: DataFrame) -> DataFrame:
    """Pairs of soft signatures that pass the sector and stage gates, each exactly once."""
    stage = F.when(F.col("p.stage").isNull(), F.array().cast(STRINGS)).otherwise(F.array("p.stage"))
    asked = (
        profile_sigs.select("*", F.explode(_asked(F.col("p.sectors"))).alias("k1"))
        .select("*", F.explode(_asked(stage)).alias("k2"))
    )
    offered = (
        firm_sigs.select("*", F.explode(_offered(F.col("f.sectors"))).alias("k1"))
        .select("*", F.explode(_offered(F.col("f.stages"))).alias("k2"))
    )
    # A pair that shares several tags meets at the smallest one only.
    once = F.startswith("k1", F.lit("*")) | (
        F.col("k1") == F.array_min(F.array_intersect("p.sectors", "f.sectors"))
    )
    # The pairs outnumber the inputs by far, so the work is spread by signature over
    # all cores; few profile signatures (counted here) travel to the firms, many are
    # shuffled by key with hot keys salted.
    spark = firm_sigs.sparkSession
    if asked.count() <= BROADCAST_ROWS:
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spread = offered.repartition(parts, "fsoft")
        pairs = spread.join(F.broadcast(asked), ["k1", "k2"]).filter(once)
    else:
        pairs = salted_join(offered, asked, ["k1", "k2"], "fsoft", once)
    return pairs.drop("k1", "k2")


def gates(pairs: DataFrame) -> DataFrame:
    """The remaining gates with the multipliers they yield."""
    p, f = (lambda n: F.col(f"p.{n}")), (lambda n: F.col(f"f.{n}"))
    geo_ok = (
        (F.size(f("geo")) == 0)
        | F.arrays_overlap(f("geo"), str_array(ANYWHERE))
        | F.coalesce(F.array_contains(f("geo"), p("geo")), F.lit(False))
    )
    return (
        pairs.filter(geo_ok)
        .withColumn("amount", amount_multiplier(f("check_min"), f("check_max"), p("raise_min"), p("raise_max")))
        .withColumn("intent", F.coalesce(F.get(f("intent"), p("domain")), F.lit(1.0)))
        .withColumn("traction", traction_score(p("arr"), p("pre"), f("pre_ok"), f("min_arr")))
        .filter("amount > 0 and intent > 0 and traction > 0")
    )


def traction_score(arr: Column, pre: Column, pre_ok: Column, min_arr: Column) -> Column:
    need = nonzero(min_arr)
    barred = F.coalesce(~pre_ok, F.lit(False)) & pre
    return (
        F.when(barred, 0.0)
        .when(need.isNotNull() & arr.isNull(), 0.2)
        .when(need.isNotNull() & (arr >= need), 1.0)
        .when(need.isNotNull(), F.greatest(F.lit(0.1), F.try_divide(arr, need.cast("double"))))
        .when(arr >= 1e6, 1.0)
        .when(arr >= 1e5, 0.85)
        .when(arr > 0, 0.7)
        .when(~pre, 0.6)
        .when(pre_ok, 0.5)
        .when(pre_ok.isNull(), 0.3)
        .otherwise(0.2)
    )


def lead_score(seeking: Column, lead: Column) -> Column:
    known = lead.isin("lead_only", "both", "follow_ok")
    return (
        F.when(seeking.isNull() | lead.isNull() | ~known, 0.5)
        .when(seeking, F.when(lead == "lead_only", 1.0).when(lead == "both", 0.85).otherwise(0.1))
        .otherwise(F.when(lead == "follow_ok", 1.0).when(lead == "both", 0.7).otherwise(0.2))
    )


def geo_soft_score(tag: Column, geo: Column) -> Column:
    return (
        F.when(F.size(geo) == 0, 0.5)
        .when(F.coalesce(F.array_contains(geo, tag), F.lit(False)), 1.0)
        .when(F.array_contains(geo, "us_agnostic"), 0.7)
        .when(F.array_contains(geo, "global"), 0.6)
        .otherwise(0.0)
    )


def sector_score(wanted: Column, held: Column) -> Column:
    recall = F.try_divide(F.size(F.array_intersect(wanted, held)), F.size(wanted))
    return F.when((F.size(wanted) == 0) | (F.size(held) == 0), 1.0).otherwise(
        0.75 * recall + 0.25 * jaccard(wanted, held)
    )


def list_score(wanted: Column, held: Column) -> Column:
    return (
        F.when(F.size(held) == 0, 0.5).when(F.size(wanted) == 0, 0.2).otherwise(jaccard(wanted, held))
    )


def team_score(wanted: Column, held: Column, valued: Sequence[str]) -> Column:
    both = F.array_intersect(wanted, held)
    extra = F.least(F.lit(0.2), 0.1 * F.size(F.array_intersect(both, str_array(valued))))
    return (
        F.when(F.size(held) == 0, 0.5)
        .when(F.size(wanted) == 0, 0.2)
        .when(F.size(both) == 0, 0.0)
        .otherwise(F.least(F.lit(1.0), jaccard(wanted, held) + extra))
    )


def soft_scores(pairs: DataFrame, vocab: MatchVocab) -> DataFrame:
    """The dimensions and ``tier2`` of gated pairs of soft signatures."""
    p, f = (lambda n: F.col(f"p.{n}")), (lambda n: F.col(f"f.{n}"))
    df = pairs.select(
        "psoft",
        "fsoft",
        "amount",
        "intent",
        "traction",
        sector_score(p("sectors"), f("sectors")).alias("sector"),
        list_score(p("models"), f("models")).alias("business_model"),
        team_score(p("team"), f("team"), vocab.valued_team).alias("team"),
        lead_score(p("lead"), f("lead")).alias("lead"),
        geo_soft_score(p("geo"), f("geo")).alias("geo_soft"),
        f("filled").alias("_filled"),
        p("domain").alias("domain"),
    )
    raw = F.lit(0.0)
    for name, weight in DIM_WEIGHTS.items():
        raw = raw + F.col(name) * weight
    tier2 = (
        raw
        * ((0.30 + F.col("sector") * 0.70) * F.col("intent"))
        * (0.75 + (F.col("_filled") / 100.0) * 0.25)
        * F.col("amount")
    )
    return df.withColumn("tier2", tier2).drop("_filled")


def open_anchor(own: Column, inferred: Column, generalist: Column) -> Column:
    """Firms about whose sub-sectors nothing is known."""
    return generalist | ((F.size(own) == 0) & (F.size(inferred) == 0))


def narrowing(focused: Column, silent: Column, vocab: MatchVocab) -> Column:
    """0.6 where the firm is set on an indication of which the profile says nothing."""
    narrowed = any_of(
        F.get(focused, F.lit(i)) & F.get(silent, F.lit(i)) for i in range(len(vocab.indications))
    )
    return F.when(narrowed, NARROWED).otherwise(1.0)


def anchor_pairs(profile_anchors: DataFrame, firm_anchors: DataFrame, vocab: MatchVocab) -> DataFrame:
    """``panch, fanch, status, matched, base, f1`` of the anchors that share a tag."""
    asked = profile_anchors.select("panch", "pa", F.explode(F.array_distinct("pa.subs")).alias("tag"))
    held = firm_anchors.filter(~F.col("fa.generalist")).select(
        "fanch", "fa", F.explode(F.array_union("fa.subs", "fa.inferred")).alias("tag")
    )
    # A pair that shares several tags meets at the smallest one only.
    shared = F.array_min(F.array_intersect("pa.subs", F.array_union("fa.subs", "fa.inferred")))
    pairs = asked.join(held, "tag").filter(F.col("tag") == shared).drop("tag")
    wanted, own, inferred = F.col("pa.subs"), F.col("fa.subs"), F.col("fa.inferred")
    rescue = (F.size(inferred) > 0) & (
        (F.size(own) < 2) | (F.size(F.array_intersect(wanted, own)) == 0)
    )
    df = pairs.withColumn("_rescued", rescue).withColumn(
        "_tags", F.when(F.col("_rescued"), F.array_union(own, inferred)).otherwise(own)
    )
    df = df.withColumn("matched", F.sort_array(F.array_intersect(wanted, F.col("_tags"))))
    hits = F.size("matched")
    precision, recall = F.try_divide(hits, F.size(wanted)), F.try_divide(hits, F.size("_tags"))
    base = round_to(precision * 0.7 + F.least(hits / 3.0, F.lit(1.0)) * 0.3, 4)
    return df.select(
        "panch",
        "fanch",
        F.when(F.col("_rescued"), "inferred").otherwise("matched").alias("status"),
        "matched",
        (base * narrowing(F.col("fa.focused"), F.col("pa.silent"), vocab)).alias("base"),
        round_to(F.try_divide(2 * precision * recall, precision + recall), 4).alias("f1"),
    )


def pair_score(base: Column) -> Column:
    return round_to(base * (0.60 + F.col("tier2") * 0.80) * F.col("confidence"), 4)


def promising(
    soft: DataFrame, profile_sigs: DataFrame, firm_sigs: DataFrame, anchors: DataFrame, top_n: int
) -> DataFrame:
    """Pairs of a profile signature and a firm's soft signature that may hold a ranked firm.

    ``bound`` is the highest base any firm of the block can have for the profile, ``reached``
    one that a firm of the block has for certain.
    """
    kind = firm_sigs.select(
        "fsoft",
        "fanch",
        open_anchor(F.col("fa.subs"), F.col("fa.inferred"), F.col("fa.generalist")).alias("open"),
        (~F.array_contains("fa.focused", True)).alias("plain"),
    )
    blocks = kind.groupBy("fsoft").agg(
        F.max("open").alias("open"),
        F.max(F.col("open") & F.col("plain")).alias("open_plain"),
        F.max("plain").alias("plain"),
    )
    best = (
        kind.select("fsoft", "fanch")
        .join(anchors.select("panch", "fanch", "base"), "fanch")
        .groupBy("fsoft", "panch")
        .agg(F.max("base").alias("shared"))
    )
    pairs = (
        soft.select("psoft", "fsoft", "tier2")
        .join(blocks, "fsoft")
        .join(profile_sigs.select("psig", "psoft", "panch", "confidence", (F.size("pa.subs") == 0).alias("silent")), "psoft")
        .join(best, ["fsoft", "panch"], "left")
    )
    c = F.col
    # Without tags every firm is without data to the profile, else the open ones are.
    no_data = c("silent") | c("open")
    no_data_plain = F.when(c("silent"), c("plain")).otherwise(c("open_plain"))
    rest = F.when(no_data, F.when(no_data_plain, 1.0).otherwise(NARROWED) * BASE_NO_DATA).otherwise(
        F.when(c("shared").isNotNull(), 0.0).otherwise(F.when(c("plain"), 1.0).otherwise(NARROWED) * BASE_MISMATCH)
    )
    ceiling = F.when(no_data, BASE_NO_DATA).otherwise(BASE_MISMATCH)
    pairs = pairs.select(
        "psig",
        "psoft",
        "fsoft",
        pair_score(F.greatest(F.coalesce("shared", F.lit(0.0)), ceiling)).alias("bound"),
        pair_score(F.greatest(F.coalesce("shared", F.lit(0.0)), rest)).alias("reached"),
    )
    pairs = cut_lineage(pairs)
    best_reached = Window.partitionBy("psig").orderBy(F.desc("reached"))
    threshold = (
        pairs.withColumn("_r", F.row_number().over(best_reached))
        .filter(F.col("_r") <= top_n)
        .groupBy("psig")
        .agg(F.when(F.count("*") == top_n, F.min("reached")).otherwise(0.0).alias("threshold"))
    )
    return pairs.join(threshold, "psig").filter("bound >= threshold").select("psig", "psoft", "fsoft", "threshold")


def opened(
    promised: DataFrame, soft: DataFrame, profile_sigs: DataFrame, firm_sigs: DataFrame, anchors: DataFrame, vocab: MatchVocab
) -> DataFrame:
    """Every firm signature of the promising blocks with its exact score."""
    c = F.col
    rows = (
        promised.join(soft, ["psoft", "fsoft"])
        .join(profile_sigs.select("psig", "panch", "pa", "confidence"), "psig")
        .join(firm_sigs.select("fsig", "fsoft", "fanch", "fa", "min_ord"), "fsoft")
        .join(anchors.withColumnRenamed("base", "_base"), ["panch", "fanch"], "left")
    )
    no_data = (F.size("pa.subs") == 0) | open_anchor(c("fa.subs"), c("fa.inferred"), c("fa.generalist"))
    rest = F.when(no_data, BASE_NO_DATA).otherwise(BASE_MISMATCH)
    rows = rows.withColumn(
        "base", F.coalesce("_base", rest * narrowing(c("fa.focused"), c("pa.silent"), vocab))
    ).withColumn("score", pair_score(c("base")))
    status = F.when(no_data, "no_data").otherwise("confirmed_mismatch")
    return (
        rows.filter("score >= threshold")
        .withColumn("status", F.coalesce("status", status))
        .withColumn("matched", F.coalesce("matched", F.array().cast(STRINGS)))
        .withColumn("f1", F.coalesce("f1", F.lit(0.0)))
        .drop("psoft", "fsoft", "panch", "fanch", "pa", "fa", "_base", "threshold", "confidence")
    )


def reasons_before_text() -> Column:
    """Ordered reasons that do not need the text similarity."""
    c = F.col
    tags = F.concat(F.lit("sub-sector match: "), F.array_join(F.slice("matched", 1, 3), ", "))
    share = F.concat(F.lit("sector match ("), F.format_string("%.0f", F.bround(c("sector") * 100, 0)), F.lit("%)"))
    first = F.when(F.size("matched") > 0, tags).when(c("sector") >= 0.4, share)
    return F.array_compact(
        F.array(
            first,
            F.when(c("business_model") >= 0.4, F.lit("business model aligned")),
            F.when(c("traction") >= 0.6, F.lit("traction requirements met")),
            F.when(c("team") >= 0.4, F.lit("team background match")),
            F.when(c("lead") >= 0.7, F.lit("lead preference aligned")),
            F.when(c("geo_soft") >= 0.9, F.lit("city-level geo match")),
        )
    )


def similarity(with_vectors: bool) -> Column:
    """Scaled cosine where both sides have a vector, else the overlap of the words."""
    words = X.overlap_score(F.col("profile_tokens"), F.col("firm_tokens"))
    if not with_vectors:
        return words
    both = all_of([F.col("profile_vec").isNotNull(), F.col("firm_vec").isNotNull()])
    return F.when(both, X.scaled_cosine(F.col("profile_vec"), F.col("firm_vec"))).otherwise(words)


def scored_soft_pairs(people: DataFrame, offers: DataFrame, vocab: MatchVocab) -> DataFrame:
    """The pairs of soft signatures that pass all gates, with their scores."""
    asked = people.groupBy("psoft").agg(F.first("p").alias("p"))
    offered = offers.groupBy("fsoft").agg(F.first("f").alias("f"))
    return soft_scores(gates(blocked_pairs(asked, offered)), vocab)


# Vectors of one side that one task compares with as many of the other side.
VECTOR_BLOCK = 2048
PAIR_ROWS = "i long, j long, kind int, a long, b long, vec array<double>"


def word_counts(soft: DataFrame, asks: DataFrame, held: DataFrame) -> DataFrame:
    """``s, n`` of the scored pairs that are compared by words: all but those with two vectors.

    Pairs are added up per soft signature and word set, so that each two word sets meet once.
    """
    vectors = F.count("profile_vec"), F.count("firm_vec")
    asks = asks.groupBy("psoft", "profile_tokens").agg(F.count("*").alias("np"), vectors[0].alias("pv"))
    held = held.groupBy("fsoft", "firm_tokens").agg(F.count("*").alias("nf"), vectors[1].alias("fv"))
    reached = soft.join(held, "fsoft").groupBy("psoft", "firm_tokens").agg(F.sum("nf").alias("nf"), F.sum("fv").alias("fv"))
    met = (
        reached.join(asks, "psoft")
        .groupBy("profile_tokens", "firm_tokens")
        .agg(F.sum(F.col("np") * F.col("nf") - F.col("pv") * F.col("fv")).alias("n"))
        .filter("n > 0")
    )
    return met.groupBy(round_to(similarity(False), 4).alias("s")).agg(F.sum("n").alias("n"))


def in_blocks(rows: DataFrame, soft: str, block: str) -> DataFrame:
    """Rows of vectors dealt by soft signature to blocks of about ``VECTOR_BLOCK``; a large signature gets several."""
    sizes = rows.groupBy(soft).agg(F.count("*").alias("_n"))
    blocks = rows.count() // VECTOR_BLOCK + 1
    parts = F.ceil(F.col("_n") / VECTOR_BLOCK)
    return rows.join(sizes, soft).select(
        F.xxhash64(soft).alias(soft),
        "vec",
        (F.pmod(F.xxhash64(soft), F.lit(blocks)) * 1_000_000 + F.pmod(F.xxhash64("vec", "id"), parts)).alias(block),
    )


def block_counter():
    """The task of a pair of blocks; local functions travel to the tasks by value, without this package."""

    def vectors_of(rows):
        """Matrix, norms, lengths (-1 with a null inside) of a column of lists; short rows end in zeros."""
        rows = rows.combine_chunks()
        sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        width = int(sizes.max(initial=0))
        matrix = np.zeros((len(sizes), width))
        at = np.repeat(np.arange(len(sizes)), sizes)
        matrix[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        holes = np.zeros(len(sizes), bool)
        holes[at[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        matrix[holes] = 0.0
        return matrix, np.sqrt((matrix * matrix).sum(axis=1)), np.where(holes, -1, sizes)

    def block_cosines(group):
        """Counts per scaled cosine (four decimals) over the scored pairs of two blocks of vectors."""
        kind = group["kind"].to_numpy()
        asked, held, scored = (group.filter(pa.array(kind == k)) for k in range(3))
        pm, pn, pl = vectors_of(asked["vec"])
        fm, fn, fl = vectors_of(held["vec"])
        width = max(pm.shape[1], fm.shape[1])
        pm, fm = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (pm, fm))
        psoft, fsoft = asked["a"].to_numpy(), held["b"].to_numpy()
        by_soft, by_ask = np.argsort(fsoft, kind="stable"), np.argsort(psoft, kind="stable")
        ranked, told = fsoft[by_soft], psoft[by_ask]
        a, b = scored["a"].to_numpy(), scored["b"].to_numpy()
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        total = np.zeros(10_001, np.int64)
        names, starts = np.unique(a, return_index=True)
        for name, start, end in zip(names, starts, [*starts[1:], len(a)], strict=True):
            own = by_ask[np.searchsorted(told, name) : np.searchsorted(told, name, "right")]
            lo, hi = np.searchsorted(ranked, b[start:end]), np.searchsorted(ranked, b[start:end], "right")
            at = by_soft[np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())]
            if not len(own) or not len(at):
                continue
            with np.errstate(all="ignore"):
                norm = pn[own][:, None] * fn[at][None, :]
                cos = (pm[own] @ fm[at].T) / norm
            none = (norm == 0) | (pl[own][:, None] != fl[at][None, :])
            # As the column functions have it: no cosine counts as 0, one that is no number as the highest.
            scaled = np.clip((np.where(none, 0.0, np.where(np.isnan(cos), np.inf, cos)) - 0.20) / 0.25, 0.0, 1.0)
            total += np.bincount(np.floor(scaled * 10_000 + 0.5).astype(np.int64).ravel(), minlength=10_001)
        found = np.flatnonzero(total)
        return pa.table({"s": found / 10_000.0, "n": total[found]})

    return block_cosines


def vector_counts(soft: DataFrame, asks: DataFrame, held: DataFrame) -> DataFrame:
    """``s, n`` of the scored pairs that have a vector on both sides.

    Blocks of profiles and firms meet in one task each, with the soft pairs between them; a
    task multiplies two matrices of ``VECTOR_BLOCK`` rows and returns 10,001 counts at most.
    """
    asks = asks.filter("profile_vec is not null")
    held = held.filter("firm_vec is not null")
    kind = "array<double>"
    asks = cut_lineage(in_blocks(asks.select("psoft", "id", F.col("profile_vec").cast(kind).alias("vec")), "psoft", "i"))
    held = cut_lineage(in_blocks(held.select("fsoft", "id", F.col("firm_vec").cast(kind).alias("vec")), "fsoft", "j"))
    scored = cut_lineage(
        soft.select(F.xxhash64("psoft").alias("psoft"), F.xxhash64("fsoft").alias("fsoft"))
        .join(asks.select("psoft", "i").distinct(), "psoft")
        .join(held.select("fsoft", "j").distinct(), "fsoft")
    )
    meet = scored.select("i", "j").distinct()
    none = F.lit(None)
    rows = (
        asks.join(meet, "i").select("i", "j", F.lit(0), "psoft", none.cast("long"), "vec")
        .union(held.join(meet, "j").select("i", "j", F.lit(1), none.cast("long"), "fsoft", "vec"))
        .union(scored.select("i", "j", F.lit(2), "psoft", "fsoft", none.cast(kind)))
        .toDF(*[f.split()[0] for f in PAIR_ROWS.split(", ")])
    )
    return rows.groupBy("i", "j").applyInArrow(block_counter(), "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))


def semantic_stats(
    profiles: DataFrame, firms: DataFrame, vocab: MatchVocab, firm_vectors: DataFrame, profile_vectors: DataFrame
) -> DataFrame:
    """Count, range, mean, median and zeros of the similarity of ALL scored pairs.

    The similarity has four decimals, so one count per value (10,001 at most) holds everything
    the statistics need; pairs are counted where they are made and never stored.
    """
    accepted, _ = split_profiles(profiles)
    people = cut_lineage(profile_features(accepted, vocab))
    offers = cut_lineage(firm_features(firms, vocab).select("firm_id", "fsoft", "f", "thesis_text"))
    soft = cut_lineage(scored_soft_pairs(people, offers, vocab).select("psoft", "fsoft"))
    asks = cut_lineage(
        people.select("profile_id", "psoft")
        .join(profiles.select("profile_id", "narrative_text"), "profile_id")
        .join(profile_vectors.select("profile_id", F.col("vec").alias("profile_vec")), "profile_id", "left")
        .select(
            "psoft",
            F.col("profile_id").alias("id"),
            "profile_vec",
            X.token_set(F.coalesce("narrative_text", F.lit("")), vocab.stopwords).alias("profile_tokens"),
        )
    )
    held = cut_lineage(
        offers.join(firm_vectors.select("firm_id", F.col("vec").alias("firm_vec")), "firm_id", "left").select(
            "fsoft",
            F.col("firm_id").alias("id"),
            "firm_vec",
            X.token_set(F.coalesce("thesis_text", F.lit("")), vocab.stopwords).alias("firm_tokens"),
        )
    )
    values = (
        word_counts(soft, asks, held)
        .unionByName(vector_counts(soft, asks, held))
        .groupBy("s")
        .agg(F.sum("n").alias("n"))
    )
    values = cut_lineage(values)
    up_to = Window.partitionBy().orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("_end", F.sum("n").over(up_to)).withColumn("_all", F.sum("n").over(Window.partitionBy()))
    middle = (F.col("_all") - 1) / 2.0

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("n")) & (rank < F.col("_end")), F.col("s")))

    return placed.agg(
        F.sum("n").alias("n"),
        F.min("s").alias("min_sem"),
        F.max("s").alias("max_sem"),
        F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 3).alias("mean_sem"),
        at(F.floor(middle)).alias("_lo"),
        at(F.ceil(middle)).alias("_hi"),
        F.coalesce(F.sum(F.when(F.col("s") == 0, F.col("n"))), F.lit(0)).alias("n_zero"),
    ).select(
        "n", "min_sem", "max_sem", "mean_sem", F.round((F.col("_lo") + F.col("_hi")) / 2, 4).alias("median_sem"), "n_zero"
    )


def best_signatures(people: DataFrame, offers: DataFrame, vocab: MatchVocab, top_n: int) -> DataFrame:
    """Per profile signature the best ``top_n`` firm signatures: those of its best firms."""
    firm_sigs = cut_lineage(
        offers.groupBy("fsig", "fsoft", "fanch").agg(F.first("fa").alias("fa"), F.min("ord").alias("min_ord"))
    )
    profile_sigs = cut_lineage(people.groupBy("psig", "psoft", "panch", "confidence").agg(F.first("pa").alias("pa")))
    soft = cut_lineage(scored_soft_pairs(people, offers, vocab))
    anchors = cut_lineage(
        anchor_pairs(
            profile_sigs.groupBy("panch").agg(F.first("pa").alias("pa")),
            firm_sigs.groupBy("fanch").agg(F.first("fa").alias("fa")),
            vocab,
        )
    )
    promised = promising(soft, profile_sigs, firm_sigs, anchors, top_n)
    rows = opened(promised, soft, profile_sigs, firm_sigs, anchors, vocab)
    best = Window.partitionBy("psig").orderBy(F.desc("score"), F.asc("min_ord"))
    return rows.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top_n).drop("_r", "min_ord")


def match(
    profiles: DataFrame,
    firms: DataFrame,
    vocab: MatchVocab,
    top_n: int = 15,
    firm_vectors: DataFrame | None = None,
    profile_vectors: DataFrame | None = None,
    show: Sequence[str] = (),
) -> DataFrame:
    """Top ``top_n`` firms per profile, best score first, input order on ties."""
    # Features are stored once: they feed several branches, and the later plan then
    # starts from plain columns instead of the text rules behind them.
    accepted, _ = split_profiles(profiles)
    people = cut_lineage(profile_features(accepted, vocab))
    offers = cut_lineage(
        firm_features(firms, vocab).select("fsig", "fsoft", "fanch", "f", "fa", "firm_id", "ord")
    )
    ranked = best_signatures(people, offers, vocab, top_n)

    # The first top_n firms of a signature; the partial group limit cuts hot
    # signatures before the shuffle.
    in_sig = Window.partitionBy("fsig").orderBy("ord")
    candidates = (
        offers.select("fsig", "firm_id", "ord")
        .withColumn("_r", F.row_number().over(in_sig))
        .filter(F.col("_r") <= top_n)
        .drop("_r")
    )
    best_rows = Window.partitionBy("psig").orderBy(F.desc("score"), F.asc("ord"))
    placed = (
        ranked.join(candidates, "fsig")
        .withColumn("rank", F.row_number().over(best_rows))
        .filter(F.col("rank") <= top_n)
        .withColumn("reasons", reasons_before_text())
        .withColumn("intent_domain", F.get(str_array([d.name for d in vocab.domains]), F.col("domain")))
        .drop("domain", "fsig")
    )
    # Texts and vectors meet the ranked firms only.
    shown = firms.select(
        "firm_id",
        "ord",
        *show,
        X.token_set(F.coalesce("thesis_text", F.lit("")), vocab.stopwords).alias("firm_tokens"),
    )
    placed = placed.join(shown, ["firm_id", "ord"])
    if firm_vectors is not None:
        placed = placed.join(
            firm_vectors.select("firm_id", F.col("vec").alias("firm_vec")), "firm_id", "left"
        )
    asks = people.select("profile_id", "psig").join(
        profiles.select(
            "profile_id",
            X.token_set(F.coalesce("narrative_text", F.lit("")), vocab.stopwords).alias("profile_tokens"),
        ),
        "profile_id",
    )
    if profile_vectors is not None:
        asks = asks.join(
            profile_vectors.select("profile_id", F.col("vec").alias("profile_vec")), "profile_id", "left"
        )
    out = asks.join(placed, "psig").drop("psig")
    out = out.withColumn("_sem", similarity(firm_vectors is not None and profile_vectors is not None))
    thesis = F.concat(
        F.lit("thesis alignment ("), F.format_string("%.0f", F.bround(F.col("_sem") * 100, 0)), F.lit("%)")
    )
    reasons = F.concat(
        F.col("reasons"), F.when(F.col("_sem") >= 0.5, F.array(thesis)).otherwise(F.array().cast(STRINGS))
    )
    return out.select(
        "profile_id",
        "rank",
        "firm_id",
        *show,
        "score",
        round_to("tier2", 4).alias("tier2_score"),
        round_to("_sem", 4).alias("semantic_score"),
        round_to("sector", 4).alias("sector_score"),
        round_to("f1", 4).alias("sub_bonus"),
        round_to("base", 4).alias("sub_f1_base"),
        F.col("matched").alias("sub_tags_matched"),
        F.col("status").alias("sub_sector_status"),
        round_to(0.60 + F.col("tier2") * 0.80, 4).alias("tier2_mod"),
        "intent_domain",
        round_to("intent", 4).alias("intent_mult"),
        F.struct(*[round_to(n, 3).alias(n) for n in DIM_WEIGHTS]).alias("dim_scores"),
        reasons.alias("match_reasons"),
    )


