"""Validation, scoring and merging of nested enrichment results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.exprs import (
    any_of,
    bound,
    contains_any,
    has_items,
    is_filled,
    labels,
    nonempty,
    nonzero,
    positive_int,
    trimmed,
    words,
)
from lodeworks.functions.names import placeholder_person
from lodeworks.functions.normalize import money_range, money_short
from lodeworks.operators.filters import enum_or_null, list_in


@dataclass(frozen=True)
class Allowed:
    """Closed vocabularies of an enrichment result."""

    types: Sequence[str] = ()
    stages: Sequence[str] = ()
    sectors: Sequence[str] = ()
    geo: Sequence[str] = ()
    models: Sequence[str] = ()
    team: Sequence[str] = ()
    lead: Sequence[str] = ()
    refusals: Sequence[str] = ()
    domains: Sequence[str] = ()
    title_starts: Sequence[str] = ()
    fragments: Sequence[str] = ()
    profile_path: str = "linkedin.com/in/"


PAYLOAD = """
verification struct<is_real_investor: boolean, rejection_reason: string, official_website: string,
                    investor_type: string, confidence: string>,
tier1 struct<stages: array<string>, sectors: array<string>, geo_focus: array<string>,
             check_size_min_usd: string, check_size_max_usd: string, evidence: map<string, string>>,
tier2 struct<thesis_text: string, business_model_preference: array<string>,
             team_background_preference: array<string>, lead_investor: string,
             traction_requirement: struct<pre_revenue_ok: boolean, min_arr_usd: bigint, notes: string>,
             ownership_target: struct<min_pct: double, max_pct: double>,
             portfolio_companies: array<struct<name: string, sector: string, stage_at_investment: string,
                                               year: string, founder_background: string>>,
             evidence: map<string, string>>,
contacts struct<submission_url: string, general_email: string,
                partner_contacts: array<struct<name: string, title: string, linkedin_url: string,
                                               email: string, twitter_x: string>>>,
data_quality struct<research_notes: string>
"""


def check_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Both ends null when reversed or wider than 50 times."""
    bad = F.coalesce(low > high, F.lit(False)) | F.coalesce(F.try_divide(high, low) > 50, F.lit(False))
    return F.when(~bad, low), F.when(~bad, high)


def thesis(text: Column, refusals: Sequence[str]) -> Column:
    """Null under 50 characters or with a refusal phrase."""

    def kept(s: Column) -> Column:
        return F.when((F.length(s) >= 50) & ~contains_any(F.lower(s), refusals), s)

    return bound(trimmed(text), kept)


def partner_flags(partners: Column, allowed: Allowed) -> tuple[Column, Column]:
    """(clean partners, flags in list order)."""
    named = F.filter(partners, lambda p: is_filled(p["name"]))

    def fake(p: Column) -> Column:
        return placeholder_person(p["name"], allowed.title_starts, allowed.fragments)

    def link_ok(p: Column) -> Column:
        return trimmed(p["linkedin_url"]).contains(allowed.profile_path)

    flags = F.flatten(
        F.transform(
            named,
            lambda p: F.array_compact(
                F.array(
                    F.when(fake(p), F.concat(F.lit("placeholder_partner_name:"), F.trim(p["name"]))),
                    F.when(~fake(p) & ~link_ok(p), F.concat(F.lit("invalid_linkedin:"), F.trim(p["name"]))),
                )
            ),
        )
    )
    clean = F.transform(
        F.filter(named, lambda p: ~fake(p)),
        lambda p: F.struct(
            F.trim(p["name"]).alias("name"),
            trimmed(p["title"]).alias("title"),
            F.when(link_ok(p), trimmed(p["linkedin_url"])).alias("linkedin_url"),
            F.when(p["email"].contains("@"), trimmed(p["email"])).alias("email"),
            trimmed(p["twitter_x"]).alias("twitter_x"),
        ),
    )
    return clean, flags


def validate_contacts(df: DataFrame, contacts: str, allowed: Allowed) -> DataFrame:
    """Adds submission_url, general_email, partner_contacts, contact_flags, contacts_completeness."""
    email, url = nonempty(f"{contacts}.general_email"), nonempty(f"{contacts}.submission_url")
    no_domain = ~contains_any(email, allowed.domains)
    no_at = ~no_domain & ~email.contains("@")
    no_http = ~F.startswith(url, F.lit("http"))
    dirty = ~no_http & url.contains(" ")
    partners = F.coalesce(F.col(f"{contacts}.partner_contacts"), F.array())
    clean, flags = partner_flags(partners, allowed)
    df = df.withColumn("partner_contacts", clean)
    out = df.withColumns(
        {
            "general_email": F.when(~no_domain & ~no_at, email),
            "submission_url": F.when(~no_http & ~dirty, url),
            "contact_flags": F.concat(
                labels([(no_domain, "invalid_email_format"), (no_at, "invalid_email_no_at")]),
                flags,
                labels([(no_http, "invalid_submission_url"), (dirty, "dirty_submission_url")]),
            ),
        }
    )
    links = F.size(F.filter("partner_contacts", lambda p: p["linkedin_url"].isNotNull()))
    score = (
        F.when(F.col("submission_url").isNotNull(), 30).otherwise(0)
        + F.when(links >= 1, 40).otherwise(0)
        + F.when(links >= 2, 20).otherwise(0)
        + F.when(F.col("general_email").isNotNull(), 10).otherwise(0)
    )
    return out.withColumn("contacts_completeness", score)


def validate(raw: DataFrame, allowed: Allowed) -> DataFrame:
    """Rows (id, verification, tier1, tier2, contacts, data_quality) to lanes and clean fields.

    ``status`` is ``rejected`` (flagged, with a reason), ``failed`` (no readable
    payload) or ``enriched``.
    """
    rejected = F.col("verification.is_real_investor").eqNullSafe(F.lit(False))
    unreadable = F.col("verification").isNull() & F.col("tier1").isNull()
    df = raw.withColumns(
        {
            "status": F.when(unreadable, "failed").when(rejected, "rejected").otherwise("enriched"),
            "rejection_reason": F.when(
                rejected,
                F.coalesce(
                    nonempty("verification.rejection_reason"), F.lit("flagged as non-investor by model")
                ),
            ),
            "_min": positive_int("tier1.check_size_min_usd"),
            "_max": positive_int("tier1.check_size_max_usd"),
        }
    )
    low, high = check_range(F.col("_min"), F.col("_max"))
    companies = F.transform(
        F.filter(F.col("tier2.portfolio_companies"), lambda p: is_filled(p["name"])),
        lambda p: F.struct(
            trimmed(p["name"]).alias("name"),
            enum_or_null(p["sector"], allowed.sectors).alias("sector"),
            enum_or_null(p["stage_at_investment"], allowed.stages).alias("stage_at_investment"),
            positive_int(p["year"]).alias("year"),
            trimmed(p["founder_background"]).alias("founder_background"),
        ),
    )
    needs = F.col("tier2.traction_requirement")
    share = F.col("tier2.ownership_target")
    df = df.withColumns(
        {
            "official_website": trimmed("verification.official_website"),
            "investor_type": enum_or_null("verification.investor_type", allowed.types),
            "confidence": trimmed("verification.confidence"),
            "stages": list_in("tier1.stages", allowed.stages),
            "sectors": list_in("tier1.sectors", allowed.sectors),
            "geo_focus": list_in("tier1.geo_focus", allowed.geo),
            "check_size_min_usd": low,
            "check_size_max_usd": high,
            "thesis_text": thesis(F.col("tier2.thesis_text"), allowed.refusals),
            "business_model_preference": list_in("tier2.business_model_preference", allowed.models),
            "team_background_preference": list_in("tier2.team_background_preference", allowed.team),
            "lead_investor": enum_or_null("tier2.lead_investor", allowed.lead),
            "traction_requirement": F.when(
                any_of(needs[f].isNotNull() for f in ("pre_revenue_ok", "min_arr_usd", "notes")), needs
            ),
            "ownership_target": F.when(
                nonzero(share["min_pct"]).isNotNull() | nonzero(share["max_pct"]).isNotNull(), share
            ),
            "portfolio_companies": bound(companies, lambda c: F.when(F.size(c) > 0, c)),
            "tier1_evidence": F.col("tier1.evidence"),
            "tier2_evidence": F.col("tier2.evidence"),
            "research_notes": trimmed("data_quality.research_notes"),
        }
    )
    df = validate_contacts(df, "contacts", allowed)
    return scores(df).drop("_min", "_max", "verification", "tier1", "tier2", "contacts", "data_quality")


def scores(df: DataFrame) -> DataFrame:
    """Completeness of both tiers, overall confidence, missing fields and display range."""
    sized = F.col("check_size_min_usd").isNotNull() | F.col("check_size_max_usd").isNotNull()

    def points(flag: Column, n: int) -> Column:
        return F.when(flag, n).otherwise(0)

    long_thesis = F.coalesce(F.size(words("thesis_text")) >= 200, F.lit(False))
    tier1 = (
        points(has_items("stages"), 25)
        + points(has_items("sectors"), 25)
        + points(sized, 25)
        + points(has_items("geo_focus"), 25)
    )
    tier2 = (
        points(long_thesis, 35)
        + points(has_items("business_model_preference"), 15)
        + points(F.col("traction_requirement").isNotNull(), 15)
        + points(F.col("lead_investor").isNotNull(), 20)
        + points(F.coalesce(F.size("portfolio_companies") >= 5, F.lit(False)), 15)
    )
    df = df.withColumns({"tier1_completeness": tier1, "tier2_completeness": tier2})
    t1 = F.col("tier1_completeness")
    evidence = F.coalesce(F.size("tier1_evidence") > 0, F.lit(False))
    missing = labels(
        [
            (~has_items("stages"), "stages"),
            (~has_items("sectors"), "sectors"),
            (~sized, "check_size"),
            (~has_items("geo_focus"), "geo_focus"),
            (F.col("thesis_text").isNull(), "thesis_text"),
            (F.col("lead_investor").isNull(), "lead_investor"),
            (~has_items("business_model_preference"), "business_model"),
            (F.col("traction_requirement").isNull(), "traction"),
            (F.col("submission_url").isNull(), "submission_url"),
            (~has_items("partner_contacts"), "partner_contacts"),
        ]
    )
    return df.withColumns(
        {
            "overall_confidence": F.when((t1 >= 75) & evidence, "high")
            .when(t1 >= 50, "medium")
            .otherwise("low"),
            "missing_fields": missing,
            "check_size_display": money_range("check_size_min_usd", "check_size_max_usd", money_short),
        }
    )


def merge_results(original: DataFrame, enriched: DataFrame, key: str = "id") -> DataFrame:
    """Id and name come from the original row, everything else from the result."""
    extra = enriched.drop("name")
    joined = original.select(key, "name").join(extra, key, "left")
    defaults = {
        "is_real_investor": F.lit(True),
        "tier1_completeness": F.lit(0),
        "tier2_completeness": F.lit(0),
        "contacts_completeness": F.lit(0),
        "overall_confidence": F.lit("low"),
    }
    for name, value in defaults.items():
        if name in joined.columns:
            joined = joined.withColumn(name, F.coalesce(name, value))
    return joined


ALWAYS, IF_MISSING = "always", "if_missing"


def merge_fields(policy: Mapping[str, str], old: str, new: str) -> list[Column]:
    """Per-field merge: a found value overwrites always, or only a missing one."""
    out = []
    for name, rule in policy.items():
        a, b = nonempty(f"{old}.{name}"), nonempty(f"{new}.{name}")
        out.append((F.coalesce(b, a) if rule == ALWAYS else F.coalesce(a, b)).alias(name))
    return out


