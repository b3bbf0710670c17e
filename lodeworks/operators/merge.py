"""Merging found values into known rows: a policy per field, compiled to one select.

Both sides have one row per key, so a merge is one join; fields are ``coalesce`` and ``when``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.exprs import has_items, strip
from lodeworks.operators.records import FieldRule, build, empty_list, now_text

ALWAYS, IF_MISSING = "always", "if_missing"


@dataclass(frozen=True)
class Policy:
    """How a found value meets the known one.

    ``ALWAYS``: a found value wins; ``IF_MISSING``: only where nothing is known. A text counts as
    found from ``longer_than`` + 1 characters on. Fields of a ``group`` are touched only where the
    group's condition holds, whatever each of them would do alone.
    """

    field: str
    rule: str = IF_MISSING
    longer_than: int = 0
    group: str | None = None


def found(value: Column, kind: T.DataType, longer_than: int = 0) -> Column:
    """The value, null where it says nothing: null, blank or short text, empty list."""
    if isinstance(kind, T.StringType):
        return F.when(F.length(strip(value)) > longer_than, value)
    if isinstance(kind, T.ArrayType):
        return F.when(has_items(value), value)
    return value


def merge_by_policies(
    known: DataFrame,
    news: DataFrame,
    key: str,
    policies: Sequence[Policy],
    groups: Mapping[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]] | None = None,
) -> DataFrame:
    """``known`` with its fields merged from ``news``; rows without news, and other fields, stay.

    ``groups`` names the conditions: functions of two lookups, the known and the new value of a
    field. Fields that ``known`` lacks are added.
    """
    groups = groups or {}
    by_field = {p.field: p for p in policies}
    renamed = news.select(F.col(key), F.struct(*[p.field for p in policies]).alias("_new"))
    joined = known.join(renamed, key, "left")

    def old(name: str) -> Column:
        if name in known.columns:
            return found(F.col(name), known.schema[name].dataType)
        return F.lit(None).cast(news.schema[name].dataType)

    def new(name: str) -> Column:
        return found(F.col(f"_new.{name}"), news.schema[name].dataType, by_field[name].longer_than)

    def merged(name: str) -> Column:
        p = by_field[name]
        kept = F.col(name) if name in known.columns else old(name)
        value = F.coalesce(new(name), kept) if p.rule == ALWAYS else F.coalesce(old(name), new(name), kept)
        if p.group:
            value = F.when(F.coalesce(groups[p.group](old, new), F.lit(False)), value).otherwise(kept)
        return value.alias(name)

    added = [p.field for p in policies if p.field not in known.columns]
    return joined.select(*[merged(c) if c in by_field else F.col(c) for c in known.columns], *[merged(c) for c in added])


AUTHORITATIVE = (
    "id name display_name is_real_investor official_website investor_type confidence stages sectors check_size_min_usd "
    "check_size_max_usd check_size_display geo_focus thesis_text business_model_preference traction_requirement "
    "team_background_preference lead_investor ownership_target portfolio_companies submission_url general_email "
    "partner_contacts tier1_evidence tier2_evidence tier1_completeness tier2_completeness contacts_completeness "
    "overall_confidence missing_fields contact_flags research_notes enriched_at"
).split()
LISTS = ("partner_contacts", "missing_fields", "contact_flags")
MAPS = ("tier1_evidence", "tier2_evidence")
DEFAULTS = {
    "is_real_investor": True,
    "tier1_completeness": 0,
    "tier2_completeness": 0,
    "contacts_completeness": 0,
    "overall_confidence": "low",
}


def merge_authoritative(
    original: DataFrame,
    enriched: DataFrame,
    display: Callable[[Column, Column], Column],
    now: Column | None = None,
    key: str = "id",
) -> DataFrame:
    """Published rows: id and name of the original, all else from the result, with defaults.

    ``display`` makes the shown name from the original name and the found address. Fields that
    no result has become null, lists and maps empty.
    """
    joined = original.select(key, F.col("name").alias("_name")).join(
        enriched.select(F.col(key), F.struct(*[c for c in enriched.columns if c != key]).alias("e")), key, "left"
    )
    kinds = {f.name: f.dataType for f in enriched.schema.fields}
    rules = [
        FieldRule("id", [F.col(key)], kind="any"),
        FieldRule("name", ["_name"]),
        FieldRule("display_name", [display(F.col("_name"), F.col("e.official_website"))], kind="any")
        if "official_website" in kinds
        else FieldRule("display_name", [display(F.col("_name"), F.lit(None).cast("string"))], kind="any"),
    ]
    for name in AUTHORITATIVE[3:-1]:
        kind = kinds[name].simpleString() if name in kinds else "string"
        default = DEFAULTS.get(name)
        if name in LISTS:
            kind = kind if name in kinds else "array<string>"
            default = empty_list(kind)
        elif name in MAPS:
            kind = kind if name in kinds else "map<string,string>"
            default = F.create_map().cast(kind)
        rules.append(FieldRule(name, [F.col(f"e.{name}") if name in kinds else F.lit(None).cast(kind)], kind="any", default=default))
    rules.append(FieldRule("enriched_at", [now_text() if now is None else now]))
    return build(joined, rules, order=AUTHORITATIVE)


def top_up(
    rows: DataFrame, stored: DataFrame | None, key: str, compute: Callable[[DataFrame], DataFrame], force: bool = False
) -> DataFrame:
    """The stored results with those of the rows that have none yet.

    ``compute`` sees only rows whose key is not stored; with ``force``, or without a store, it
    sees all of them, and what is stored for other keys stays.
    """
    if stored is None:
        return compute(rows)
    if force:
        fresh = compute(rows)
        return stored.join(rows.select(key), key, "left_anti").unionByName(fresh)
    return stored.unionByName(compute(rows.join(stored.select(key), key, "left_anti")))
