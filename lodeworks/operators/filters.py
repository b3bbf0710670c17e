"""Row filters: null-safe flags, faceted browse, rule chains, host and evidence gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.exprs import all_of, any_of, bound, col, contains_any, first_hit, lookup, strip


def keep_unless_false(df: DataFrame, flag: str) -> DataFrame:
    """Null passes; only an explicit false is dropped."""
    return df.filter(~F.col(flag).eqNullSafe(F.lit(False)))


def derived_type(
    name: Column | str,
    stage: Column | str,
    corporate_words: Sequence[str],
    by_stage: Mapping[str, str],
    corporate_label: str = "CVC",
) -> Column:
    """Corporate keyword in the name wins, then the stage map, else null."""
    return F.when(
        contains_any(F.lower(col(name)), corporate_words), F.lit(corporate_label)
    ).otherwise(lookup(dict(by_stage), col(stage)))


def search_text(*columns: str) -> Column:
    """One lower-cased search string over text and array columns."""
    return F.lower(F.concat_ws(" ", *columns))


def browse(
    df: DataFrame,
    *,
    equals: Mapping[str, str] | None = None,
    facets: Mapping[str, Sequence[str]] | None = None,
    text_columns: Sequence[str] = (),
    text: str | None = None,
    saved: DataFrame | None = None,
    saved_key: str | None = None,
) -> DataFrame:
    """Faceted browse: every given facet must hold; a grouped facet lists its members.

    The saved set is a semi join, so its size does not matter to the plan.
    """
    conditions = [F.col(c) == v for c, v in (equals or {}).items()]
    conditions += [F.col(c).isin(*vs) for c, vs in (facets or {}).items()]
    if text:
        conditions.append(search_text(*text_columns).contains(text.strip().lower()))
    out = df.filter(all_of(conditions))
    if saved is not None and saved_key is not None:
        out = out.join(saved.select(saved_key), saved_key, "left_semi")
    return out


def lane_by_source(source: Column | str, members: Sequence[str]) -> Column:
    """Split by set membership; a missing source is the empty name."""
    inside = F.coalesce(col(source), F.lit("")).isin(*members)
    return F.when(inside, "inside").otherwise("outside")


def removed_at(steps: Sequence[tuple[str, Column]]) -> Column:
    """Label of the first step whose predicate removes the row, else null."""
    return first_hit((predicate, F.lit(label)) for label, predicate in steps)


def step_report(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows removed by each step, in one pass; kept rows have the step ``kept``."""
    return (
        df.select(F.coalesce(removed_at(steps), F.lit("kept")).alias("step"))
        .groupBy("step")
        .agg(F.count("*").alias("n_rows"))
    )


def domestic_entity(
    country: Column | str, state: Column | str, countries: Sequence[str], states: Sequence[str]
) -> Column:
    """(Country listed or empty) and state listed."""
    country = F.upper(F.trim(F.coalesce(col(country), F.lit(""))))
    state = F.upper(F.trim(F.coalesce(col(state), F.lit(""))))
    return ((country == "") | country.isin(*countries)) & state.isin(*states)


def lenient_evidence(
    text: Column | str, url: Column | str, terms: Sequence[str], foreign: Sequence[str]
) -> Column:
    """Drop only when no home term occurs and the address carries a foreign signal."""
    return contains_any(col(text), terms) | ~contains_any(F.lower(col(url)), foreign)


def mentions_any(text: Column | str, terms: Sequence[str]) -> Column:
    return contains_any(col(text), terms)


def on_hosts(host: Column | str, domains: Sequence[str]) -> Column:
    """Host equals a listed domain or is one of its sub-domains."""
    host = col(host)
    return any_of((host == d) | F.endswith(host, F.lit("." + d)) for d in domains)


def small_adviser(fund_flag: Column, aum: Column | str, floor_usd: float = 5e6) -> Column:
    """No fund flag and a known amount under the floor."""
    aum = col(aum)
    return ~F.coalesce(fund_flag, F.lit(False)) & aum.isNotNull() & (aum < floor_usd)


def meaningful(text: Column | str, empty_signals: Sequence[str]) -> Column:
    """Non-blank text without any phrase that signals a missing answer."""
    low = F.lower(F.trim(F.coalesce(col(text), F.lit(""))))
    return (low != "") & ~contains_any(low, empty_signals)


def filled_ratio(columns: Sequence[Column | str], empty_signals: Sequence[str]) -> Column:
    total = sum((meaningful(c, empty_signals).cast("int") for c in columns), F.lit(0))
    return F.round(total / F.lit(len(columns)).cast("double"), 2)


def amount_missing(text: Column | str, empty_signals: Sequence[str]) -> Column:
    """Not meaningful, or no digit, currency sign or magnitude letter."""
    return ~meaningful(text, empty_signals) | ~col(text).rlike(r"[\d$€£¥KMBkmb]")


def list_keep(values: Column, allowed: Sequence[str]) -> Column:
    return F.filter(values, lambda v: v.isin(*allowed))


def allowed_by_key(
    values: Column | str, key: Column | str, allowed: Mapping[str, Sequence[str]]
) -> Column:
    """Keep array values the key allows (order, copies and case stay); unknown key: unchanged."""
    values, key = col(values), col(key)
    out = None
    for k, vs in allowed.items():
        kept = list_keep(values, vs)
        out = F.when(key == k, kept) if out is None else out.when(key == k, kept)
    return values if out is None else out.otherwise(values)


def enum_or_null(value: Column | str, allowed: Sequence[str]) -> Column:
    text = F.trim(col(value))
    return F.when(text.isin(*allowed), text)


def list_in(values: Column | str, allowed: Sequence[str]) -> Column:
    """Allowed members of a list, or null when none is left."""
    return bound(list_keep(col(values), allowed), lambda kept: F.when(F.size(kept) > 0, kept))


def tags_or_default(
    values: Column | str, allowed: Sequence[str], default: str = "generalist"
) -> Column:
    """Known tags in their own spelling (lower case, ``_`` for blanks and hyphens), repeats kept;
    the default tag when none is known."""
    spelled = F.transform(
        F.coalesce(col(values), F.array().cast("array<string>")),
        lambda v: F.translate(strip(F.lower(v)), " -", "__"),
    )
    kept = F.filter(spelled, lambda v: v.isin(*allowed))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))


def skip_reason(
    is_target: Column, url: Column, host: Column, text: Column, excluded: Sequence[str]
) -> Column:
    """Why a target row is skipped: no address, excluded host or empty text."""
    return (
        F.when(is_target & (F.coalesce(url, F.lit("")) == ""), "no_website")
        .when(is_target & on_hosts(host, excluded), "excluded_host")
        .when(is_target & (F.coalesce(F.trim(text), F.lit("")) == ""), "empty_text")
    )
