"""Column helpers shared by every operator family."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = "array<string>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def str_array(values: Iterable[str]) -> Column:
    """A typed literal string array, also when empty."""
    values = list(values)
    if not values:
        return F.array().cast(STRINGS)
    return F.array(*[F.lit(v) for v in values])


def any_of(flags: Iterable[Column]) -> Column:
    """OR over a possibly empty list of conditions."""
    out = None
    for flag in flags:
        out = flag if out is None else (out | flag)
    return F.lit(False) if out is None else out


def all_of(flags: Iterable[Column]) -> Column:
    out = None
    for flag in flags:
        out = flag if out is None else (out & flag)
    return F.lit(True) if out is None else out


def is_filled(c: Column | str) -> Column:
    """Not null and not an empty string."""
    c = col(c)
    return c.isNotNull() & (c != "")


def nonempty(c: Column | str) -> Column:
    """Empty string becomes null."""
    return F.nullif(col(c), F.lit(""))


def trimmed(c: Column | str) -> Column:
    """Text of any scalar without blanks at its ends, null when nothing is left."""
    return nonempty(strip(col(c).cast("string")))


def has_items(c: Column | str) -> Column:
    """Array is present and not empty."""
    return F.coalesce(F.size(col(c)) > 0, F.lit(False))


def nonzero(c: Column | str) -> Column:
    """Zero becomes null, so ``coalesce`` acts like an or-default."""
    return F.nullif(col(c), F.lit(0))


def contains_any(text: Column | str, terms: Sequence[str]) -> Column:
    """True when any term is a substring; one flat codegen'd expression."""
    text = col(text)
    return any_of(text.contains(t) for t in terms)


def count_hits(text: Column | str, terms: Sequence[str]) -> Column:
    """Number of terms that occur as substrings; each term counts once."""
    text = col(text)
    out: Column = F.lit(0)
    for t in terms:
        out = out + text.contains(t).cast("int")
    return out


def keep_if(condition: Column, value: Column | str) -> Column:
    """An array element (or literal) that is null unless the condition holds."""
    return F.when(condition, F.lit(value) if isinstance(value, str) else value)


def labels(pairs: Iterable[tuple[Column, str]]) -> Column:
    """Ordered labels whose conditions hold; false and null drop out."""
    return F.array_compact(F.array(*[keep_if(c, v) for c, v in pairs]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also where lambdas use it again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(c: Column | str) -> Column:
    """Whitespace split without empty parts."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def squeeze(c: Column | str) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def strip(c: Column | str) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def trim_spaces(c: Column | str) -> Column:
    """Trim space separators only, as SQL's ``trim`` does."""
    return F.regexp_replace(col(c), r"^\p{Zs}+|\p{Zs}+\z", "")


def title_case(c: Column | str) -> Column:
    """Capitalise after every non-letter, not only after spaces."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def number_of(c: Column | str) -> Column:
    """Number-like text, with commas or a dollar sign, to a double; null if unreadable."""
    return F.regexp_replace(F.trim(col(c).cast("string")), r"[,$]", "").try_cast("double")


def safe_int(c: Column | str) -> Column:
    """Number-like text to a whole number, truncated toward zero; null if unreadable."""
    return number_of(c).try_cast("bigint")


def positive_int(c: Column | str) -> Column:
    value = safe_int(c)
    return F.when(value > 0, value)


def whole_amount(c: Column | str) -> Column:
    """Whole part of an amount above zero: 0 for less than one, null for none or a negative one."""
    return F.when(number_of(c) > 0, safe_int(c))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small parameter map, null when the key is unknown."""
    flat: list[Column] = []
    for k, v in mapping.items():
        flat += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*flat), key) if flat else F.lit(None).cast("string")


def round_to(c: Column | str, places: int) -> Column:
    """Round half up in plain double arithmetic, the same on every engine."""
    scale = float(10**places)
    return F.floor(col(c) * scale + 0.5) / scale


def first_hit(candidates: Iterable[tuple[Column, Column]]) -> Column:
    """Value of the first pair whose condition holds, else null."""
    out = None
    for condition, value in candidates:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(None).cast("string") if out is None else out


def distinct_slice(array: Column, n: int) -> Column:
    return F.slice(F.array_distinct(array), 1, n)


def day_floor(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)
