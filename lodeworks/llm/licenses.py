"""License scan with DataFrame functions only.

Words are runs of letters and digits in lower case, shingles three words. A template of m words
is sought in text windows of 2m words that start at every m-th word, so that each occurrence lies
whole in a window. What is looked for is exact containment: the share of the template's distinct
shingles that the window has, at least ``contained``.

Of n shingles such a window lacks at most n - k, where k is the least number that makes up the
share; so it holds one or more of any n - k + 1 of them. These keys of a template are its
least shingles in a hash order (a bottom sketch). Windows without a key of a template of their
size cannot match and are dropped, as are texts without any key before windows are cut; no
match is lost, however short or long the template.

Defined cases: null or empty texts, and texts or templates of fewer than three words, match
nothing; repeated rows of an id are reported once; an occurrence that two windows see is
reported once, as are templates that repeat; empty tables give no rows; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import if_small, store

SHINGLE = 3
CONTAINED = 0.8
# Keys in one test of a text; more templates are sought in further passes.
KEYS = 20_000


def words_of(text: str) -> Column:
    spaced = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    return F.filter(spaced, lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of the shingles in order; empty for fewer words than a shingle has.

    The words are bound by an outer lambda: as a plain column the optimizer would put their
    whole expression in the inner one and split the text anew for every shingle.
    """

    def hashes(w: Column) -> Column:
        last = F.size(w) - (SHINGLE - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(SHINGLE)]))

    return F.element_at(F.transform(F.array(words), hashes), 1)


def keys_of(shingles: str, contained: float) -> Column:
    """The least shingles of a template, of which every window that matches has one."""
    n = F.size(shingles)
    # A hair less, so that rounding adds a key rather than losing one.
    k = F.greatest(F.ceil(n * F.lit(contained) - F.lit(1e-9)), F.lit(1))
    ordered = F.array_sort(F.transform(shingles, lambda s: F.struct(F.xxhash64(s).alias("o"), s.alias("s"))))
    return F.slice(ordered, F.lit(1), (n - k + 1).cast("int"))["s"]


def scan(documents: DataFrame, templates: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """``doc_id, license, start_word, containment`` for ``doc_id, text`` and ``license, text``."""
    known = (
        templates.where("license is not null")
        .withColumn("words", words_of("text"))
        .withColumn("m", F.size("words"))
        .where(F.col("m") >= SHINGLE)
        .withColumn("t", F.array_distinct(shingles_of(F.col("words"))))
        .select("license", "m", "t")
        .distinct()
    )
    known = store(known.withColumn("template", F.monotonically_increasing_id()), "templates")
    keyed = store(
        known.select("template", "m", F.explode(keys_of("t", contained)).alias("least")), "keys"
    )
    hashed = documents.where("text is not null").select("doc_id", shingles_of(words_of("text")).alias("h"))
    # The templates' keys: a vocabulary, not data that grows with the texts.
    keys = sorted(r.least for r in keyed.select("least").distinct().toLocalIterator())
    found = None
    for low in range(0, max(1, len(keys)), KEYS):
        part = keys[low : low + KEYS]
        listed = F.array(*[F.lit(k) for k in part]).cast("array<bigint>")
        own = keyed.where(F.col("least").isin(part)) if len(keys) > KEYS else keyed
        likely = hashed.where(F.arrays_overlap("h", listed)).withColumn("k", F.array_intersect("h", listed))
        hits = windows_with(store(likely, "likely"), known, own, contained)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "license", "start_word").agg(F.max("containment").alias("containment"))


def windows_with(hashed: DataFrame, known: DataFrame, keyed: DataFrame, contained: float) -> DataFrame:
    sizes = [F.lit(r.m) for r in keyed.select("m").distinct().collect()]  # lengths of templates
    if not sizes:
        sizes = [F.lit(SHINGLE)]
    last = F.greatest(F.size("h") - 1, F.lit(0))
    spans = F.flatten(
        F.transform(
            F.array(*sizes),
            lambda m: F.transform(
                F.sequence(F.lit(0), last, m), lambda at: F.struct(m.alias("m"), at.alias("start"))
            ),
        )
    )
    windows = hashed.select("doc_id", "h", "k", F.inline(spans)).select(
        "doc_id", "k", "start", "m", F.expr(f"slice(h, start + 1, 2 * m - {SHINGLE - 1})").alias("w")
    )
    share = F.size(F.array_intersect("t", "w")) / F.size("t")
    met = (
        windows.select("doc_id", "start", "w", "m", F.explode(F.array_intersect("w", "k")).alias("least"))
        .join(if_small(keyed), ["m", "least"])
        .select("doc_id", "start", "w", "template")
        .join(if_small(known, 8 * F.size("t")).drop("m"), "template")
    )
    first = F.array_min(
        F.transform(
            F.filter(F.array_distinct("w"), lambda s: F.array_contains("t", s)),
            lambda s: F.array_position("w", s),
        )
    )
    return met.where(share >= contained).select(
        "doc_id",
        "license",
        (F.col("start") + first - 1).cast("long").alias("start_word"),
        share.alias("containment"),
    )
