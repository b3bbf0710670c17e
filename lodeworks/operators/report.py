"""The report of an enrichment run, gathered while its lanes are written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodeworks.functions.exprs import has_items

# The steps of the completeness scores.
STEPS = (0, 25, 50, 75, 100)
CONFIDENCES = ("high", "medium", "low")
STATUSES = ("enriched", "rejected", "failed")


def metrics(
    fields: Mapping[str, Column], contacts: Mapping[str, Column], scores: Sequence[str], links: str
) -> dict[str, Column]:
    """Counts of one run; those of fields, contacts and scores are over the enriched rows."""
    good = F.col("status") == "enriched"
    out = {"n_rows": F.count("*")}
    out |= {f"n_{s}": F.count_if(F.col("status") == s) for s in STATUSES}
    out |= {f"field_{k}": F.count_if(good & c) for k, c in fields.items()}
    out |= {f"contact_{k}": F.count_if(good & c) for k, c in contacts.items()}
    out |= {f"confidence_{k}": F.count_if(good & (F.col("overall_confidence") == k)) for k in CONFIDENCES}
    for score in scores:
        step = F.floor(F.least(F.col(score), F.lit(STEPS[-1])) / STEPS[1]) * STEPS[1]
        out |= {f"{score}_{s}": F.count_if(good & (step == s)) for s in STEPS}
    listed = F.when(good & has_items(links), F.size(links)).otherwise(0)
    out |= {"n_links": F.coalesce(F.sum(listed), F.lit(0))}
    for cost in ("elapsed", "tokens"):
        out |= {f"sum_{cost}": F.coalesce(F.sum(cost), F.lit(0)), f"known_{cost}": F.count(cost)}
    return out


def write_lanes(
    results: DataFrame,
    out: str,
    fields: Mapping[str, Column],
    contacts: Mapping[str, Column],
    scores: Sequence[str] = ("tier1_completeness", "tier2_completeness"),
    links: str = "partner_contacts",
) -> DataFrame:
    """Writes the rows to a folder per ``status`` and returns the report, ``measure, value``.

    The counts are observed on the rows as they pass to the writer: one pass, no second scan.
    """
    seen = Observation()
    counted = results.observe(seen, *[c.alias(k) for k, c in metrics(fields, contacts, scores, links).items()])
    counted.write.mode("overwrite").partitionBy("status").parquet(out)
    return report(results, seen.get, fields, contacts)


def report(results: DataFrame, n: Mapping[str, float], fields: Mapping[str, Column], contacts: Mapping[str, Column]) -> DataFrame:
    """The counts with the shares and means a reader wants, one row per measure."""
    good = n["n_enriched"]

    def percent(part: float, whole: float) -> float:
        return round(100.0 * part / whole, 1) if whole else 0.0

    def mean(total: float, count: float) -> float:
        return round(total / count, 3) if count else 0.0

    rows = [(k, float(v)) for k, v in n.items() if not k.startswith(("sum_", "known_"))]
    rows += [(f"pct_{s}", percent(n[f"n_{s}"], n["n_rows"])) for s in STATUSES]
    rows += [(f"pct_field_{k}", percent(n[f"field_{k}"], good)) for k in fields]
    rows += [(f"pct_contact_{k}", percent(n[f"contact_{k}"], good)) for k in contacts]
    rows += [("links_per_row", mean(n["n_links"], good))]
    rows += [(f"mean_{c}", mean(n[f"sum_{c}"], n[f"known_{c}"])) for c in ("elapsed", "tokens")]
    return results.sparkSession.createDataFrame(rows, "measure string, value double")
