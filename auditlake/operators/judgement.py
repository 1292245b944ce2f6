"""Decisions over recorded readings: what is believed, derived, accepted or refused, and which rule had the last word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numeric import implied_pct, relative_error
from auditlake.functions.text import normal

#: Words that negate, relations that a verdict may assert, and the side that each may call more specific.
NEGATION = r"(?i)(?<![a-z])(no|not|none|never|without|absent|absence|non|un|neither|nor)(?![a-z])"
ACCEPTING = ("same", "review_broader", "source_broader")
SIDES = {
    "same": ("neither",),
    "review_broader": ("source",),
    "source_broader": ("review",),
    "different": ("unknown", "neither"),
    "unknown": ("unknown",),
}
GRID = (0.5, 0.6, 0.7, 0.8, 0.9)


def contradicts_itself(relation: Column, side: Column, equivalent: Column) -> Column:
    """The relation is none of the defined ones, or doesn't go with the side called more specific or with the word on equivalence."""
    sides = F.lit(False)
    for name, allowed in SIDES.items():
        sides = sides | ((relation == name) & ((side == "") | side.isin(*allowed)))
    return ~sides | ((relation == "same") & ~equivalent) | ((relation == "different") & equivalent)


def semantic_control(verdict: Column, review: Column, source: Column, numbers_agree: Column, quote: Column, least: float = 0.7) -> Column:
    """Label, failed control and need of review for a recorded verdict (relation, side, equivalent, confidence, span) on two wordings."""
    relation, side = F.lower(F.trim(verdict["relation"])), F.lower(F.trim(F.coalesce(verdict["side"], F.lit(""))))
    span = normal(verdict["span"])
    told = lambda label, failed, review: F.struct(F.lit(label).alias("label"), F.lit(failed).alias("failed"), F.lit(review).alias("review_required"))
    return (
        F.when(~numbers_agree, told("mismatch", "numeric", False))
        .when(F.rlike(review, F.lit(NEGATION)) != F.rlike(source, F.lit(NEGATION)), told("mismatch", "polarity", False))
        .when(contradicts_itself(relation, side, verdict["equivalent"]), told("not_comparable", "relation_direction", True))
        .when(relation == "different", told("mismatch", "", False))
        .when(~relation.isin(*ACCEPTING) | (verdict["confidence"] < least), told("not_comparable", "confidence", True))
        .when((F.coalesce(quote, F.lit("")) != "") & ((span == "") | ~F.contains(normal(quote), span)), told("not_comparable", "anchor", True))
        .when(relation == "same", told("match", "", False))
        .otherwise(told("match", "", True))
    )


def threshold_curve(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """How many claims of equivalence each threshold accepts; one pass, as columns, then rows."""
    accepting = F.col("relation").isin(*ACCEPTING)
    counted = verdicts.groupBy(*by).agg(*(F.count_if(accepting & (F.col("confidence") >= t)).alias(f"{t:.2f}") for t in GRID))
    return counted.unpivot(by, [F.col(f"`{t:.2f}`") for t in GRID], "threshold", "accepted")


def row_state(predicted: Column, expected: Column, review_required: Column) -> Column:
    refused = F.coalesce(predicted, F.lit("")).isin("not_comparable", "review_required")
    return F.when(refused, "refused").when(predicted.eqNullSafe(expected), "correct").when(review_required, "wrong_but_flagged").otherwise("wrong_released")


def derived_total(arms: DataFrame, key: str, least: int = 2) -> DataFrame:
    """The sum over a key's arms (pos, label, n), or the first reason against it.

    Each row carries what was declared for its key: complete, exclusive, anchored, declared (arms).
    Arms are a table's columns, so the list of a key is short.
    """
    held = arms.groupBy(key).agg(
        F.count("*").alias("k"), F.count_distinct(F.nullif(F.col("label"), F.lit(""))).alias("labels"), F.sum("n").alias("sum"),
        F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("parts"), *(F.bool_and(c).alias(c) for c in ("complete", "exclusive", "anchored")), F.max("declared").alias("declared"),
    )
    reason = (
        F.when(F.col("labels") < F.col("k"), "same_arm_twice").when(F.col("k") < least, "too_few_arms")
        .when(F.col("complete").isNull() | F.col("exclusive").isNull(), "no_partition_stated").when(~F.col("complete"), "not_complete").when(~F.col("exclusive"), "overlap")
        .when(~F.coalesce(F.col("anchored"), F.lit(False)), "not_anchored").when(F.col("declared").isNull(), "no_census").when(F.col("declared") != F.col("k"), "arm_missing")
    )
    out = held.withColumn("reason", reason).withColumn("total", F.when(F.col("reason").isNull(), F.col("sum")))
    shown = F.array_join(F.transform("parts", lambda p: p["n"].cast("string")), " + ")
    return out.select(key, F.when(F.col("reason").isNull(), "derived").otherwise("rejected").alias("status"), "reason", "total", F.when(F.col("reason").isNull(), F.concat(shown, F.lit(" = "), F.col("sum").cast("string"))).alias("derivation"))


def gate_status(hard_failed: Column, hard_missing: Column, floor_unmet: Column, under_bar: Column) -> Column:
    """A hard gate that failed outranks what can't be estimated, and that a lower bound under its bar."""
    return F.when(hard_failed, "FAIL").when(hard_missing | floor_unmet, "NOT_ESTIMABLE").when(under_bar, "FAIL").otherwise("PASS")


def flag_of(label: Column, reason: Column, outcome: Column, review_required: Column) -> Column:
    """What is flagged about a claim: a mismatch; a match only if it asks for a review; what wasn't comparable or had no evidence by what became of its collection, where that is known; any other reason as it is."""
    silent = (label == "not_comparable") | (label.isNull() & (reason == "no_source_evidence"))
    known = F.coalesce(outcome, F.when(label == "not_comparable", "not_comparable").otherwise("missing_source"))
    return F.when(label == "mismatch", "detected_error").when(label == "match", F.when(review_required, "review_required")).when(F.coalesce(silent, F.lit(False)), known).when(label.isNull(), reason)


def grouped_flags(flags: DataFrame, by: list[str], study: str = "study_id") -> DataFrame:
    """Flags about one thing as one, with the cells and studies that they concern."""
    return flags.groupBy(*by).agg(F.count("*").alias("cells"), F.count_distinct(study).alias("studies"))


def accept_reference(candidates: DataFrame, key: str, threshold: float = 0.72, bonus: float = 0.1) -> DataFrame:
    """The best candidate (score, resolver, doi) of each key; one that several resolvers name by its DOI gains a bonus. Of equal scores the first resolver's and then the first DOI counts.

    Votes meet by key and DOI before they meet by key, so that a key with many candidates is aggregated on the way.
    """
    doi = F.lower(F.nullif(F.trim("doi"), F.lit("")))
    by_doi = candidates.withColumn("doi", doi).groupBy(key, "doi").agg(F.max(F.struct("score", (-F.col("resolver")).alias("r"))).alias("best"), F.count_distinct("resolver").alias("resolvers"))
    order = F.struct(F.col("best.score"), F.col("best.r"), F.col("doi").isNotNull())
    best = by_doi.groupBy(key).agg(F.max(F.struct(order.alias("o"), F.struct("doi", "resolvers").alias("x"))).alias("m"))
    confidence = F.least(F.lit(1.0), F.col("m.o.score") + F.when(F.col("m.x.doi").isNotNull() & (F.col("m.x.resolvers") >= 2), bonus).otherwise(0.0))
    out = best.select(key, F.round(confidence, 6).alias("confidence"), (-F.col("m.o.r")).alias("resolver"), F.col("m.x.doi").alias("doi"))
    good = (F.col("confidence") >= threshold) & F.col("doi").isNotNull()
    return out.select(key, F.when(good, "resolved").otherwise("unresolved_source").alias("status"), "confidence", "resolver", F.when(good, F.col("doi")).alias("doi"))


def consensus(samples: DataFrame, key: str) -> DataFrame:
    """The signature that two of a key's samples share; a third sample is asked only where the first two differ."""
    voted = samples.where("sample <= 3").groupBy(key).agg(*(F.max(F.when(F.col("sample") == i, F.col("signature"))).alias(f"s{i}") for i in (1, 2, 3)))
    s1, s2, s3 = (F.col(f"s{i}") for i in (1, 2, 3))
    agreed = F.when(s1 == s2, s1).when((s1 == s3) | (s2 == s3), s3)
    asked = F.when(s1 == s2, 2).otherwise(sum((s.isNotNull().cast("int") for s in (s2, s3)), s1.isNotNull().cast("int")))
    return voted.select(key, agreed.alias("signature"), asked.alias("asked"), F.when(agreed.isNotNull(), "stable").otherwise("unstable").alias("stability"))


def numbers_agree(a: Column, b: Column, tolerance: float) -> Column:
    """Two parsed cells: levels and counts are equal, percentages, bounds of intervals and leading numbers within the band. A leading count isn't a value; numbers that can't be set side by side don't agree."""
    pct = lambda x: F.coalesce(x["pct"], implied_pct(x))
    share = a["events"].isNotNull() | b["events"].isNotNull()
    near = [relative_error(x, y) <= tolerance for x, y in ((pct(a), pct(b)), (a["ci_lower"], b["ci_lower"]), (a["ci_upper"], b["ci_upper"]))]
    near.append(F.when(~share, relative_error(a["primary"], b["primary"]) <= tolerance))
    held = F.array_compact(F.array(*near))
    differ = F.coalesce(a["ci_level"] != b["ci_level"], F.lit(False)) | F.coalesce(a["events"] != b["events"], F.lit(False))
    return ~differ & F.when(F.size(held) == 0, a["primary"].isNull() | b["primary"].isNull()).otherwise(F.forall(held, lambda x: x))
