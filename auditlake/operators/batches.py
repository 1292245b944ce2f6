"""Claims that one reading answers, and what became of the readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numeric import is_missing
from auditlake.operators.cohorts import bare, comparison

#: Confidence from which on a reading is accepted (fixed value).
ACCEPT = 0.7


def target_shape(group: Column) -> Column:
    """Whether a claim is about the study, one arm or a comparison of two."""
    return F.when(comparison(group).isNotNull(), "comparison").when(F.lower(F.trim(F.coalesce(group, F.lit("")))).isin("all", "-"), "study").otherwise("arm")


def claim_kind(value: Column, label: Column) -> Column:
    """A cell that repeats its arm's label asks what the arm is."""
    return F.when((bare(value) != "") & (bare(value) == bare(label)), "arm_identity").otherwise("value")


def declared_id(*names: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))


def claim_locator(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def question_id(*parts: str) -> Column:
    """A hash over everything that a question holds, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(parts))), 256)


def group_claims(claims: DataFrame, key: list[str], order: str, claim: str) -> DataFrame:
    """Batches in the order of their first claim, each with its claims in order. A batch is a few claims on one paper's field."""
    held = claims.groupBy(*key).agg(F.count("*").alias("claims"), F.min(order).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(claim).alias("c")))), lambda x: x["c"]).alias("members"))
    return held


def plan_counts(batches: DataFrame, by: list[str]) -> DataFrame:
    """How many batches there are, of how many claims, of one claim only, and the largest. batches: claims, a number for each."""
    return batches.groupBy(*by).agg(F.count("*").alias("batches"), F.sum("claims").alias("claims"), F.count_if(F.col("claims") == 1).alias("singletons"), F.max("claims").alias("largest"))


def rollup(calls: DataFrame, by: list[str], *counters: str) -> DataFrame:
    """Calls, and of each counter the sum, null where nothing was reported, and the number of calls that reported it."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *(x for c in counters for x in (F.sum(c).alias(c), F.count(c).alias(f"{c}_reported" if len(counters) > 1 else "reported"))))


def once(readings: DataFrame, key: str, order: str) -> DataFrame:
    """Readings of one execution, once, as they came first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return readings.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def call_failed(error: Column, reason: Column, permanent: Column) -> Column:
    """Whether the call itself broke; then the paper said nothing either way."""
    told = lambda c: F.coalesce(c, F.lit(""))
    return F.coalesce(permanent, F.lit(False)) | (F.trim(told(error)) != "") | F.contains(F.lower(F.concat_ws(" ", told(error), told(reason))), F.lit("extraction call failed"))


def retry_reason(failed: Column, found: Column, agreement: Column, confidence: Column) -> Column:
    """Why a reading is asked for again, from the one before; null where there is no reason to."""
    return F.when(failed, "call_failed").when(agreement == F.lit(False), "disagreement").when(confidence < ACCEPT, "low_confidence").when(~F.coalesce(found, F.lit(False)), "not_found")


def retries(attempts: DataFrame, record: str, order: str) -> DataFrame:
    """Retries by their reason: each attempt but a record's last has one. attempts: error, not_found_reason, permanent, found, agreement, confidence."""
    last = F.lead(order).over(Window.partitionBy(record).orderBy(order)).isNull()
    reason = retry_reason(call_failed(F.col("error"), F.col("not_found_reason"), F.col("permanent")), F.col("found"), F.col("agreement"), F.col("confidence"))
    return attempts.withColumn("_last", last).where("not _last").groupBy(reason.alias("reason")).agg(F.count("*").alias("retries"))


def reading_outcome(status: Column, batch_error: Column, entries: Column, rejected: Column, usable: Column, said_nothing: Column) -> Column:
    """What a reviewer is told of a reading. A response whose every part was refused has failed; only one that said that there is nothing, and had nothing refused, is the paper's silence."""
    empty = (entries == 0) & (rejected == 0) & said_nothing
    return F.when(status.isin("ok", "derived"), "found").when((status == "batch_failed") | batch_error, "extraction_failed").when((entries + rejected > 0) & ~usable, "extraction_failed").when(empty, "missing_source").otherwise("extraction_unresolved")


def reflection(retrieved: Column, agreement: Column, confidence: Column, attempt: Column, most: int = 2, accept: float = ACCEPT, escalate: float = 0.4) -> Column:
    """accept, retry or escalate: what is missing, disputed or middling is asked for again while attempts are left."""
    again = F.when(attempt + 1 < most, "retry").otherwise("escalate")
    return F.when(~retrieved, again).when(agreement == F.lit(False), again).when(confidence.isNull() | (confidence >= accept), "accept").when(confidence < escalate, "escalate").otherwise(again)


def escalates(label: Column, reason: Column, review: Column, source: Column) -> Column:
    """Only two stated texts that can't be read as numbers are worth a judgement on meaning."""
    return (label == "not_comparable") & F.contains(F.coalesce(reason, F.lit("")), F.lit("could not be parsed")) & ~is_missing(review) & ~is_missing(source)


def count_difference(reported: Column, actual: Column) -> Column:
    """How far a reported number of hits is from the actual one: over 30 % of the larger is major, over 5 % minor; none where nothing was reported."""
    off = F.abs(reported - actual) / F.nullif(F.greatest(reported, actual), F.lit(0))
    return F.when(reported.isNull() | ((reported == 0) & (actual == 0)), "none").when(actual == 0, "zero").when(off > 0.3, "major").when(off > 0.05, "minor").otherwise("none")


def search_query(terms: Column, raw: Column, dates: Column) -> Column:
    """A search's terms joined, else its text as it was written, within its dates."""
    base = F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.array_join(terms, " AND ")).otherwise(F.coalesce(raw, F.lit("")))
    return F.when(F.coalesce(dates, F.lit("")) != "", F.concat(base, F.lit(" AND ("), dates, F.lit("[dp])"))).otherwise(base)


def without_field_tags(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"\[[^\]]*\]", ""), r"\s+", " "))


def merged_resolutions(records: DataFrame, key: str) -> DataFrame:
    """One record for each key: how many cells it covers, cache hits in all, every candidate once, the checks that all passed, and mixed where statuses or field types differ (then without a field type). records: status, field_type, cache_hits, candidates, checks."""
    checks = records.select(key, F.explode("checks").alias("check", "passed")).groupBy(key, "check").agg(F.bool_and("passed").alias("passed"))
    failed = checks.where("not passed").groupBy(key).agg(F.array_sort(F.collect_list("check")).alias("failed_checks"))
    held = records.groupBy(key).agg(F.count("*").alias("cells"), F.sum("cache_hits").alias("cache_hits"), F.count_distinct("status").alias("_s"), F.count_distinct("field_type").alias("_f"), F.min("status").alias("_status"), F.min("field_type").alias("_field"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("candidates")))).alias("candidates"))
    out = held.join(failed, key, "left")
    mixed = (F.col("_s") > 1) | (F.col("_f") > 1)
    return out.select(key, "cells", "cache_hits", F.when(mixed, "mixed").otherwise(F.col("_status")).alias("status"), F.when(F.col("_f") <= 1, F.col("_field")).alias("field_type"), "candidates", F.coalesce("failed_checks", F.array().cast("array<string>")).alias("failed_checks"))


def first_failures(events: DataFrame, key: list[str], order: str, message: str) -> DataFrame:
    """Failures counted, each kind with the message that came first."""
    return events.groupBy(*key).agg(F.count("*").alias("n"), F.min_by(message, order).alias("first_message"))


def text_from_index(places: DataFrame, key: list[str], word: str, at: str) -> DataFrame:
    """Texts put together from the places of their words (an array of places for each word)."""
    each = places.select(*key, F.col(word).alias("_word"), F.explode(at).alias("_pos"))
    back = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_word"))).alias("_all"))
    return back.select(*key, F.array_join(F.col("_all._word"), " ").alias("text"))


def answer_json(raw: Column) -> Column:
    """The JSON object of a model's answer, without its thoughts: the whole answer, what a fence holds, or from the first brace to the last; null where there is none."""
    said = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<think>.*?</think>", ""))
    fenced = F.trim(F.regexp_extract(said, r"(?s)```(?:json)?\s*(.*?)```", 1))
    braces = F.regexp_substr(said, F.lit(r"(?s)\{.*\}"))
    whole = lambda x: F.when(F.startswith(x, F.lit("{")) & F.endswith(x, F.lit("}")) & F.get_json_object(x, "$").isNotNull(), x)
    return F.coalesce(whole(said), whole(fenced), whole(braces))


def leaked(answer: Column, examples: list[str]) -> Column:
    """Words of the prompt's own examples that an answer repeats."""
    return F.filter(F.array(*map(F.lit, examples)), lambda e: F.contains(F.coalesce(answer, F.lit("")), e))
