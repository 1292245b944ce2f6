"""From the readings of a batch to the answer of one claim: first which target, then which reading of it, by rules in order; the first that fails is the reason.

Readings of one target in one batch are as few as a paper prints; they travel as one list. A claim's
siblings are never looked at: another claim's failure isn't this one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import shared_share
from auditlake.operators.cohorts import telling_tokens
from auditlake.operators.targets import SIDE, assigned, resolve_sides

AXES = ("basis", "analysis_set")


def targets_of(entries: DataFrame) -> DataFrame:
    """The targets of each batch with their usable readings in order: batch, shape, arm_label, left_label, right_label, readings. entries: batch, pos, shape, arm_label, left_label, right_label, basis, analysis_set, timepoint, value, quote, usable."""
    reading = F.struct("pos", "basis", "analysis_set", "timepoint", "value", "quote")
    names = [F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("arm_label", "left_label", "right_label")]
    return entries.where("usable").groupBy("batch", "shape", *names).agg(F.array_sort(F.collect_list(reading)).alias("readings"))


def by_batch(targets: DataFrame) -> DataFrame:
    """What each batch has, in one row: theirs (labels of its arms, in order; null without one), arms (label, readings), whole (readings of the whole study) and anything."""
    arm, study = F.col("shape") == "arm", F.col("shape") == "study"
    labels = F.array_sort(F.collect_set(F.when(arm, F.col("arm_label"))))
    arms = F.collect_list(F.when(arm, F.struct(F.col("arm_label").alias("label"), "readings")))
    return targets.groupBy("batch").agg(F.when(F.count_if(arm) > 0, labels).alias("theirs"), arms.alias("arms"), F.flatten(F.collect_list(F.when(study, F.col("readings")))).alias("whole"), F.lit(True).alias("anything"))


def single_candidates(requests: DataFrame, review: DataFrame, targets: DataFrame) -> DataFrame:
    """requests of an arm or a whole study with readings of it, or the status and reason that stand in the way, and whether the batch has anything. All arms of a review and of a batch are assigned at once."""
    ours = review.where("trim(label) <> ''").groupBy("study").agg(F.array_sort(F.collect_set(F.struct("arm", "label"))).alias("ours"))
    arm, per = F.col("shape") == "arm", by_batch(targets)
    sides = lambda rows: rows.join(ours, "study", "left").join(per, "batch", "left").withColumns({"known": F.col("ours").isNotNull(), "ours": F.when(arm, F.col("ours")), "theirs": F.when(arm, F.col("theirs"))})
    held = assigned(sides(requests), stated=sides(requests.where("shape = 'arm'").select("batch", "study", "shape").distinct())).withColumnRenamed("reason", "why")
    mine = F.get(F.filter("pairs", lambda x: x["arm"] == F.col("cohort_key")), F.lit(0))["label"]
    held = held.withColumn("mine", mine).withColumn("of_arm", F.get(F.filter("arms", lambda x: x["label"] == F.col("mine")), F.lit(0))["readings"])
    status = F.when(arm, F.when((F.coalesce("cohort_key", F.lit("")) == "") | ~F.col("known"), "unsupported").when(F.col("why").isNotNull(), "ambiguous").when(F.col("of_arm").isNull(), "not_reported"))
    held = held.withColumn("first_status", status)
    said = F.col("first_status")
    reason = F.when(said == "unsupported", "no cohort was asked for").when(said == "ambiguous", F.concat(F.lit("arms: "), F.col("why"))).when(said == "not_reported", "no arm of the batch is the one asked for")
    return held.select(*requests.columns, "anything", "first_status", reason.alias("first_reason"), F.when(said.isNull(), F.when(arm, F.col("of_arm")).otherwise(F.col("whole"))).alias("readings"))


def comparison_candidates(requests: DataFrame, review: DataFrame, targets: DataFrame) -> DataFrame:
    """requests of a comparison with readings of the one pair of the batch that is it, in its direction, or the status and reason that stand in the way, and whether the batch has anything."""
    pairs = targets.where("shape = 'comparison'").groupBy("batch").agg(F.collect_list(F.struct("left_label", "right_label", "readings")).alias("pairs"))
    anything = targets.select("batch").distinct().withColumn("anything", F.lit(True))
    held = resolve_sides(requests, review).join(pairs, "batch", "left").join(anything, "batch", "left")
    held = held.withColumns({"l": telling_tokens(F.col("left_label")), "r": telling_tokens(F.col("right_label"))})
    fit = lambda a, b, x: F.least(shared_share(F.col(a), telling_tokens(x["left_label"])), shared_share(F.col(b), telling_tokens(x["right_label"])))
    scored = F.transform("pairs", lambda x: F.struct(fit("l", "r", x).alias("forward"), fit("r", "l", x).alias("turned"), x["left_label"].alias("a"), x["right_label"].alias("b"), x["readings"].alias("readings")))
    held = held.withColumn("ranked", F.sort_array(F.transform(scored, lambda x: F.struct(x["forward"].alias("forward"), x["turned"].alias("turned"), x["a"].alias("a"), x["b"].alias("b"), x["readings"].alias("readings"))), asc=False))
    held = held.withColumns({"best": F.get("ranked", F.lit(0)), "next": F.get("ranked", F.lit(1))["forward"]})
    forward, turned = F.col("best.forward"), F.col("best.turned")
    rules = [
        (F.col("why").isNotNull(), "unsupported", "the sides aren't two arms of the review"), (F.col("best").isNull(), "not_reported", "the batch has no comparison"), ((turned > forward) & (turned >= SIDE), "unsupported", "reported the other way round"),
        (forward < SIDE, "not_reported", "no comparison of the batch is the one asked for"), (F.coalesce(F.col("next") >= forward, F.lit(False)), "ambiguous", "two comparisons are as alike"),
    ]
    return held.select(*requests.columns, "anything", first_failing(rules, 1).alias("first_status"), first_failing(rules, 2).alias("first_reason"), "best.readings")


def first_failing(rules: list[tuple], at: int) -> Column:
    """What stands at a place of the first rule (condition, ...) whose condition holds; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(rule[0], F.lit(False)), F.lit(rule[at])) for rule in rules), F.lit(None).cast("string"))


def select_reading(rows: DataFrame) -> DataFrame:
    """rows (readings, basis, analysis_set, required, timepoint) with status, reason and reading (what was chosen of one target's readings).

    Readings of another population than the requested one, on the axes that are required, go. Where several are left with different timepoints, the one that is most like the asked timepoint is taken; a single timepoint isn't held against the claim. What is left must agree on one value.
    """
    fits = lambda x: F.forall(F.coalesce("required", F.array().cast("array<string>")), lambda a: F.coalesce(*(F.when(a == axis, F.coalesce(x[axis] == F.col(axis), F.lit(False))) for axis in AXES), F.lit(False)))
    asked = (F.size(F.coalesce("required", F.array().cast("array<string>"))) > 0) & (F.col("basis").isNotNull() | F.col("analysis_set").isNotNull())
    held = rows.withColumn("_fit", F.when(asked, F.filter("readings", fits)).otherwise(F.col("readings")))
    phrases = F.array_distinct(F.filter(F.col("_fit.timepoint"), lambda t: F.coalesce(t, F.lit("")) != ""))
    told = (F.coalesce("timepoint", F.lit("")) != "") & (F.size("_fit") > 1) & (F.size(phrases) > 1)
    words = telling_tokens(F.col("timepoint"))
    ranked = F.sort_array(F.transform("_fit", lambda x, i: F.struct(shared_share(words, telling_tokens(x["timepoint"])).alias("score"), (-i).alias("first"), x.alias("x"))), asc=False)
    held = held.withColumn("_ranked", F.when(told, ranked))
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    rest = F.when(F.col("_ranked").isNotNull(), F.array(best["x"])).otherwise(F.col("_fit"))
    values = F.array_distinct(F.col("_rest.value").cast("array<string>"))
    held = held.withColumns({"_none": best["score"] <= 0, "_tie": second["score"] >= best["score"], "_rest": rest})
    rules = [
        (F.coalesce(F.size("readings"), F.lit(0)) < 1, "not_reported", "no usable reading"), (F.size("_fit") == 0, "scope_unresolved", "no reading of the population asked for"), (F.col("_none"), "timepoint_unresolved", "no reading at the timepoint asked for"),
        (F.col("_tie"), "timepoint_unresolved", "two readings are as near to the timepoint"), (F.size(values) > 1, "contradictory", "readings differ"),
    ]
    status = F.coalesce(first_failing(rules, 1), F.lit("ok"))
    held = held.withColumns({"status": status, "reason": first_failing(rules, 2), "reading": F.when(status == "ok", F.get("_rest", F.lit(0)))})
    return held.drop("_fit", "_ranked", "_rest", "_none", "_tie")


def study_outcome(explicit_status: Column, printed: Column, total: Column, exact: Column, timed: Column) -> Column:
    """What a whole-study claim gets from the printed total (its status and value) and from the sum of the arms (null where they can't be added; exact: of just the population asked for; timed: at a verified timepoint): status and value.

    A printed total that is one whole number must agree with the sum; a sum may fill a silence, but settles no argument between printed totals, nor stands in for people or a time that it isn't of.
    """
    number = F.when(F.trim(printed).rlike("^[0-9][0-9,]*$"), F.replace(F.trim(printed), F.lit(","), F.lit("")).try_cast("long"))
    ok = explicit_status == "ok"
    against = ok & F.coalesce(number != total, F.lit(False))
    kept = explicit_status.isin("contradictory", "ambiguous") | ((explicit_status == "scope_unresolved") & ~F.coalesce(exact, F.lit(False))) | ((explicit_status == "timepoint_unresolved") & ~F.coalesce(timed, F.lit(False)))
    status = F.when(against, "contradictory").when(ok, "ok").when(kept, explicit_status).when(total.isNotNull(), "derived").otherwise(explicit_status)
    return F.struct(status.alias("status"), F.when(status == "ok", printed).when(status == "derived", total.cast("string")).alias("value"))


def project(requests: DataFrame, review: DataFrame, entries: DataFrame, batches: DataFrame, sums: DataFrame) -> DataFrame:
    """One row for each request: id, status, value, quote and reason.

    requests: id, batch, study, shape (arm, comparison, study), cohort_key, left, right, basis, analysis_set, required (axes), timepoint; review: study, arm, label; entries: see targets_of(); batches: batch, error; sums: id, total, exact, timed, of study requests. A batch that failed answers none of its claims. Ids are unique; repeated entries are readings that agree.
    """
    targets = targets_of(entries)
    asked = requests.join(sums, "id", "left").join(batches, "batch", "left")
    single = single_candidates(asked.where("shape in ('arm', 'study')"), review, targets)
    held = select_reading(single.unionByName(comparison_candidates(asked.where("shape = 'comparison'"), review, targets)))
    none = F.lit(None).cast("string")
    study = study_outcome(F.col("status"), F.col("reading.value"), F.col("total"), F.col("exact"), F.col("timed"))
    failed, first = F.coalesce("error", F.lit("")) != "", F.col("first_status").isNotNull()
    held = held.withColumn("whole", study)
    silent = F.col("anything").isNull() & (F.col("shape") != "study")
    status = F.when(failed, "batch_failed").when(silent, "not_reported").when(first, F.col("first_status")).when(F.col("shape") == "study", F.col("whole.status")).otherwise(F.col("status"))
    value = F.when(F.col("shape") == "study", F.col("whole.value")).otherwise(F.col("reading.value"))
    reason = F.when(failed, F.col("error")).when(silent, "no usable reading").when(first, F.col("first_reason")).when(status.isin("ok", "derived"), none).when((status == "contradictory") & (F.col("status") == "ok"), "the printed total and the arms differ").otherwise(F.col("reason"))
    answered = status.isin("ok", "derived")
    return held.select("id", status.alias("status"), F.when(answered, value).alias("value"), F.when(status == "ok", F.col("reading.quote")).alias("quote"), reason.alias("reason"))
