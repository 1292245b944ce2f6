"""Checklists: which of the things that a review should report its claims cover.

A checklist (item, pos, scope, kind, required, field_types, aliases, parts, places) has a few dozen items, so
claims meet its items by field type and by the words of its aliases, not all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numeric import components, with_cells
from auditlake.sources.tables import spread


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def mentions(text: Column, needles: Column) -> Column:
    """Whether any of the needles stands in a text as whole words, without regard to case and signs."""
    padded = F.concat(F.lit(" "), _plain(text), F.lit(" "))
    return F.exists(F.coalesce(needles, F.array().cast("array<string>")), lambda n: (_plain(n) != "") & F.contains(padded, F.concat(F.lit(" "), _plain(n), F.lit(" "))))


def _matching(claims: DataFrame, items: DataFrame) -> DataFrame:
    """As matching_claims, with a pair repeated for each word that claim and item meet by. Items are a checklist's few and are told to all tasks, so that claims stay where they are."""
    held = with_cells(claims.where("value is not null and value <> ''"), _cell=F.col("value"))
    named = F.concat_ws(" ", "raw_name", "header", F.replace("field_type", F.lit("_"), F.lit(" ")))
    held = held.withColumns({"_parts": components(F.col("_cell")), "_said": _plain(named)})
    # an alias is mentioned only where its first word is
    first = lambda x: F.split(_plain(x), " ")[0]
    keys = items.withColumn("_key", F.explode(F.array_distinct(F.concat(F.transform(F.coalesce("field_types", F.array().cast("array<string>")), lambda t: F.concat(F.lit("="), t)), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), first)))))
    asked = held.withColumn("_key", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), "field_type")), F.split("_said", " ")))))
    met = asked.join(F.broadcast(keys.select("_key", "item", "pos", "scope", "field_types", "aliases", "parts")), "_key")
    good = (F.coalesce(F.array_contains("field_types", F.col("field_type")), F.lit(False)) | mentions(F.col("_said"), F.col("aliases"))) & (F.size(F.array_except(F.coalesce("parts", F.array().cast("array<string>")), "_parts")) == 0)
    return met.where(good).select("claim", "study_id", "group", "item", "pos", "scope")


def matching_claims(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a claim and an item that asks for it: its field type is one of the item's or its names hold an alias; it has a value, with all the parts that the item wants. claims: claim, study_id, group, field_type, raw_name, header, value."""
    return _matching(spread(claims, "claim"), items).distinct()


def status_of(expected: Column, found: Column, required: Column | None = None) -> Column:
    missing = F.lit("missing") if required is None else F.when(required, "missing_required").otherwise("missing_optional")
    return F.when(expected == 0, "not_applicable").when(found == expected, "covered").when(found > 0, "partial").otherwise(missing)


def coverage(claims: DataFrame, items: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """For each item: status (covered, partial, missing_required, missing_optional, not_applicable), targets expected and found.

    An item of scope review has one target, one per_study each study (of the list, if there is one), one per_cohort each arm that claims name. Presence items aren't answered by claims.
    """
    known = claims.select("study_id").where("study_id is not null and study_id <> ''").distinct() if studies is None else studies.select("study_id").where("study_id <> ''").distinct()
    arms = claims.where("group not in ('', '-')").join(known, "study_id", "left_semi").select("study_id", "group").distinct()
    target = lambda rows, scope: rows.select(F.lit(scope).alias("scope"), *(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in ("study_id", "group")))
    one = items.sparkSession.range(1).select(F.lit("review").alias("scope"), F.lit("").alias("study_id"), F.lit("").alias("group"))
    every = one.unionByName(target(known, "per_study")).unionByName(target(arms, "per_cohort"))
    found = _matching(spread(claims, "claim"), items.where("kind <> 'presence'"))
    hit = found.select("item", F.when(F.col("scope") == "review", "").otherwise(F.col("study_id")).alias("study_id"), F.when(F.col("scope") == "per_cohort", F.col("group")).otherwise("").alias("group"), F.lit(1).alias("hit")).distinct()
    expected = items.join(every, "scope", "left").join(hit, ["item", "study_id", "group"], "left")
    counted = expected.groupBy("item", "scope", "required").agg(F.count("study_id").alias("expected"), F.count("hit").alias("found"))
    return counted.withColumn("status", status_of(F.col("expected"), F.col("found"), F.col("required")))


def gaps(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Studies that a required item of scope per_study finds nothing in."""
    found = _matching(spread(claims, "claim"), items).select("item", "study_id").distinct()
    wanted = items.where("required and scope = 'per_study'").select("item")
    studies = claims.select("study_id").where("study_id <> ''").distinct()
    # items are a checklist's few, so each study meets each of them
    return studies.join(F.broadcast(wanted)).join(found, ["item", "study_id"], "left_anti").select("item", "study_id")


def owners(claims: DataFrame, items: DataFrame) -> DataFrame:
    """claims with the first item that asks for each, unless they name one already; none is added."""
    claims = spread(claims, "claim")
    first = _matching(claims, items.where("kind <> 'presence'")).groupBy("claim").agg(F.min(F.struct("pos", "item")).alias("first"))
    out = claims.join(first, "claim", "left")
    own = F.nullif(F.col("checklist_id"), F.lit("")) if "checklist_id" in claims.columns else F.lit(None).cast("string")
    return out.withColumn("checklist_id", F.coalesce(own, F.col("first.item"))).drop("first")


def merged(*passes: DataFrame) -> DataFrame:
    """Assessments of several passes over one checklist (version, item, ...); an item that two passes assess, or two versions, is an error when the rows are read."""
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    state = every.groupBy("item").agg(F.count("*").alias("_n"), F.min("version").alias("_v"))
    versions = every.agg(F.count_distinct("version").alias("_versions"))
    checked = every.join(state, "item").join(F.broadcast(versions))
    bad = F.when(F.col("_versions") > 1, F.raise_error(F.lit("passes of different checklists can't be merged"))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("item was evaluated twice: "), "item")))
    return checked.withColumn("_ok", F.coalesce(bad.cast("string"), F.lit(""))).where("_ok = ''").drop("_n", "_v", "_versions", "_ok")
