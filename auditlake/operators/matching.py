"""Joins that refuse with a reason where a match isn't certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_or_refuse(scored: DataFrame, query: list[str], score: str, answer: str) -> DataFrame:
    """The answer with the highest score of each query, or a refusal where several share it. One pass of map-side aggregation: no row order decides."""
    best = F.max(F.struct(score)).alias("best")
    top = scored.groupBy(*query, score).agg(F.countDistinct(answer).alias("n_tied"), F.min(answer).alias("answer"))
    held = top.groupBy(*query).agg(best, F.max_by(F.struct("n_tied", "answer"), score).alias("top"))
    return held.select(*query, F.col(f"best.{score}").alias(score), F.col("top.n_tied").alias("n_tied"), F.when(F.col("top.n_tied") == 1, F.col("top.answer")).alias(answer), F.when(F.col("top.n_tied") > 1, "tie").alias("reason"))


def pair_or_refuse(review: DataFrame, source: DataFrame) -> DataFrame:
    """Pair reported claims with evidence; what isn't paired is given a reason.

    Both sides: id (may be null), key, cell (may be null), pos (orders rows of one key), value. Rows
    with an id pair by it alone: an id that occurs twice on a side refuses all its carriers, one
    without a partner is missing, one whose key or cell differs is a conflict. Rows without an id pair
    by key where it is unique, else by cell, where the last evidence of a cell counts and serves the
    first claim; other claims of the key are ambiguous. Evidence left over is missing a claim where a
    claim with an unmatched id stands at its place, else unclaimed.

    Returns side (pair, review, source), reason (paired, or why not), key, review_value, source_value.
    """
    every = review.select("id", F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(source.select("id", F.lit(0).alias("r"), F.lit(1).alias("s")))
    ids = every.where("id is not null").groupBy("id").agg(F.sum("r").alias("n_review"), F.sum("s").alias("n_source"))

    def told(side: str, reason: Column | str, *values: Column) -> list[Column]:
        return [F.lit(side).alias("side"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.col("key"), *(v.cast("double").alias(n) for v, n in zip(values, ("review_value", "source_value")))]

    null = F.lit(None)
    r_id, s_id = review.where("id is not null").join(ids, "id"), source.where("id is not null").join(ids, "id")
    refused = F.when((F.col("n_review") > 1) | (F.col("n_source") > 1), "duplicate_claim_id").when((F.col("n_review") == 0) | (F.col("n_source") == 0), "claim_identity_missing")
    alone_r = r_id.where(refused.isNotNull()).select(*told("review", refused, F.col("value"), null))
    alone_s = s_id.where(refused.isNotNull()).select(*told("source", refused, null, F.col("value")))
    met = r_id.where(refused.isNull()).alias("r").join(s_id.where(refused.isNull()).alias("s"), "id")
    same = (F.col("r.key") == F.col("s.key")) & F.col("r.cell").eqNullSafe(F.col("s.cell"))
    met = met.select(same.alias("same"), F.col("r.key").alias("key"), F.col("s.key").alias("source_key"), F.col("r.value").alias("rv"), F.col("s.value").alias("sv"))
    by_id = met.where("same").select(*told("pair", "paired", F.col("rv"), F.col("sv")))
    conflict = met.where("not same")
    conflict = conflict.select(*told("review", "claim_identity_key_conflict", F.col("rv"), null)).unionByName(conflict.withColumn("key", F.col("source_key")).select(*told("source", "claim_identity_key_conflict", null, F.col("sv"))))

    # rows without an id: one row for each key and cell holds who is first and last in it
    free = review.where("id is null").select("key", "cell", "pos", "value", F.lit(0).alias("s")).unionByName(source.where("id is null").select("key", "cell", "pos", "value", F.lit(1).alias("s")))
    by_key, by_cell = Window.partitionBy("key"), Window.partitionBy("key", "cell")
    is_r = F.col("s") == 0
    free = (
        free.withColumn("n_r", F.sum(F.when(is_r, 1).otherwise(0)).over(by_key)).withColumn("n_s", F.sum("s").over(by_key))
        .withColumn("rank", F.row_number().over(Window.partitionBy("key", "cell", "s").orderBy(F.when(is_r, F.col("pos")), F.when(~is_r, F.col("pos")).desc(), F.when(is_r, F.col("value")), F.when(~is_r, F.col("value")).desc())))
        .withColumn("other_value", F.max(F.when((F.col("rank") == 1) & ~is_r, F.col("value"))).over(by_cell))
        .withColumn("has_r", F.max(is_r.cast("int")).over(by_cell)).withColumn("has_s", F.max("s").over(by_cell))
        .withColumn("only_value", F.max(F.when(~is_r, F.col("value"))).over(by_key))
    )
    single = (F.col("n_r") == 1) & (F.col("n_s") <= 1)
    by_place = ~single & F.col("cell").isNotNull() & (F.col("rank") == 1) & (F.col("has_r") == 1) & (F.col("has_s") == 1)
    claims = free.where(is_r).withColumn("reason", F.when(single & (F.col("n_s") == 1), "paired").when(single, "no_source_evidence").when(by_place, "paired").otherwise("ambiguous_match_key"))
    claims = claims.select(F.when(F.col("reason") == "paired", "pair").otherwise("review").alias("side"), "reason", "key", F.col("value").cast("double").alias("review_value"), F.when(F.col("reason") == "paired", F.when(single, F.col("only_value")).otherwise(F.col("other_value"))).cast("double").alias("source_value"))
    left = free.where(~is_r & ~((single & (F.col("n_r") == 1)) | by_place))
    lost = r_id.where(refused == "claim_identity_missing").select("key", "cell").distinct().withColumn("lost", F.lit(True))
    left = left.alias("f").join(lost.alias("l"), (F.col("f.key") == F.col("l.key")) & F.col("f.cell").eqNullSafe(F.col("l.cell")), "left").select("f.key", "f.value", "l.lost")
    left = left.select(*told("source", F.when(F.col("lost"), "claim_identity_missing").otherwise("unclaimed_source"), null, F.col("value")))
    parts = [alone_r, alone_s, by_id, conflict, claims, left]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
