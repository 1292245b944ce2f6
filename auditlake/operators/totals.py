"""Which set of counts answers a claim on a whole study, and under which rules it may be summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.compare import scope_verdict

_NONE = "array<string>"


def moment(text: Column) -> Column:
    """A timepoint's words, without regard to case and signs; only the same words are the same moment."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\w\s]", " ")), r"\s+", " "))


def effective_axes(shape: Column, field: Column, required: Column, stated: Column, shapes: list[str], fields: list[str], floor: list[str]) -> Column:
    """Axes that a total is held to: those of the run, and where the policy is about such claims also its own and those that the claim states."""
    own = F.coalesce(required, F.array().cast(_NONE))
    raised = F.array_union(F.array_union(own, F.array(*map(F.lit, floor))), F.coalesce(stated, F.array().cast(_NONE)))
    return F.array_sort(F.when(shape.isin(shapes) & field.isin(fields), raised).otherwise(F.array_distinct(own)))


def choose_set(claims: DataFrame, sets: DataFrame, fields: list[str], shape: str = "study") -> DataFrame:
    """For each claim the one set of counts that answers it, or why none does.

    claims: claim, study, shape, field_type, basis, analysis (null where not stated), timepoint. sets: study, set, basis, analysis, timepoint, broken (could not be read whole). A broken set stands in the way unless it is certainly about other people or another moment; a claim that doesn't name its population, or names a timepoint that a set is silent on, is refused.
    """
    c = claims.withColumn("permitted", (F.col("shape") == shape) & F.col("field_type").isin(fields))
    met = c.select("claim", "study", F.col("basis").alias("_b"), F.col("analysis").alias("_a"), F.col("timepoint").alias("_t")).join(sets, "study")
    people = F.array(scope_verdict(F.col("_b"), F.col("basis"), F.lit(True)), scope_verdict(F.col("_a"), F.col("analysis"), F.col("_a").isNotNull()))
    asks = F.coalesce(F.col("_t"), F.lit("")) != ""
    silent = asks & (F.coalesce("timepoint", F.lit("")) == "")
    other_moment = asks & ~silent & (moment(F.col("timepoint")) != moment(F.col("_t")))
    met = met.withColumns({"other": F.array_contains(people, "mismatch"), "same": F.forall(people, lambda v: v.isin("resolved", "not_required")), "silent": silent, "moved": other_moment})
    told = met.groupBy("claim").agg(
        F.count_if(F.col("broken") & ~F.col("other") & ~F.col("moved")).alias("blocking"), F.count_if(F.col("broken") & (F.col("other") | F.col("moved"))).alias("aside"), F.count_if(~F.col("broken")).alias("offered"),
        F.count_if(~F.col("broken") & F.col("same") & F.col("silent")).alias("untimed"), F.count_if(~F.col("broken") & F.col("same")).alias("fitting"), F.count_if(~F.col("broken") & F.col("same") & ~F.col("moved")).alias("left"),
        F.min(F.when(~F.col("broken") & F.col("same") & ~F.col("moved"), F.col("set"))).alias("chosen"),
    )
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    named = F.col("basis").isNotNull() | F.col("analysis").isNotNull()
    out = c.join(told, "claim", "left")
    reason = (
        F.when(~F.col("permitted"), "not_permitted").when(n("blocking") > 0, "broken_set").when(n("offered") == 0, "nothing_offered").when(~named, "population_not_named").when(n("untimed") > 0, "set_without_timepoint")
        .when((n("fitting") > 0) & (n("left") == 0), "other_timepoint").when(n("left") == 0, "no_fitting_population").when(n("left") > 1, "several_sets")
    )
    return out.select("claim", F.when(reason.isNull(), F.col("chosen")).alias("set"), reason.alias("reason"), n("aside").alias("aside"))


def total_of(printed: Column, derived: Column) -> Column:
    """A printed total comes first and a sum only fills its silence; where they differ the reading contradicts itself."""
    return F.when(printed.isNotNull() & derived.isNotNull() & (printed != derived), F.struct(F.lit(None).cast("long").alias("total"), F.lit("contradictory").alias("status"))).when(printed.isNotNull(), F.struct(printed.cast("long").alias("total"), F.lit("ok").alias("status"))).when(derived.isNotNull(), F.struct(derived.cast("long").alias("total"), F.lit("derived").alias("status"))).otherwise(F.struct(F.lit(None).cast("long").alias("total"), F.lit("not_reported").alias("status")))
