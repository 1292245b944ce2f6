"""Scores of what was captured, labelled or predicted against what should have been."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import decomposed


def _ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    found = a / F.nullif(b, F.lit(0))
    return found if empty is None else F.coalesce(found, F.lit(empty))


def set_scores(gold: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """Keys of two sets that agree: found, missing and made up, with precision and recall (null where undefined). Repeated keys count once."""
    both = gold.select(*key).distinct().withColumn("_gold", F.lit(1)).join(got.select(*key).distinct().withColumn("_got", F.lit(1)), key, "full")
    n = both.agg(F.count_if(F.col("_gold").isNotNull() & F.col("_got").isNotNull()).alias("tp"), F.count_if(F.col("_got").isNull()).alias("fn"), F.count_if(F.col("_gold").isNull()).alias("fp"))
    return n.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def confusion(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    return rows.groupBy(expected.alias("expected"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def binary_metrics(rows: DataFrame, by: list[str], said: Column, true: Column) -> DataFrame:
    """Counts of a rule against the truth, with accuracy, precision, recall and F1, null where undefined."""
    n = rows.groupBy(*by).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns({"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def domain_weighted(rows: DataFrame, domain: str, **statistics: Column) -> DataFrame:
    """The mean over domains of each domain's statistic, so that a large one doesn't decide; domains where it is undefined don't count."""
    by = rows.groupBy(domain).agg(*(c.alias(n) for n, c in statistics.items()))
    return by.agg(F.count("*").alias("domains"), *(F.avg(n).alias(n) for n in statistics))


def cell_key(text: Column) -> Column:
    """A cell's text as it is compared: compatibility forms, without soft hyphens, wrapped words and spaces as one."""
    plain = F.replace(decomposed(F.coalesce(text, F.lit(""))), F.lit("­"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "-\\s*\\n\\s*", "-"), r"\s+", " "))


GEOMETRY = ["table_id", "head", "r", "c"]


def capture_score(gold: DataFrame, got: DataFrame) -> DataFrame:
    """One row of rates and counts of captured cells (table_id, head, r, c, text) against annotated ones (and kind: value, or why the place is blank).

    Tables that aren't annotated are out of scope; in those that are, text at a place that isn't annotated, or that should be blank, is made up.
    """
    scope = got.join(gold.select("table_id").distinct(), "table_id", "left_semi")
    cells = gold.alias("g").join(scope.alias("a"), GEOMETRY, "full").select(*GEOMETRY, F.col("g.kind").alias("kind"), F.col("g.text").alias("want"), F.coalesce("a.text", F.lit("")).alias("text"))
    want, text, kind = F.col("want"), F.col("text"), F.col("kind")
    same, value, some = cell_key(text) == cell_key(want), kind == "value", text != ""
    counts = {
        "cells": F.count("kind"), "value_cells": F.count_if(value), "exact": F.count_if(kind.isNotNull() & (text == want)), "normalized": F.count_if(kind.isNotNull() & same), "captured": F.count_if(some), "true_positive": F.count_if(some & value & same),
        "missing_value": F.count_if(value & ~some), "value_mismatch": F.count_if(value & some & ~same), "hallucinated": F.count_if(some & (kind.isNull() | ~value)), "extra_geometry": F.count_if(some & kind.isNull()),
    }
    n = cells.agg(*(c.alias(k) for k, c in counts.items()))
    rows = gold.groupBy("table_id", "head", "r").agg(F.lit(1).alias("w")).join(scope.select("table_id", "head", "r").distinct().withColumn("a", F.lit(1)), ["table_id", "head", "r"], "left")
    held = rows.groupBy("table_id").agg(F.count("*").alias("rows"), F.count("a").alias("found")).agg(F.count("*").alias("tables"), F.count_if(F.col("found") > 0).alias("found_tables"), F.sum("rows").alias("rows"), F.sum("found").alias("found_rows"))
    out = n.join(F.broadcast(held))
    rate = lambda a, b: _ratio(F.col(a), F.col(b), 1.0)
    return out.withColumns({"table_recall": rate("found_tables", "tables"), "row_recall": rate("found_rows", "rows"), "exact_accuracy": rate("exact", "cells"), "normalized_accuracy": rate("normalized", "cells"), "cell_precision": rate("true_positive", "captured"), "cell_recall": rate("true_positive", "value_cells")})


def gold_pairs(gold: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """Both sides by key: value and got_value with status found, wrong, missing or extra. Of rows of one key the last in order (pos, then value) counts; how many there were is kept as `n_gold` and `n_got`."""
    last = lambda rows, v, n: rows.groupBy(*key).agg(F.max(F.struct("pos", "value"))["value"].alias(v), F.count("*").alias(n))
    both = last(gold, "value", "n_gold").join(last(got, "got_value", "n_got"), key, "full")
    status = F.when(F.col("n_got").isNull(), "missing").when(F.col("n_gold").isNull(), "extra").when(F.col("value").eqNullSafe(F.col("got_value")), "found").otherwise("wrong")
    return both.select(*key, "value", "got_value", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("n_got", F.lit(0)).alias("n_got"), status.alias("status"))


def by_members(readings: DataFrame, gold: DataFrame, reading: str, batch: str, member: str) -> DataFrame:
    """Readings and annotated batches that are about the same set of claims; a set that several batches have is ambiguous and meets none. Sets are as large as a batch."""
    sets = lambda rows, k: rows.groupBy(k).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), "|").alias("members"))
    known = sets(gold, batch).groupBy("members").agg(F.count("*").alias("n"), F.min(batch).alias(batch))
    met = sets(readings, reading).join(known, "members", "left")
    return met.select(reading, F.when(F.col("n") == 1, F.col(batch)).alias(batch), F.when(F.col("n").isNull(), "no key").when(F.col("n") > 1, "ambiguous key").otherwise("met").alias("status"))


def benchmark_diagnostics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of scored rows (mode, expected, predicted, known, review_required): rows of each mode, differences that were known and that weren't, wrong ones released without a review, and a status."""
    differ = ~F.col("predicted").eqNullSafe(F.col("expected"))
    n = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col("mode") == "structured").alias("structured"), F.count_if(differ & F.col("known")).alias("known"), F.count_if(differ & ~F.col("known")).alias("unexpected"), F.count_if(differ & ~F.col("review_required")).alias("released"))
    return n.withColumn("status", F.when(F.col("released") > 0, "silent_release").when(F.col("unexpected") > 0, "drift").otherwise("as_expected"))


def weakest_sum(reports: DataFrame, metric: str, denominator: str) -> DataFrame:
    """A metric over reports: its sum, how many state it (the sum counts only where all do), and the smallest denominator among them."""
    n = reports.agg(F.count("*").alias("reports"), F.count(metric).alias("stating"), F.sum(metric).alias("total"), F.min(F.coalesce(F.col(denominator), F.lit(0))).alias("weakest"))
    return n.withColumn("usable", F.when(F.col("stating") == F.col("reports"), F.col("total")))
