"""Gates: intervals by resampling, floors and bars, transitions against a baseline, and conditions read from a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.sources.tables import settled


#: Clusters that are told to all tasks, and of them those whose picks are worked out at once.
TOLD, SLOTS = 1 << 20, 1024
#: What counters are spread by, and the factors of their mixing.
SPREAD, MIXING = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def mixed(z: np.ndarray) -> np.ndarray:
    for shift, factor in MIXING:
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def picks(seed: int, draws: int, domain: int, slots: np.ndarray, k: int) -> np.ndarray:
    """Which of k clusters each slot of a domain takes in each draw (slots x draws): a generator without state, so that a pick depends on its counters alone, wherever it is made."""
    step = np.uint64(SPREAD)
    z = np.full(1, seed, np.uint64)
    for count in (np.arange(draws, dtype=np.uint64)[None, :], np.uint64(domain), slots.astype(np.uint64)[:, None]):
        z = mixed(z + step * (count + np.uint64(1)))
    return (z % np.uint64(k)).astype(np.int64)


def numbered_clusters(rows: DataFrame) -> DataFrame:
    """rows (domain, cluster, good, n) with at, their place by domain and cluster over all, from 0: counted within sorted stretches, so that no task gets all rows of a domain."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.repartitionByRange(parts, F.col("domain").asc_nulls_first(), F.col("cluster").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    before = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(before):
        starts[part], at = at, at + before[part]
    first = F.get(F.lit([starts.get(p, 0) for p in range(max(starts, default=0) + 1)]), F.col("part"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.col("domain").asc_nulls_first(), F.col("cluster").asc_nulls_first(), "good", "n"))
    return ranged.withColumn("at", (first + inner - 1).cast("long")).drop("part")


def bootstrap(clusters: DataFrame, domain: str | None, cluster: str, draws: int = 2000, tail: float = 0.025, least: float = 0.95, seed: int = 20_260_810) -> DataFrame:
    """One row: point, draws that are defined, lower, upper and note. clusters: a row for each (domain and) cluster with `good` and `n`.

    Within each domain as many clusters are drawn, with replacement, as it has; the statistic is the mean over domains of sum(good) / sum(n), without those that have no n. Ends are picked by index from the sorted draws. Where no domain has two clusters, or fewer than `least` of the draws are defined, a note says so instead of an interval. Null domains and clusters are ones of their own.

    A task works out all draws for some slots and gives one row of sums for each draw and domain. The clusters' numbers are told to all tasks where they are counted to be at most TOLD; beyond that, picks are rows and joined to their clusters.
    """
    spark = clusters.sparkSession
    named = (F.col(domain) if domain else F.lit(0)).alias("domain")
    rows = clusters.select(named, F.col(cluster).alias("cluster"), F.col("good").cast("long").alias("good"), F.col("n").cast("long").alias("n"))
    sizes = [r.k for r in rows.groupBy("domain").agg(F.count("*").alias("k")).orderBy(F.col("domain").asc_nulls_first()).collect()]
    held = numbered_clusters(rows)
    total = sum(sizes)
    slots = spark.range(0, total, SLOTS, max(1, min(total // SLOTS, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))).select("id")
    starts = np.cumsum([0, *sizes])

    def parts(lo: int, hi: int):
        """Domains of a stretch of all slots, with the slots' numbers in them."""
        for d in range(int(np.searchsorted(starts, lo, "right")) - 1, len(sizes)):
            a, b = max(lo, int(starts[d])), min(hi, int(starts[d + 1]))
            if a >= hi:
                break
            yield d, np.arange(a, b) - starts[d]

    if total <= TOLD:
        told = held.orderBy("at").select("good", "n").toArrow()
        good, n = (told.column(c).fill_null(0).to_numpy() for c in ("good", "n"))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in batch.column("id").to_pylist():
                    for d, some in parts(lo, min(lo + SLOTS, total)):
                        at = picks(seed, draws, d, some, sizes[d]) + starts[d]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(np.full(draws, d)), pa.array(good[at].sum(axis=0)), pa.array(n[at].sum(axis=0))], ["draw", "d", "good", "n"])

        drawn = slots.mapInArrow(summed, "draw long, d long, good long, n long")
    else:

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in batch.column("id").to_pylist():
                    for d, some in parts(lo, min(lo + SLOTS, total)):
                        at = picks(seed, draws, d, some, sizes[d]) + starts[d]
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(draws), len(some))), pa.array(np.full(at.size, d)), pa.array(at.ravel())], ["draw", "d", "at"])

        drawn = slots.mapInArrow(every, "draw long, d long, at long").join(held.select("at", "good", "n"), "at")
    rate = F.sum("good") / F.nullif(F.sum("n"), F.lit(0))
    point = rows.groupBy("domain").agg(rate.alias("rate")).agg(F.avg("rate").alias("point"))
    stat = drawn.groupBy("draw", "d").agg(rate.alias("rate")).groupBy("draw").agg(F.round(F.avg("rate"), 9).alias("stat")).agg(F.array_sort(F.collect_list("stat")).alias("all"))
    size = F.size("all")
    low, high = F.greatest(F.lit(0), (size * tail).cast("int") - 1), F.least(size - 1, (size * (1 - tail)).cast("int"))
    note = F.when(F.lit(max(sizes, default=0) < 2), "no domain has two clusters").when(size < max(1, least * draws), "too many undefined draws")
    pick = lambda i: F.when(note.isNull(), F.round(F.get("all", i), 6))
    return stat.crossJoin(F.broadcast(point)).select(F.round("point", 6).alias("point"), size.cast("long").alias("draws"), pick(low).alias("lower"), pick(high).alias("upper"), note.alias("note"))


def gate_checks(found: DataFrame, gate: DataFrame) -> DataFrame:
    """A row for each check of a gate (name, kind: hard, floor or bar, required) with what was found (name, value, denominator, lower, note) and its state. What is missing or rests on nothing is not passed."""
    both = gate.join(found, "name", "left")
    hard = F.when(F.col("value").isNull() | (F.coalesce("denominator", F.lit(1)) <= 0), "missing").when(F.col("value") != F.col("required"), "failed").otherwise("passed")
    floor = F.when(F.coalesce("value", F.lit(0.0)) < F.col("required"), "unmet").otherwise("passed")
    bar = F.when(F.col("note").isNotNull() | F.col("lower").isNull(), "not_estimable").when(F.col("lower") < F.col("required"), "failed").otherwise("passed")
    return both.withColumn("state", F.when(F.col("kind") == "hard", hard).when(F.col("kind") == "floor", floor).otherwise(bar))


def gate_verdict(checks: DataFrame, by: list[str]) -> DataFrame:
    """A hard check that failed decides first, then one that is missing or can't be estimated, then a bar."""
    has = lambda kind, *states: F.bool_or((F.col("kind") == kind) & F.col("state").isin(*states))
    told = checks.groupBy(*by).agg(has("hard", "failed").alias("a"), has("hard", "missing").alias("b"), has("floor", "unmet").alias("c"), has("bar", "not_estimable").alias("d"), has("bar", "failed").alias("e"))
    return told.select(*by, F.when(F.col("a"), "FAIL").when(F.col("b") | F.col("c") | F.col("d"), "NOT_ESTIMABLE").when(F.col("e"), "FAIL").otherwise("PASS").alias("status"))


def transitions(run: DataFrame, baseline: DataFrame, rules: DataFrame, key: str = "audit_id") -> DataFrame:
    """One row of counts and a verdict for a run (key, state) against a baseline (key, state) under rules (move, allowed): not_evaluable where a row isn't in the baseline or a move isn't among the rules, fail where one is forbidden, else pass."""
    both = run.alias("r").join(baseline.alias("b"), key, "left").select(key, F.col("b.state").alias("before"), F.col("r.state").alias("after"))
    moved = both.withColumn("move", F.concat_ws(" -> ", "before", "after")).join(F.broadcast(rules), "move", "left")
    n = moved.agg(
        F.count("*").alias("rows"), F.count_if(F.col("before").isNull()).alias("unknown"), F.count_if(F.col("before").isNotNull() & F.col("allowed").isNull()).alias("unexpressed"), F.count_if(~F.col("allowed")).alias("forbidden"),
        *(F.count_if(F.col("after") == s).alias(s) for s in ("correct", "refused", "wrong_but_flagged", "wrong_released")),
    )
    return n.withColumn("verdict", F.when((F.col("unknown") > 0) | (F.col("unexpressed") > 0), "not_evaluable").when(F.col("forbidden") > 0, "fail").otherwise("pass"))


def dangling(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows (audit_id, execution_id) that name an execution which isn't there, or which doesn't name them. batches: execution_id, claim_ids."""
    there = batches.select("execution_id").distinct()
    lost = rows.where("execution_id is not null").join(there, "execution_id", "left_anti").select("audit_id", F.lit("no such execution").alias("why"))
    named = batches.select("execution_id", F.explode("claim_ids").alias("audit_id")).distinct()
    unnamed = rows.join(there, "execution_id", "left_semi").join(named, ["execution_id", "audit_id"], "left_anti").select("audit_id", F.lit("not named back").alias("why"))
    return lost.unionByName(unnamed)


def plan_difference(made: DataFrame, planned: DataFrame) -> DataFrame:
    """Batches (claim_ids) that were planned and not made, and the other way round."""
    sets = lambda rows, there: rows.select(F.array_join(F.array_sort("claim_ids"), "|").alias("members"), F.lit(there).alias("there"))
    # both ways in one count, as a set counts once however often it is there
    met = sets(made, 1).unionByName(sets(planned, 2)).groupBy("members").agg(F.min("there").alias("a"), F.max("there").alias("b")).where("a = b")
    return met.select("members", F.when(F.col("a") == 1, "not planned").otherwise("not made").alias("why"))


def projected_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows that differ between an old artifact and a new one, on the columns of the old; a key that only one has is lost or added."""
    columns = [c for c in old.columns if c != key]
    there = [c for c in columns if c in new.columns]
    a, b = old.select(key, F.struct(*there).alias("a")), new.select(key, F.struct(*there).alias("b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    fields = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in there)))
    return both.select(key, change.alias("change"), F.when(change == "changed", F.array_join(fields, ",")).alias("fields")).where("change is not null")


def added_columns(old: DataFrame, new: DataFrame) -> list[str]:
    return [c for c in new.columns if c not in old.columns]


def unlisted(rows: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Values of a benchmark's columns that its contract doesn't allow, with how many rows have them."""
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c), F.lit("")).isin(values), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, values in allowed.items())))
    return rows.select(F.explode(bad).alias("b")).groupBy("b.column", "b.value").agg(F.count("*").alias("n"))


def latest_choice(events: DataFrame, item: list[str], order: str, action: str) -> DataFrame:
    """What the last choice on each item was: an undo takes back the one before it, another undo the one before that."""
    turned = events.withColumn("_s", F.when(F.col(action) == "undo", -1).otherwise(1))
    back = Window.partitionBy(*item).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # read backwards, a choice stands if no undo behind it is left over
    depth = turned.withColumn("_sum", F.sum("_s").over(back))
    return depth.where("_sum = 1 and _s = 1").groupBy(*item).agg(F.max_by(action, order).alias("choice"))


def within(values: Column, low: Column, high: Column) -> Column:
    return values.between(low, high)
