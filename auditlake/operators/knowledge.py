"""Knowledge of concepts: what a name means, merging of sources, promotion, and which entries are like a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.units import normal_unit

#: Queries that one scan of the entries serves, and scores that a task holds at once.
BLOCK, SCORES = 4096, 1 << 20


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def resolve_names(asked: DataFrame, names: DataFrame, rules: DataFrame) -> DataFrame:
    """asked (id, name, unit, modality) with field_type and how it was found: only, modality, unit, ambiguous or unknown.

    names: field_type, name, default_unit, a row for each name of a concept. rules: field_type, pos, signal, target: where the modality holds a signal, the target is meant. Of several concepts of a name the first rule that applies to one of them and leads to one of them decides, then the only one with the unit.
    """
    known = names.select("field_type", name_key(F.col("name")).alias("key"), normal_unit(F.col("default_unit")).alias("unit_of")).where("key <> ''").distinct()
    q = asked.withColumns({"key": name_key(F.col("name")), "u": normal_unit(F.col("unit")), "m": F.lower(F.trim(F.coalesce("modality", F.lit(""))))})
    met = q.join(known, "key")
    counted = met.groupBy("id").agg(
        F.count_distinct("field_type").alias("n"), F.min("field_type").alias("only"), F.collect_set("field_type").alias("among"), F.count_distinct(F.when((F.col("u") != "") & (F.col("unit_of") == F.col("u")), F.col("field_type"))).alias("n_unit"),
        F.min(F.when(F.col("unit_of") == F.col("u"), F.col("field_type"))).alias("by_unit"),
    )
    ruled = met.where("m <> ''").join(rules, "field_type").where(F.contains("m", "signal")).join(counted.select("id", "among"), "id").where(F.array_contains("among", F.col("target")))
    first = ruled.groupBy("id").agg(F.min(F.struct("field_type", "pos", "target")).alias("rule"))
    out = q.join(counted, "id", "left").join(first, "id", "left")
    how = F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "only").when(F.col("rule").isNotNull(), "modality").when(F.col("n_unit") == 1, "unit").otherwise("ambiguous")
    found = F.when(how == "only", F.col("only")).when(how == "modality", F.col("rule.target")).when(how == "unit", F.col("by_unit"))
    return out.select("id", found.alias("field_type"), how.alias("how"))


def merge(seed: DataFrame, later: DataFrame, fields: list[str], key: str = "field_type") -> DataFrame:
    """Entries of both sources, each field as the later one states it, else as the seed does; synonyms of both, the seed's first; status and the fields on which both state something else."""
    both = seed.withColumn("_there", F.lit(True)).alias("a").join(later.withColumn("_there", F.lit(True)).alias("b"), key, "full")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    none = F.array().cast("array<string>")
    synonyms = F.array_distinct(F.concat(F.coalesce(a("synonyms"), none), F.coalesce(b("synonyms"), none)))
    conflicts = F.array_compact(F.array(*(F.when(a(c) != b(c), c) for c in fields)))
    new, old = a("_there").isNull(), b("_there").isNull()
    status = F.when(old, "provisional").otherwise("authoritative")
    return both.select(key, *(F.coalesce(b(c), a(c)).alias(c) for c in fields), synonyms.alias("synonyms"), status.alias("status"), F.when(new, "added").when(old, "kept").otherwise("merged").alias("change"), conflicts.alias("conflicts"))


def fingerprint(entries: DataFrame, key: str = "field_type") -> DataFrame:
    """One hash of all entries, whatever their order: hashes of rows are combined in shares, and the shares in order."""
    row = F.sha2(F.to_json(F.struct(*sorted(entries.columns))), 256)
    shares = entries.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2).alias("share"), F.struct(F.col(key).cast("string"), row).alias("r"))
    held = shares.groupBy("share").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r"))["col2"], ""), 256).alias("h"))
    return held.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("share", "h")))["h"], ""), 256).alias("fingerprint"), F.count("*").alias("shares"))


def agreed_runs(votes: DataFrame, key: list[str], run: str, least: int = 3) -> DataFrame:
    """Proposals with the number of runs that made them, each run once, and whether they are enough."""
    return votes.groupBy(*key).agg(F.count_distinct(run).alias("runs")).withColumn("promoted", F.col("runs") >= least)


def promote(entries: DataFrame, agreed: DataFrame, key: str = "field_type") -> DataFrame:
    """Provisional entries that enough runs agree on are authoritative from now on, with a note of it behind their citation."""
    runs = agreed.where("promoted").groupBy(key).agg(F.max("runs").alias("_runs"))
    held = entries.join(runs, key, "left")
    up = (F.col("status") == "provisional") & F.col("_runs").isNotNull()
    note = F.concat(F.lit("promoted (repeated agreement (x"), F.col("_runs").cast("string"), F.lit("))"))
    return held.withColumns({"status": F.when(up, "authoritative").otherwise(F.col("status")), "citation": F.when(up, F.btrim(F.concat_ws(" | ", "citation", note), F.lit(" |"))).otherwise(F.col("citation"))}).drop("_runs")


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is missing, empty or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def most_similar(queries: DataFrame, entries: DataFrame, k: int = 8) -> DataFrame:
    """The k entries (id, vector) with the largest cosine for each query (query, vector), ties to the smaller id.

    Queries are stated ones: they go to the tasks in blocks of BLOCK, for each of which the entries are read once; a task keeps k entries of each query, so that little is shuffled. Vectors of another length than the query's are as unlike as zero ones."""
    asked = queries.where("query is not null and vector is not null").select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-asked.count() // BLOCK))
    answer = "query long, id long, score double"
    parts = []
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).collect()
        if rows:
            parts.append(entries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_best_of([r.query for r in rows], [r.vector for r in rows], k), answer))
    if not parts:
        return entries.sparkSession.createDataFrame([], answer + ", rank int")
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of(ids: list[int], vectors: list[list[float]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        sizes = sorted({len(v) for v in vectors})
        asked = {n: ([q for q, v in zip(ids, vectors) if len(v) == n], unit(np.array([v for v in vectors if len(v) == n]).reshape(-1, n))) for n in sizes}
        for batch in batches:
            held, entry = batch.column("vector").to_pylist(), batch.column("id").to_numpy()
            order = np.argsort(entry, kind="stable")
            for n, (names, q) in asked.items():
                x = unit(np.array([v if v is not None and len(v) == n and None not in v else [0.0] * n for v in held], np.float64).reshape(-1, n))[order]
                some = max(1, SCORES // max(1, len(x)))
                for at in range(0, len(names), some):
                    score = np.nan_to_num(q[at : at + some] @ x.T)
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + some], best.shape[1])), pa.array(entry[order][best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], ["query", "id", "score"])

    return run
