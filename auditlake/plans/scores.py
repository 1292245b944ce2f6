"""Queries over scores, batches, readings and gates. Inputs are made from the tables by integer arithmetic, so that both engines make the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import clean_pdf, folded, kept_doi, normal_pmid, printed_pmid
from auditlake.operators import batches, compare, gates, judgement, scoring
from auditlake.sources.tables import spread, table


def _pick(i: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))


def capture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of lines as they should be, and as they were captured: some differ in spaces, some in what they say, some are missing, blank ones filled, and some lie outside."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    text = F.concat(F.lit("part "), F.col("p").cast("string"))
    gold = lines.where(k % 50 != 0).select(k.alias("table_id"), F.lit(False).alias("head"), n.cast("int").alias("r"), F.lit(0).alias("c"), F.when(n % 4 == 0, "").otherwise(text).alias("text"), F.when(n % 4 == 0, "blank").otherwise("value").alias("kind"))
    seen = F.when(F.col("p") % 5 == 0, F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")))).when(F.col("p") % 7 == 0, "else").when((n % 4 == 0) & (F.col("p") % 3 > 0), "").when(F.col("p") % 11 == 0, "").otherwise(text)
    got = lines.where(k % 9 != 0).select(k.alias("table_id"), F.lit(False).alias("head"), n.cast("int").alias("r"), F.when(F.col("p") % 13 == 0, 1).otherwise(0).alias("c"), seen.alias("text"))
    out = scoring.capture_score(gold, got)
    return out.select(*(c for c in out.columns if c.endswith(("recall", "accuracy", "precision")) is False), *(F.round(c, 6).alias(c) for c in out.columns if c.endswith(("recall", "accuracy", "precision"))))


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by part and supplier on two sides, the last of a key counting."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").cast("long").alias("value"))
    got = rows.where("l_suppkey % 3 <> 0").withColumn("value", F.when(F.col("pos") % 4 == 0, F.col("value") + 1).otherwise(F.col("value")))
    pairs = scoring.gold_pairs(rows.where("l_partkey % 4 <> 0"), got, ["l_partkey", "l_suppkey"])
    return pairs.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_gold").alias("n_gold"), F.sum("n_got").alias("n_got"), F.sum("value").alias("value"), F.sum("got_value").alias("got_value"))


def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of orders and annotated ones that are about the same parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).alias("part"))
    return scoring.by_members(lines.where("l_orderkey % 2 = 0").withColumnRenamed("l_orderkey", "reading"), lines.where("l_orderkey % 40 = 1").withColumnRenamed("l_orderkey", "batch"), "reading", "batch", "part").groupBy("status").agg(F.count("*").alias("n"), F.sum("batch").alias("batches"))


def benchmark_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 12).alias("benchmark"), F.when(k % 3 == 0, "structured").otherwise("numeric").alias("mode"), F.lit("match").alias("expected"), F.when(k % 5 == 0, "mismatch").otherwise("match").alias("predicted"), (k % 12 < 8).alias("known"), (k % 12 != 4).alias("review_required"))
    return scoring.benchmark_diagnostics(rows, ["benchmark"])


def evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all reports state is summed; what one of them leaves out isn't usable."""
    reports = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") != 3, F.col("s_suppkey")).alias("m"), (F.col("s_suppkey") + 5).alias("d"))
    return scoring.weakest_sum(reports, "m", "d").withColumn("whole", F.lit(False)).unionByName(scoring.weakest_sum(reports.where("m is not null"), "m", "d").withColumn("whole", F.lit(True)))


def claim_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a paper's field in batches, with their shape and kind."""
    k = F.col("l_orderkey")
    group = _pick(F.col("l_partkey"), "all", "red", "red vs blue", " - ")
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("study"), (k * 10 + F.col("l_linenumber")).alias("pos"), batches.target_shape(group).alias("shape"), batches.claim_kind(_pick(F.col("l_partkey"), " Red ", "5"), F.lit("red")).alias("kind"))
    held = batches.group_claims(claims, ["study", "shape", "kind"], "pos", "pos")
    return held.select("study", "shape", "kind", "claims", "first", F.get("members", F.col("claims").cast("int") - 1).alias("last"))


def retry_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts at a user's readings, each but the last asked again for a reason."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", k, F.when(k % 7 == 0, "timeout").otherwise(" ").alias("error"), F.when(k % 11 == 0, "Extraction call FAILED").alias("not_found_reason"), (k % 13 == 0).alias("permanent"), (k % 2 == 0).alias("found"), F.when(k % 5 == 0, False).alias("agreement"), F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 0.9).alias("confidence"))
    return batches.retries(rows, "user_id", "event_id")


def reading_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer is told of readings, and whether they are accepted, read again or handed on."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(_pick(k, "ok", "none", "batch_failed", "none", "derived").alias("status"), (k % 7 == 0).alias("broke"), (k % 3).alias("entries"), F.when(k % 4 == 0, 1).otherwise(0).alias("rejected"), (k % 2 == 0).alias("usable"), (k % 9 > 3).alias("silent"), F.when(k % 3 > 0, (k % 10) / 10.0).alias("confidence"), F.when(k % 8 == 0, False).alias("agreement"), (k % 2).cast("int").alias("attempt"), (k % 6 != 0).alias("retrieved"))
    told = batches.reading_outcome(F.col("status"), F.col("broke"), F.col("entries"), F.col("rejected"), F.col("usable"), F.col("silent"))
    return rows.groupBy(told.alias("outcome"), batches.reflection(F.col("retrieved"), F.col("agreement"), F.col("confidence"), F.col("attempt")).alias("decision")).agg(F.count("*").alias("n"))


def field_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions of cells as one record for each name."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("key"), _pick(k % 9, "resolved", "resolved", "unresolved").alias("status"), F.when(k % 9 % 3 < 2, _pick(F.col("p_size"), "age", "sex")).alias("field_type"), (k % 4).alias("cache_hits"), F.array(F.col("p_brand")).alias("candidates"), F.create_map(F.lit("unit"), k % 5 > 0, F.lit("range"), k % 50 > 0).alias("checks"))
    out = batches.merged_resolutions(rows, "key")
    return out.select("key", "cells", "cache_hits", "status", "field_type", F.size("candidates").cast("long").alias("candidates"), F.array_join("failed_checks", ",").alias("failed_checks"))


def failure_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", F.concat(F.lit("failed at "), F.col("event_id").cast("string")).alias("message"))
    return batches.first_failures(events, ["user_id"], "event_id", "message")


def gate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of each nation over customers' counts: hard conditions, floors and bars."""
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey") % 20 == 0).alias("bad"), F.count_if(F.col("c_custkey") % 3 > 0).alias("good"))
    name = lambda kind: F.concat(F.lit(f"{kind}-"), F.col("c_nationkey").cast("string"))
    none = F.lit(None)
    one = lambda kind, value, denominator, lower, note: by.select(name(kind).alias("name"), value.cast("double").alias("value"), denominator.cast("long").alias("denominator"), lower.cast("double").alias("lower"), note.cast("string").alias("note"))
    found = one("hard", F.col("bad"), F.when(F.col("c_nationkey") % 11 > 0, F.col("n")).otherwise(0), none, none).unionByName(one("floor", F.col("n"), none, none, none)).unionByName(one("bar", none, none, F.col("good") / F.col("n") - 0.3, F.when(F.col("c_nationkey") % 7 == 0, "few draws")))
    nations = table(spark, sf_dir, "nation")
    gate = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.explode(F.array(F.struct(F.lit("hard").alias("kind"), F.lit(0.0).alias("required")), F.struct(F.lit("floor").alias("kind"), F.lit(3.0).alias("required")), F.struct(F.lit("bar").alias("kind"), F.lit(0.3).alias("required")))).alias("g"))
    gate = gate.select("c_nationkey", "g.kind", "g.required", F.concat("g.kind", F.lit("-"), F.col("c_nationkey").cast("string")).alias("name"))
    return gates.gate_verdict(gates.gate_checks(found, gate), ["c_nationkey"])


def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How orders' rows moved against a baseline, under rules that forbid some moves."""
    k = F.col("o_orderkey")
    state = lambda i: _pick(i, "correct", "refused", "wrong_but_flagged")
    orders = table(spark, sf_dir, "orders")
    run = orders.select(k.alias("audit_id"), state(k % 5).alias("state"))
    rules = spark.createDataFrame([(f"{a} -> {b}", not (a == "correct" and b == "refused")) for a in ("correct", "refused", "wrong_but_flagged") for b in ("correct", "refused", "wrong_but_flagged")], "move string, allowed boolean")
    return gates.transitions(run, orders.select(k.alias("audit_id"), state(k % 7).alias("state")), rules)


def execution_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name a reading which isn't there or doesn't name them, and batches that were not planned or not made."""
    k, s = F.col("l_orderkey"), F.col("l_linenumber")
    # all that follows is by the order, so that one exchange serves it and no task counts what a large part of a file holds
    lines = spread(table(spark, sf_dir, "lineitem").select(k, s), "l_orderkey").distinct()
    rows = lines.select((k * 10 + s).alias("audit_id"), F.when(s != 5, k).alias("execution_id"))
    made = lines.where((k % 9 != 0) & (s != 3)).groupBy(k.alias("execution_id")).agg(F.collect_set((k * 10 + s).cast("string")).alias("claim_ids"))
    planned = lines.where((k % 10 != 0) & (s != 3)).groupBy(k.alias("execution_id")).agg(F.collect_set((k * 10 + s).cast("string")).alias("claim_ids"))
    bad = gates.dangling(rows.select(F.col("audit_id").cast("string"), "execution_id"), made).groupBy("why").agg(F.count("*").alias("n"))
    return bad.unionByName(gates.plan_difference(made, planned).groupBy("why").agg(F.count("*").alias("n")))


def artifact_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an old artifact had them and a new one has them, on the columns of the old."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    k = F.col("c_custkey")
    new = rows.where(k % 10 != 0).select(k, F.when(k % 4 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 6 == 0, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal", F.lit(1).alias("more"))
    return gates.projected_difference(rows.where(k % 11 != 0), new, "c_custkey")


def contract_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return gates.unlisted(orders, {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]})


def standing_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user last chose of each kind, undone choices left out."""
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select("user_id", k, F.when(k % 3 == 0, "undo").otherwise(F.col("event_type")).alias("action"))
    return gates.latest_choice(events, ["user_id"], "event_id", "action")


def printed_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs and PMIDs that citations print, names without accents, and text of a PDF's layer."""
    k = F.col("page_id")
    n = k.cast("string")
    cite = F.concat(F.lit("Ünal Ç. See doi:10.5072/a"), n, F.when(k % 3 == 0, ". Also 10.5072/b;").otherwise("."), F.lit(" PMID: "), (k + 10_000).cast("string"))
    pages = table(spark, sf_dir, "pages").select(k, cite.alias("t"))
    offered = F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.5072/A"), n)).when(k % 4 == 1, "10.5072/zz")
    raw = F.when(k % 2 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (k + 9990).cast("string"))).otherwise("12a")
    return pages.select(k, kept_doi(offered, F.col("t"), F.lit("")).alias("doi"), printed_pmid(F.col("t")).alias("pmid"), normal_pmid(raw).alias("raw_pmid"), folded(F.substring("t", 1, 6)).alias("name"), clean_pdf(F.concat(F.lit("5\x01"), n, F.lit(" mm\x02"))).alias("clean"))


def scoped_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values compared under bands of their own, populations that may not go together, and intervals filled in from parts."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select((k % 8).alias("kind"), (k % 5).alias("scope"), _pick(k, "age", "size").alias("field_type")).distinct()
    kind = F.col("kind")
    rows = rows.withColumns({"a": F.when(kind < 4, "100").otherwise("0.5 (95% CI 0.3 to 0.8)"), "b": _pick(kind, "100", "101.5", "104", "NR", "0.5", "0.5", "0.5 (95% CI 0.3 to 0.8)", "0.5"), "scope_check": _pick(F.col("scope"), "ok", "mismatch", "unresolved", "resolved", "not_required")})
    none = F.lit(None).cast("double")
    parts = F.struct(F.when(kind == 5, "incomplete").when(kind == 7, "protocol_error").otherwise("ok").alias("status"), F.when(kind.isin(4, 7), 95.0).otherwise(none).alias("level"), F.when(kind.isin(4, 7), 0.3).otherwise(none).alias("lower"), F.when(kind.isin(4, 7), 0.8).otherwise(none).alias("upper"), F.when(kind == 5, F.array(F.lit("lower"), F.lit("upper"))).otherwise(F.array().cast("array<string>")).alias("missing"))
    bands = spark.createDataFrame([("age", 0.02), ("*", 0.01)], "field_type string, rel double")
    held = compare.with_tolerances(rows.withColumn("parts", parts), bands)
    out = compare.compare_values(held, "a", "b", None, None, mean=F.col("rel"), scope="scope_check", components="parts")
    return out.select("kind", "scope", "field_type", "label", "mode", "review_required")


def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of claims by what they are about, with how many cells and studies they concern."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 30).alias("key"), F.col("o_custkey").alias("study_id"), _pick(k, "match", "mismatch", "not_comparable", None).alias("label"), _pick(k, "paired", "paired", "paired", "no_source_evidence", "ambiguous_match_key").alias("reason"), _pick(k, None, "unknown_cohort", "source_access_failed").alias("outcome"), (k % 8 == 0).alias("review_required"))
    flagged = rows.withColumn("flag", judgement.flag_of(F.col("label"), F.col("reason"), F.col("outcome"), F.col("review_required"))).where("flag is not null")
    return judgement.grouped_flags(flagged, ["key", "flag"])


QUERIES = {
    f.__name__: f
    for f in (capture_scores, gold_pairs, batch_keys, benchmark_state, evidence_metrics, claim_batches, retry_reasons, reading_outcomes, field_resolutions, failure_notes, gate_state, run_transitions, execution_checks, artifact_difference, contract_breaches, standing_choices, printed_identifiers, scoped_compare, flag_summary)
}

CAPTURE_SQL = """WITH l AS (SELECT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
g AS (SELECT k, n, 0 AS c, CASE WHEN n % 4 = 0 THEN '' ELSE concat('part ', p) END AS want, n % 4 <> 0 AS value FROM l WHERE k % 50 <> 0),
a AS (SELECT k, n, CASE WHEN p % 13 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN p % 5 = 0 THEN concat(' part  ', p) WHEN p % 7 = 0 THEN 'else' WHEN n % 4 = 0 AND p % 3 > 0 THEN '' WHEN p % 11 = 0 THEN '' ELSE concat('part ', p) END AS text FROM l WHERE k % 9 <> 0 AND k % 50 <> 0),
b AS (SELECT g.k IS NOT NULL AS gold, coalesce(value, false) AS value, want, coalesce(text, '') AS text, trim(replace(coalesce(text, ''), '  ', ' ')) = want AS same FROM g FULL JOIN a USING (k, n, c)),
n AS (SELECT count(*) FILTER (gold) AS cells, count(*) FILTER (value) AS value_cells, count(*) FILTER (gold AND text = want) AS exact, count(*) FILTER (gold AND same) AS normalized, count(*) FILTER (text <> '') AS captured, count(*) FILTER (text <> '' AND value AND same) AS true_positive, count(*) FILTER (value AND text = '') AS missing_value,
  count(*) FILTER (value AND text <> '' AND NOT same) AS value_mismatch, count(*) FILTER (text <> '' AND NOT value) AS hallucinated, count(*) FILTER (text <> '' AND NOT gold) AS extra_geometry FROM b),
r AS (SELECT count(DISTINCT g.k) AS tables, count(DISTINCT g.k) FILTER (g.k % 9 <> 0) AS found_tables, count(*) AS rows_, count(*) FILTER (g.k % 9 <> 0) AS found_rows FROM g)
SELECT n.*, tables, found_tables, rows_ AS "rows", found_rows, round(found_tables / tables, 6) AS table_recall, round(found_rows / rows_, 6) AS row_recall, round(exact / cells, 6) AS exact_accuracy, round(normalized / cells, 6) AS normalized_accuracy, round(true_positive / captured, 6) AS cell_precision, round(true_positive / value_cells, 6) AS cell_recall FROM n, r"""


def _among(i: str, *values: str | None) -> str:
    return f"CASE {i} % {len(values)} " + " ".join(f"WHEN {n} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for n, v in enumerate(values)) + " END"


ORACLE_SQL = {
    "capture_scores": CAPTURE_SQL,
    "gold_pairs": """WITH l AS (SELECT l_partkey AS p, l_suppkey AS s, l_orderkey * 10 + l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS v FROM lineitem), g AS (SELECT p, s, max(struct_pack(pos, v)).v AS v, count(*) AS n FROM l WHERE p % 4 <> 0 GROUP BY 1, 2), a AS (SELECT p, s, max(struct_pack(pos, w := v + CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END)).w AS w, count(*) AS m FROM l WHERE s % 3 <> 0 GROUP BY 1, 2)
        SELECT CASE WHEN m IS NULL THEN 'missing' WHEN n IS NULL THEN 'extra' WHEN v = w THEN 'found' ELSE 'wrong' END AS status, count(*) AS n, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_gold, CAST(sum(coalesce(m, 0)) AS BIGINT) AS n_got, CAST(sum(v) AS BIGINT) AS value, CAST(sum(w) AS BIGINT) AS got_value FROM g FULL JOIN a USING (p, s) GROUP BY 1""",
    "batch_keys": """WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey % 4)) AS m FROM lineitem GROUP BY 1), g AS (SELECT m, count(*) AS n, min(k) AS batch FROM s WHERE k % 40 = 1 GROUP BY m)
        SELECT CASE WHEN n IS NULL THEN 'no key' WHEN n > 1 THEN 'ambiguous key' ELSE 'met' END AS status, count(*) AS n, CAST(sum(CASE WHEN g.n = 1 THEN batch END) AS BIGINT) AS batches FROM (SELECT * FROM s WHERE k % 2 = 0) s LEFT JOIN g USING (m) GROUP BY 1""",
    "benchmark_state": """WITH r AS (SELECT o_orderkey % 12 AS benchmark, o_orderkey % 3 = 0 AS st, o_orderkey % 5 = 0 AS d, o_orderkey % 12 < 8 AS known, o_orderkey % 12 <> 4 AS rev FROM orders), n AS (SELECT benchmark, count(*) AS "rows", count(*) FILTER (st) AS structured, count(*) FILTER (d AND known) AS known, count(*) FILTER (d AND NOT known) AS unexpected, count(*) FILTER (d AND NOT rev) AS released FROM r GROUP BY 1)
        SELECT *, CASE WHEN released > 0 THEN 'silent_release' WHEN unexpected > 0 THEN 'drift' ELSE 'as_expected' END AS status FROM n""",
    "evidence_metrics": """WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey <> 3 THEN s_suppkey END AS m FROM supplier) SELECT count(*) AS reports, count(m) AS stating, CAST(sum(m) AS BIGINT) AS total, min(k + 5) AS weakest, CASE WHEN count(*) = count(m) THEN CAST(sum(m) AS BIGINT) END AS usable, false AS whole FROM r
        UNION ALL SELECT count(*), count(m), CAST(sum(m) AS BIGINT), min(k + 5), CAST(sum(m) AS BIGINT), true FROM r WHERE m IS NOT NULL""",
    "claim_batches": """SELECT l_suppkey AS study, CASE l_partkey % 4 WHEN 1 THEN 'arm' WHEN 2 THEN 'comparison' ELSE 'study' END AS shape, CASE WHEN l_partkey % 2 = 0 THEN 'arm_identity' ELSE 'value' END AS kind, count(*) AS claims, min(l_orderkey * 10 + l_linenumber) AS first, max(l_orderkey * 10 + l_linenumber) AS last FROM lineitem GROUP BY 1, 2, 3""",
    "retry_reasons": """WITH a AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events)
        SELECT CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 'call_failed' WHEN event_id % 5 = 0 THEN 'disagreement' WHEN event_id % 3 = 0 THEN 'low_confidence' WHEN event_id % 2 <> 0 THEN 'not_found' END AS reason, count(*) AS retries FROM a WHERE nxt IS NOT NULL GROUP BY 1""",
    "reading_outcomes": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 AS e, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS j, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 10) / 10.0 END AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'retry' ELSE 'escalate' END AS again FROM orders)
        SELECT CASE WHEN k % 5 IN (0, 4) THEN 'found' WHEN k % 5 = 2 OR k % 7 = 0 THEN 'extraction_failed' WHEN e + j > 0 AND k % 2 <> 0 THEN 'extraction_failed' WHEN e = 0 AND j = 0 AND k % 9 > 3 THEN 'missing_source' ELSE 'extraction_unresolved' END AS outcome,
          CASE WHEN k % 6 = 0 THEN again WHEN k % 8 = 0 THEN again WHEN c IS NULL OR c >= 0.7 THEN 'accept' WHEN c < 0.4 THEN 'escalate' ELSE again END AS decision, count(*) AS n FROM r GROUP BY 1, 2""",
    "field_resolutions": f"""WITH r AS (SELECT p_size AS key, {_among("(p_partkey % 9)", "resolved", "resolved", "unresolved")} AS status, CASE WHEN p_partkey % 9 % 3 < 2 THEN {_among("p_size", "age", "sex")} END AS f, p_partkey % 4 AS h, p_brand AS b, p_partkey % 5 > 0 AS u, p_partkey % 50 > 0 AS g FROM part),
        n AS (SELECT key, count(*) AS cells, CAST(sum(h) AS BIGINT) AS cache_hits, count(DISTINCT status) AS s, count(DISTINCT f) AS k, min(status) AS status, min(f) AS f, count(DISTINCT b) AS candidates, bool_and(u) AS u, bool_and(g) AS g FROM r GROUP BY key)
        SELECT key, cells, cache_hits, CASE WHEN s > 1 OR k > 1 THEN 'mixed' ELSE status END AS status, CASE WHEN k <= 1 THEN f END AS field_type, candidates, concat_ws(',', CASE WHEN NOT g THEN 'range' END, CASE WHEN NOT u THEN 'unit' END) AS failed_checks FROM n""",
    "failure_notes": "SELECT user_id, count(*) AS n, concat('failed at ', min(event_id)) AS first_message FROM events WHERE event_type = 'error' GROUP BY user_id",
    "gate_state": """WITH b AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (c_custkey % 20 = 0) AS bad, count(*) FILTER (c_custkey % 3 > 0) AS good FROM customer GROUP BY 1)
        SELECT n_nationkey AS c_nationkey, CASE WHEN b.k IS NOT NULL AND n_nationkey % 11 > 0 AND bad <> 0 THEN 'FAIL' WHEN b.k IS NULL OR n_nationkey % 11 = 0 THEN 'NOT_ESTIMABLE' WHEN n < 3 OR n_nationkey % 7 = 0 THEN 'NOT_ESTIMABLE' WHEN good::DOUBLE / n - 0.3::DOUBLE < 0.3::DOUBLE THEN 'FAIL' ELSE 'PASS' END AS status FROM nation LEFT JOIN b ON k = n_nationkey""",
    "run_transitions": f"""WITH m AS (SELECT {_among("(o_orderkey % 7)", "correct", "refused", "wrong_but_flagged")} AS a, {_among("(o_orderkey % 5)", "correct", "refused", "wrong_but_flagged")} AS b FROM orders)
        SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS unexpressed, count(*) FILTER (a = 'correct' AND b = 'refused') AS forbidden, count(*) FILTER (b = 'correct') AS correct, count(*) FILTER (b = 'refused') AS refused, count(*) FILTER (b = 'wrong_but_flagged') AS wrong_but_flagged, CAST(0 AS BIGINT) AS wrong_released, CASE WHEN count(*) FILTER (a = 'correct' AND b = 'refused') > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM m""",
    "execution_checks": """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS s FROM lineitem), m AS (SELECT DISTINCT k FROM l WHERE k % 9 <> 0 AND s <> 3), p AS (SELECT DISTINCT k FROM l WHERE k % 10 <> 0 AND s <> 3),
        r AS (SELECT 'no such execution' AS why, count(*) AS n FROM l WHERE s <> 5 AND k NOT IN (SELECT k FROM m) UNION ALL SELECT 'not named back', count(*) FROM l WHERE s = 3 AND k IN (SELECT k FROM m) UNION ALL SELECT 'not made', count(*) FROM p WHERE k NOT IN (SELECT k FROM m) UNION ALL SELECT 'not planned', count(*) FROM m WHERE k NOT IN (SELECT k FROM p))
        SELECT * FROM r WHERE n > 0""",
    "artifact_difference": """WITH r AS (SELECT c_custkey AS k, c_custkey % 11 <> 0 AS o, c_custkey % 10 <> 0 AS w, c_custkey % 4 = 0 AND upper(c_name) <> c_name AS a, c_custkey % 6 = 0 AS b FROM customer)
        SELECT k AS c_custkey, CASE WHEN NOT w THEN 'lost' WHEN NOT o THEN 'added' ELSE 'changed' END AS change, CASE WHEN o AND w THEN concat_ws(',', CASE WHEN a THEN 'c_name' END, CASE WHEN b THEN 'c_mktsegment' END) END AS fields FROM r WHERE (o OR w) AND (NOT w OR NOT o OR a OR b)""",
    "contract_breaches": """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 2""",
    "standing_choices": """WITH t AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS d FROM events) SELECT user_id, arg_max(event_type, event_id) AS choice FROM t WHERE d = 1 AND event_id % 3 <> 0 GROUP BY user_id""",
    "printed_identifiers": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat('10.5072/a', page_id) WHEN page_id % 3 = 0 THEN '' ELSE concat('10.5072/a', page_id) END AS doi, CAST(page_id + 10000 AS VARCHAR) AS pmid, CASE WHEN page_id % 2 = 0 AND page_id >= 10 THEN CAST(page_id + 9990 AS VARCHAR) ELSE '' END AS raw_pmid, 'Unal C' AS name, concat('5±', page_id, ' mm') AS clean FROM pages""",
    "scoped_compare": f"""WITH r AS (SELECT DISTINCT o_orderkey % 8 AS kind, o_orderkey % 5 AS scope, {_among("o_orderkey", "age", "size")} AS field_type FROM orders), v AS (SELECT *, CASE kind WHEN 0 THEN 'match' WHEN 1 THEN CASE WHEN field_type = 'age' THEN 'match' ELSE 'mismatch' END WHEN 2 THEN 'mismatch' WHEN 3 THEN 'not_comparable' WHEN 5 THEN 'not_comparable' ELSE 'match' END AS l, kind >= 4 AS st, kind IN (5, 7) AS rev FROM r)
        SELECT kind, scope, field_type, CASE WHEN scope IN (1, 2) THEN 'not_comparable' ELSE l END AS label, CASE WHEN scope NOT IN (1, 2) AND st THEN 'structured' ELSE 'numeric' END AS mode, scope IN (1, 2) OR rev AS review_required FROM v""",
    "flag_summary": f"""WITH r AS (SELECT o_orderkey % 30 AS key, o_custkey AS s, {_among("o_orderkey", "match", "mismatch", "not_comparable", None)} AS l, {_among("o_orderkey", "paired", "paired", "paired", "no_source_evidence", "ambiguous_match_key")} AS why, {_among("o_orderkey", None, "unknown_cohort", "source_access_failed")} AS o, o_orderkey % 8 = 0 AS rev FROM orders),
        f AS (SELECT key, s, l, CASE WHEN l = 'mismatch' THEN 'detected_error' WHEN l = 'match' THEN CASE WHEN rev THEN 'review_required' END WHEN l = 'not_comparable' OR why = 'no_source_evidence' THEN coalesce(o, CASE WHEN l = 'not_comparable' THEN 'not_comparable' ELSE 'missing_source' END) ELSE why END AS flag FROM r)
        SELECT key, flag, count(*) AS cells, count(DISTINCT s) AS studies FROM f WHERE flag IS NOT NULL GROUP BY 1, 2""",
}
