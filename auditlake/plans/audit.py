"""Queries that pair, compare and count. Claims and evidence are made from lineitem by integer arithmetic, so that both engines make the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.numeric import relative_error, with_cells
from auditlake.functions.units import normal_unit, unit_kind, units_differ
from auditlake.operators.compare import MEAN, compare_values, scope_verdict, verdict, with_tolerances
from auditlake.operators.judgement import flag_of
from auditlake.operators.matching import duplicate_keys, pair_or_refuse
from auditlake.sources.tables import table

SIDES_SQL = """
WITH r AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN concat(l_orderkey, '/', l_linenumber) END AS id, concat(l_orderkey, '|', l_linenumber) AS key, l_partkey AS cell, l_suppkey AS pos, l_quantity AS value FROM lineitem WHERE l_orderkey % 3 <> 2),
s AS (SELECT CASE WHEN l_orderkey % 5 = 0 AND l_partkey % 9 <> 0 THEN concat(l_orderkey, '/', l_linenumber) END AS id, concat(l_orderkey, '|', l_linenumber) AS key, CASE WHEN l_suppkey % 17 = 0 THEN l_partkey + 1 ELSE l_partkey END AS cell, l_suppkey AS pos, l_quantity * CASE WHEN l_partkey % 7 = 0 THEN 1.02 WHEN l_partkey % 13 = 0 THEN 1.005 ELSE 1.0 END::DOUBLE AS value FROM lineitem WHERE (l_orderkey + l_partkey) % 11 <> 0),
rid AS (SELECT id, count(*) AS n FROM r WHERE id IS NOT NULL GROUP BY id),
sid AS (SELECT id, count(*) AS n FROM s WHERE id IS NOT NULL GROUP BY id),
rr AS (SELECT r.*, rid.n AS nr, coalesce(sid.n, 0) AS ns FROM r JOIN rid USING (id) LEFT JOIN sid USING (id)),
ss AS (SELECT s.*, coalesce(rid.n, 0) AS nr, sid.n AS ns FROM s JOIN sid USING (id) LEFT JOIN rid USING (id)),
met AS (SELECT rr.key, ss.key AS source_key, rr.value AS rv, ss.value AS sv, rr.key = ss.key AND rr.cell = ss.cell AS same FROM rr JOIN ss USING (id) WHERE rr.nr = 1 AND rr.ns = 1),
kr AS (SELECT key, count(*) AS n_r FROM r WHERE id IS NULL GROUP BY key),
ks AS (SELECT key, count(*) AS n_s, max(value) AS only_value FROM s WHERE id IS NULL GROUP BY key),
fr AS (SELECT r.*, row_number() OVER (PARTITION BY key, cell ORDER BY pos, value) AS rk FROM r WHERE id IS NULL),
fs AS (SELECT s.*, row_number() OVER (PARTITION BY key, cell ORDER BY pos DESC, value DESC) AS rk FROM s WHERE id IS NULL),
claims AS (SELECT fr.key, fr.value AS rv, CASE WHEN n_r = 1 AND coalesce(n_s, 0) <= 1 THEN only_value ELSE f.value END AS sv, CASE WHEN n_r = 1 AND coalesce(n_s, 0) = 1 THEN 'paired' WHEN n_r = 1 AND coalesce(n_s, 0) = 0 THEN 'no_source_evidence' WHEN f.key IS NOT NULL THEN 'paired' ELSE 'ambiguous_match_key' END AS reason
  FROM fr JOIN kr USING (key) LEFT JOIN ks USING (key) LEFT JOIN fs f ON f.key = fr.key AND f.cell = fr.cell AND f.rk = 1 AND fr.rk = 1),
lost AS (SELECT DISTINCT key, cell FROM rr WHERE nr = 1 AND ns = 0),
evidence AS (SELECT fs.key, fs.value AS sv, CASE WHEN lost.key IS NOT NULL THEN 'claim_identity_missing' ELSE 'unclaimed_source' END AS reason
  FROM fs LEFT JOIN kr USING (key) JOIN ks USING (key) LEFT JOIN fr c ON c.key = fs.key AND c.cell = fs.cell AND c.rk = 1 LEFT JOIN lost ON lost.key = fs.key AND lost.cell = fs.cell
  WHERE NOT (coalesce(n_r, 0) = 1 AND n_s = 1) AND NOT (fs.rk = 1 AND c.key IS NOT NULL)),
outcome AS (
  SELECT 'review' AS side, CASE WHEN nr > 1 OR ns > 1 THEN 'duplicate_claim_id' ELSE 'claim_identity_missing' END AS reason, key, value AS rv, CAST(NULL AS DOUBLE) AS sv FROM rr WHERE nr > 1 OR ns > 1 OR ns = 0
  UNION ALL SELECT 'source', CASE WHEN nr > 1 OR ns > 1 THEN 'duplicate_claim_id' ELSE 'claim_identity_missing' END, key, NULL, value FROM ss WHERE nr > 1 OR ns > 1 OR nr = 0
  UNION ALL SELECT 'pair', 'paired', key, rv, sv FROM met WHERE same
  UNION ALL SELECT 'review', 'claim_identity_key_conflict', key, rv, NULL FROM met WHERE NOT same
  UNION ALL SELECT 'source', 'claim_identity_key_conflict', source_key, NULL, sv FROM met WHERE NOT same
  UNION ALL SELECT CASE WHEN reason = 'paired' THEN 'pair' ELSE 'review' END, reason, key, rv, CASE WHEN reason = 'paired' THEN sv END FROM claims
  UNION ALL SELECT 'source', reason, key, NULL, sv FROM evidence),
labelled AS (SELECT *, CAST(split_part(key, '|', 1) AS BIGINT) AS study_id, CASE WHEN side = 'pair' THEN CASE WHEN abs(rv - sv) / greatest(abs(rv), abs(sv), 1e-9) <= 0.01 THEN 'match' ELSE 'mismatch' END END AS label FROM outcome)
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    name = F.concat_ws("/", "l_orderkey", "l_linenumber")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key")
    pos = F.col("l_suppkey").alias("pos")
    claimed = F.col("l_orderkey") % 5 == 0
    review = lines.where("l_orderkey % 3 <> 2").select(F.when(claimed, name).alias("id"), key, F.col("l_partkey").alias("cell"), pos, F.col("l_quantity").alias("value"))
    factor = F.when(F.col("l_partkey") % 7 == 0, 1.02).when(F.col("l_partkey") % 13 == 0, 1.005).otherwise(1.0)
    cell = F.when(F.col("l_suppkey") % 17 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("cell")
    source = lines.where("(l_orderkey + l_partkey) % 11 <> 0").select(F.when(claimed & (F.col("l_partkey") % 9 != 0), name).alias("id"), key, cell, pos, (F.col("l_quantity") * factor).alias("value"))
    found = pair_or_refuse(review, source)
    label = F.when(F.col("side") == "pair", F.when(relative_error(F.col("review_value"), F.col("source_value")) <= MEAN, "match").otherwise("mismatch"))
    return found.withColumns({"study_id": F.split_part("key", F.lit("|"), F.lit(1)).cast("long"), "label": label})


def pair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).where("side = 'pair'").select("key", F.round("review_value", 4).alias("review_value"), F.round("source_value", 4).alias("source_value"), "label")


def refusal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).groupBy("side", "reason").agg(F.count("*").alias("n"))


def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = outcomes(spark, sf_dir).where("side <> 'source'")
    told = claims.groupBy("study_id").agg(F.count("*").alias("claims"), F.count("label").alias("compared"), F.count_if(F.col("label") == "match").alias("matched"), F.count_if(F.col("label") == "mismatch").alias("mismatched"), F.count_if(F.col("label").isNull()).alias("unmatched"))
    none = F.lit(0)
    return told.withColumn("verdict", verdict(F.col("compared"), F.col("matched"), F.col("mismatched"), none, none, F.col("unmatched")))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_verdict(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("studies"), F.sum("matched").alias("matched"), F.sum("mismatched").alias("mismatched"))


def judge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for each claim that wasn't released, with what it is about."""
    found = outcomes(spark, sf_dir).where("side <> 'source' and (label is null or label <> 'match')")
    flag = flag_of(F.col("label"), F.col("reason"), F.lit(None).cast("string"), F.lit(False))
    return found.groupBy("study_id", flag.alias("flag")).agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def unmatched_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders and orders without lines, each side named."""
    customers, orders, lines = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    idle = customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("key"))
    empty = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").select(F.lit("orders").alias("side"), F.col("o_orderkey").alias("key"))
    return idle.unionByName(empty)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    p, q = "cast(l_partkey % 90 + 5 as int)", "cast(l_quantity as int)"
    base = lines.select(F.expr("cast(l_partkey % 8 as int)").alias("k"), F.expr("cast(l_suppkey % 3 as int)").alias("m"), F.expr("cast(l_orderkey % 3 as int)").alias("u"), F.expr(p).alias("p"), F.expr(q).alias("q"))
    a = """case k when 0 then concat(q, '.5 ± ', p, '.2') when 1 then concat(q, ' (', p, '-', p + 7, ')') when 2 then concat(3 * q, '/', 8 * q, ' (37.5%)') when 3 then concat('0.', p, ' (95% CI 0.', p, '–1.', p, ')')
        when 4 then concat('< 0.', p) when 5 then concat(p, '.5%') when 6 then concat('1,', lpad(cast(p as string), 3, '0')) else concat(p, ',5 mm') end"""
    b = """case when m = 2 then 'NR' when m = 0 then a else case k when 0 then concat(q + 1, '.5 ± ', p, '.2') when 1 then concat(q + 1, ' (', p, '-', p + 7, ')') when 2 then concat(3 * q, '/', 9 * q, ' (33.3%)') when 3 then concat('0.', p, ' (95% CI 0.', p, '–2.', p, ')')
        when 4 then concat('> 0.', p) when 5 then concat(p + 10, '.5%') when 6 then concat('1,', lpad(cast(p + 100 as string), 3, '0')) else concat(p + 1, ',5 mm') end end"""
    return base.withColumn("a", F.expr(a)).withColumn("b", F.expr(b))


def parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = with_cells(cells(spark, sf_dir).select("k", "a").distinct(), c=F.col("a"))
    c = F.col("c")
    doubles = ("primary", "spread", "lower", "upper", "ci_lower", "ci_upper", "ci_level", "pct")
    return distinct.select("k", F.col("a").alias("cell"), c["operator"].alias("operator"), c["spread_kind"].alias("spread_kind"), c["events"].alias("events"), c["total"].alias("total"), *(F.round(c[d], 6).alias(d) for d in doubles))


PARSE_SQL = """
WITH c AS (SELECT DISTINCT CAST(l_partkey % 8 AS INTEGER) AS k, CAST(l_partkey % 90 + 5 AS INTEGER) AS p, CASE WHEN l_partkey % 8 IN (0, 1, 2) THEN CAST(l_quantity AS INTEGER) END AS q FROM lineitem)
SELECT DISTINCT k, CASE k WHEN 0 THEN concat(q, '.5 ± ', p, '.2') WHEN 1 THEN concat(q, ' (', p, '-', p + 7, ')') WHEN 2 THEN concat(3 * q, '/', 8 * q, ' (37.5%)') WHEN 3 THEN concat('0.', p, ' (95% CI 0.', p, '–1.', p, ')') WHEN 4 THEN concat('< 0.', p) WHEN 5 THEN concat(p, '.5%') WHEN 6 THEN concat('1,', lpad(CAST(p AS VARCHAR), 3, '0')) ELSE concat(p, ',5 mm') END AS cell,
  CASE WHEN k = 4 THEN '<' END AS operator, CASE k WHEN 0 THEN 'sd' WHEN 1 THEN 'range' END AS spread_kind, CASE WHEN k = 2 THEN CAST(3 * q AS BIGINT) END AS events, CASE WHEN k = 2 THEN CAST(8 * q AS BIGINT) END AS total,
  round(CASE k WHEN 0 THEN q + 0.5 WHEN 1 THEN q WHEN 2 THEN 3 * q WHEN 3 THEN CAST(concat('0.', p) AS DOUBLE) WHEN 4 THEN CAST(concat('0.', p) AS DOUBLE) WHEN 5 THEN p + 0.5 WHEN 6 THEN 1000 + p ELSE p + 0.5 END::DOUBLE, 6) AS primary,
  round(CASE k WHEN 0 THEN CAST(concat(p, '.2') AS DOUBLE) WHEN 1 THEN 3.5::DOUBLE END, 6) AS spread,
  round(CASE k WHEN 0 THEN (q + 0.5::DOUBLE) - CAST(concat(p, '.2') AS DOUBLE) WHEN 1 THEN p::DOUBLE END, 6) AS lower, round(CASE k WHEN 0 THEN (q + 0.5::DOUBLE) + CAST(concat(p, '.2') AS DOUBLE) WHEN 1 THEN (p + 7)::DOUBLE END, 6) AS upper,
  round(CASE k WHEN 3 THEN CAST(concat('0.', p) AS DOUBLE) END, 6) AS ci_lower, round(CASE k WHEN 3 THEN CAST(concat('1.', p) AS DOUBLE) END, 6) AS ci_upper, CASE k WHEN 3 THEN 95.0::DOUBLE END AS ci_level, round(CASE k WHEN 2 THEN 37.5 WHEN 5 THEN p + 0.5 END::DOUBLE, 6) AS pct
FROM (SELECT DISTINCT * FROM c)
"""


def structured_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumns({"ua": F.lit("cm3"), "ub": F.expr("case u when 0 then 'cc' when 1 then 'mL' else 'mm' end")})
    # equal pairs are compared once
    pairs = rows.groupBy("k", "m", "u", "a", "b", "ua", "ub").agg(F.count("*").alias("rows"))
    return compare_values(pairs, "a", "b", "ua", "ub").groupBy("k", "m", "u", "label", "mode", "review_required").agg(F.sum("rows").alias("n"))


def unit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey")
    units = F.array(*map(F.lit, ("kg/m²", "cm³", "mL", "Years", " cc / m2 ", "mmHg", "", "%")))
    a, b = F.element_at(units, (F.col("p_partkey") % 8 + 1).cast("int")), F.element_at(units, (F.col("p_partkey") % 7 + 1).cast("int"))
    return parts.select("p_partkey", normal_unit(a).alias("unit_a"), unit_kind(a).alias("kind_a"), units_differ(a, b).alias("differ"))


def scope_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = "element_at(array('allocated/itt', 'treated/safety', cast(null as string), 'analysed/pp'), cast({} % 4 + 1 as int))"
    orders = table(spark, sf_dir, "orders").select(F.expr(scopes.format("o_orderkey")).alias("a"), F.expr(scopes.format("o_custkey")).alias("b"), (F.col("o_orderkey") % 3 == 0).alias("required"))
    got = orders.withColumn("scope_check", scope_verdict(F.col("a"), F.col("b"), F.col("required"))).groupBy("scope_check").agg(F.count("*").alias("n"), F.count_if("required").alias("required"))
    return got


def tolerance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band for each type of part, with a default for those that have none."""
    bands = spark.createDataFrame([("ECONOMY", 0.02), ("STANDARD", 0.005), ("*", 0.01)], "p_type string, rel double")
    return with_tolerances(table(spark, sf_dir, "part"), bands, "p_type").select("p_partkey", "p_type", "rel")


QUERIES = {f.__name__: f for f in (pair_labels, refusal_reasons, audit_verdict, label_counts, judge_flags, duplicate_line_keys, unmatched_sides, parse_cells, structured_compare, unit_check, scope_verdicts, tolerance_lookup)}

VERDICT_SQL = SIDES_SQL + """, told AS (SELECT study_id, count(*) AS claims, count(label) AS compared, count(*) FILTER (label = 'match') AS matched, count(*) FILTER (label = 'mismatch') AS mismatched, count(*) FILTER (label IS NULL) AS unmatched FROM labelled WHERE side <> 'source' GROUP BY study_id),
judged AS (SELECT *, CASE WHEN compared = 0 THEN 'INCOMPLETE' WHEN mismatched > 0 THEN 'FAIL' WHEN matched = 0 THEN 'INCOMPLETE' WHEN unmatched > 0 THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM told)
"""

ORACLE_SQL = {
    "pair_labels": SIDES_SQL + "SELECT key, round(rv, 4) AS review_value, round(sv, 4) AS source_value, label FROM labelled WHERE side = 'pair'",
    "refusal_reasons": SIDES_SQL + "SELECT side, reason, count(*) AS n FROM outcome GROUP BY side, reason",
    "audit_verdict": VERDICT_SQL + "SELECT * FROM judged",
    "label_counts": VERDICT_SQL + "SELECT verdict, count(*) AS studies, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(mismatched) AS BIGINT) AS mismatched FROM judged GROUP BY verdict",
    "judge_flags": SIDES_SQL + "SELECT study_id, CASE WHEN label = 'mismatch' THEN 'detected_error' WHEN reason = 'no_source_evidence' THEN 'missing_source' ELSE reason END AS flag, count(*) AS n, min(key) AS first_key FROM labelled WHERE side <> 'source' AND (label IS NULL OR label <> 'match') GROUP BY ALL",
    "duplicate_line_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "unmatched_sides": "SELECT 'customer' AS side, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "parse_cells": PARSE_SQL,
    "structured_compare": """SELECT k, m, u, CASE WHEN m = 2 THEN 'not_comparable' WHEN u = 2 THEN 'unit_mismatch' WHEN m = 1 THEN 'mismatch' ELSE 'match' END AS label, CASE WHEN m <> 2 AND u <> 2 AND k IN (2, 3, 4, 5) THEN 'structured' ELSE 'numeric' END AS mode, false AS review_required, count(*) AS n
        FROM (SELECT CAST(l_partkey % 8 AS INTEGER) AS k, CAST(l_suppkey % 3 AS INTEGER) AS m, CAST(l_orderkey % 3 AS INTEGER) AS u FROM lineitem) GROUP BY k, m, u""",
    "unit_check": """WITH u(i, norm, kind) AS (VALUES (0, 'kg/m2', 'unknown'), (1, 'ml', 'volume'), (2, 'ml', 'volume'), (3, 'yr', 'time'), (4, 'ml/m2', 'unknown'), (5, 'mmhg', 'pressure'), (6, '', 'unknown'), (7, '%', 'percent'))
        SELECT p_partkey, a.norm AS unit_a, a.kind AS kind_a, a.norm <> '' AND b.norm <> '' AND a.norm <> b.norm AS differ FROM part JOIN u a ON a.i = p_partkey % 8 JOIN u b ON b.i = p_partkey % 7""",
    "scope_verdicts": """WITH s(i, v) AS (VALUES (0, 'allocated/itt'), (1, 'treated/safety'), (2, NULL), (3, 'analysed/pp'))
        SELECT CASE WHEN a.v <> b.v THEN 'mismatch' WHEN o_orderkey % 3 = 0 AND (a.v IS NULL OR b.v IS NULL) THEN 'unresolved' WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'resolved' ELSE 'not_required' END AS scope_check, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS required
        FROM orders JOIN s a ON a.i = o_orderkey % 4 JOIN s b ON b.i = o_custkey % 4 GROUP BY 1""",
    "tolerance_lookup": "SELECT p_partkey, p_type, CAST(CASE p_type WHEN 'ECONOMY' THEN 0.02 WHEN 'STANDARD' THEN 0.005 ELSE 0.01 END AS DOUBLE) AS rel FROM part",
}
