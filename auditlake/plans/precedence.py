"""Queries over joins that try several keys, the most specific first, and over the readings that answer a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import census, precedence, projection
from auditlake.sources.tables import table


def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status that each order is known by: by its customer where that is carried, else by a place that several customers share in a year."""
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("string")
    claim = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    asked = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, claim).alias("claim"), F.concat_ws("|", (F.col("o_custkey") % 997).cast("string"), year).alias("place"))
    known = orders.where("o_orderkey % 5 = 0").select(F.when(F.col("o_custkey") % 2 == 0, claim).alias("claim"), F.concat_ws("|", (F.col("o_custkey") % 499).cast("string"), year).alias("place"), "o_orderstatus")
    return precedence.by_precedence(asked, known, "o_orderkey", "o_orderstatus", [(F.col(k), F.col(k)) for k in ("claim", "place")])


def cell_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the value of each part comes from, by the labels that other parts of its size give to rows, columns and tables."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    path = F.when(k % 4 == 0, F.lower("p_type")).when(k % 4 == 1, F.col("p_name")).when((k % 4 == 2) & (k % 5 == 0), "").otherwise("no such column")
    source = F.when(k % 2 == 0, "read").when(k % 3 == 0, "derived").otherwise("computed")
    labels = part.select(F.col("p_size").alias("table_id"), path.alias("column_path"), F.when(k % 3 == 0, (k % 7).cast("int")).alias("row"), source.alias("value_source"), k.alias("pos"))
    cells = part.select("p_partkey", F.col("p_size").alias("table_id"), F.concat_ws(" / ", "p_type", "p_name").alias("path"), (k % 7).cast("int").alias("row"))
    return precedence.origins(cells, labels).select("p_partkey", "value_source", "level", "conflict")


def projected_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's lines, as readings of a batch, answer to a claim for each of three arms and one for the whole. Some batches failed, some claims ask for a population or a time, and some totals are printed, a few of them wrong."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"))
    k, none = F.col("batch"), F.lit(None).cast("string")
    arms = {"A": "accepted", "N": "new", "R": "returned"}
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"), "l_linenumber", "l_partkey", "l_suppkey")
    label = F.coalesce(*(F.when(F.col("l_returnflag") == f, f"The {said} lot") for f, said in arms.items()))
    pos = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    when = F.when(F.col("l_linenumber") % 2 == 1, "baseline visit").otherwise("final visit")
    columns = ["batch", "pos", "shape", "arm_label", "left_label", "right_label", "basis", "analysis_set", "timepoint", "value", "quote", "usable"]
    read = lines.select("batch", pos.alias("pos"), F.lit("arm").alias("shape"), label.alias("arm_label"), none.alias("left_label"), none.alias("right_label"), F.col("l_linestatus").alias("basis"), none.alias("analysis_set"), when.alias("timepoint"), F.col("q").cast("string").alias("value"), F.concat(F.lit("n "), F.col("q").cast("string")).alias("quote"), (F.col("q") > 2).alias("usable"))
    whole = lines.groupBy("batch").agg(F.sum("q").alias("total"))
    printed = (F.col("total") + F.when(k % 9 == 0, 1).otherwise(0)).cast("string")
    said = whole.where("batch % 3 = 0").select("batch", F.lit(0).cast("long").alias("pos"), F.lit("study").alias("shape"), none.alias("arm_label"), none.alias("left_label"), none.alias("right_label"), none.alias("basis"), none.alias("analysis_set"), none.alias("timepoint"), printed.alias("value"), printed.alias("quote"), F.lit(True).alias("usable"))
    entries = read.select(columns).unionByName(said.select(columns))
    each = orders.select("batch", F.explode(F.array(*map(F.lit, [*arms, "S"]))).alias("cohort_key"))
    ident = F.concat_ws("|", k.cast("string"), "cohort_key").alias("id")
    shape = F.when(F.col("cohort_key") == "S", "study").otherwise("arm")
    required = F.when((k % 2 == 0) & (F.col("cohort_key") != "S"), F.array(F.lit("basis"))).otherwise(F.array().cast("array<string>"))
    requests = each.select(ident, "batch", F.lit("one").alias("study"), shape.alias("shape"), "cohort_key", none.alias("left"), none.alias("right"), F.when(k % 2 == 0, "F").alias("basis"), none.alias("analysis_set"), required.alias("required"), F.when(k % 5 == 0, "Final").alias("timepoint"))
    review = spark.createDataFrame([("one", f, f"{said} goods") for f, said in arms.items()], "study string, arm string, label string")
    failed = orders.where("batch % 11 = 0").select("batch", F.lit("no answer").alias("error"))
    sums = whole.where("batch % 4 <> 0").select(F.concat(k.cast("string"), F.lit("|S")).alias("id"), F.col("total").cast("long").alias("total"), F.lit(True).alias("exact"), F.lit(True).alias("timed"))
    return projection.project(requests, review, entries, failed, sums)


def group_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the priorities of each customer's orders are the groups that a passage counts and names."""
    k = F.col("o_custkey")
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.lower(F.substring_index("o_orderpriority", "-", -1)))).alias("counted"))
    n = F.size("counted")
    said = F.when(k % 5 == 0, F.concat(F.lit("patients of "), n.cast("string"), F.lit(" treatment arms"))).when(k % 5 == 1, F.concat(F.get(F.array(*map(F.lit, census.NUMBERS)), n - 1), F.lit(" groups:"))).when(k % 5 == 2, F.concat(F.lit("group "), n.cast("string"))).when(k % 5 == 3, F.concat(n.cast("string"), F.lit(" mg treatment arms"))).otherwise("")
    named = F.when(k % 7 < 5, F.array_join("counted", " and ")).otherwise("")
    labels = F.when(k % 3 == 0, F.col("counted")).when(k % 3 == 1, F.slice("counted", F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    rows = held.select("o_custkey", F.trim(F.concat_ws(" ", said, named)).alias("quote"), F.when(k % 4 < 2, n).when(k % 4 == 2, n + 1).alias("declared"), labels.alias("labels"), "counted")
    return census.census(rows).select("o_custkey", "census")


QUERIES = {f.__name__: f for f in (identity_lookup, cell_origins, projected_claims, group_census)}

ORACLE_SQL = {
    "identity_lookup": """WITH k AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN concat('c', o_custkey) END AS claim, concat(o_custkey % 499, '|', year(o_orderdate)) AS place, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 = 0),
        a AS (SELECT claim, min(v) AS lo, max(v) AS hi FROM k WHERE claim IS NOT NULL GROUP BY claim), b AS (SELECT place, min(v) AS lo, max(v) AS hi FROM k GROUP BY place),
        o AS (SELECT o_orderkey, CASE WHEN a.lo IS NOT NULL THEN 0 WHEN b.lo IS NOT NULL THEN 1 END AS level, CASE WHEN a.lo IS NOT NULL THEN a.lo ELSE b.lo END AS lo, CASE WHEN a.lo IS NOT NULL THEN a.hi ELSE b.hi END AS hi FROM orders LEFT JOIN a ON o_orderkey % 3 = 0 AND a.claim = concat('c', o_custkey) LEFT JOIN b ON b.place = concat(o_custkey % 997, '|', year(o_orderdate)))
        SELECT o_orderkey, level, CASE WHEN lo = hi THEN lo END AS o_orderstatus, CASE WHEN lo IS NULL THEN 'unmatched' WHEN lo <> hi THEN 'ambiguous' ELSE 'found' END AS status FROM o""",
    "group_census": """WITH g AS (SELECT o_custkey AS k, list_sort(list(DISTINCT lower(string_split(o_orderpriority, '-')[-1]))) AS c FROM orders GROUP BY 1),
        w AS (SELECT *, len(c) AS n, CASE WHEN k % 4 < 2 THEN len(c) WHEN k % 4 = 2 THEN len(c) + 1 END AS d, CASE k % 3 WHEN 0 THEN c WHEN 1 THEN c[1:greatest(len(c) - 1, 1)] ELSE [] END AS l, k % 7 < 5 AS named, k % 5 IN (0, 1) AS counted, k % 5 = 4 AND k % 7 >= 5 AS silent FROM g)
        SELECT k AS o_custkey, CASE WHEN d IS NULL AND len(l) = 0 THEN NULL WHEN silent THEN 'no passage' WHEN d IS NOT NULL AND NOT (counted AND d = n) THEN 'the passage doesn''t count the groups' WHEN d <> n THEN 'other number of counts' WHEN len(l) > 0 AND NOT named THEN 'the passage doesn''t name a group'
            WHEN len(l) > 0 AND len(l) <> n THEN 'other groups are counted' WHEN len(l) > 0 AND d <> len(l) THEN 'other number of names' END AS census FROM w""",
    "projected_claims": """WITH r AS (SELECT o_orderkey AS b, f FROM orders, (VALUES ('A'), ('N'), ('R'), ('S')) v(f)),
        e AS (SELECT l_orderkey AS b, l_returnflag AS f, l_linestatus AS s, CAST(l_quantity AS INTEGER) AS q, l_linenumber % 2 = 0 AS final, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos FROM lineitem WHERE CAST(l_quantity AS INTEGER) > 2),
        w AS (SELECT l_orderkey AS b, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total FROM lineitem GROUP BY 1),
        n AS (SELECT b, f, count(*) AS n FROM e GROUP BY b, f), a AS (SELECT b, sum(n) AS n FROM n GROUP BY b),
        c AS (SELECT * FROM e WHERE b % 2 <> 0 OR s = 'F'),
        t AS (SELECT b, f, count(*) AS n, count(*) FILTER (final) AS finals, count(DISTINCT final) AS times, count(DISTINCT q) AS qs, min(pos) AS first FROM c GROUP BY b, f),
        z AS (SELECT r.b, r.f, CASE WHEN r.b % 11 = 0 THEN 'batch_failed' WHEN a.n IS NULL AND (r.b % 3 <> 0 OR w.total IS NULL) THEN 'not_reported' WHEN a.n IS NULL THEN 'ambiguous' WHEN n.n IS NULL THEN 'not_reported' WHEN t.n IS NULL THEN 'scope_unresolved'
            WHEN r.b % 5 = 0 AND t.n > 1 AND t.times > 1 THEN CASE WHEN t.finals > 1 THEN 'timepoint_unresolved' ELSE 'ok' END WHEN t.qs > 1 THEN 'contradictory' ELSE 'ok' END AS status, t.first, r.b % 5 = 0 AND t.times > 1 AS timed
            FROM r LEFT JOIN a USING (b) LEFT JOIN w ON w.b = r.b LEFT JOIN n ON n.b = r.b AND n.f = r.f LEFT JOIN t ON t.b = r.b AND t.f = r.f WHERE r.f <> 'S'),
        x AS (SELECT z.*, (SELECT min({'pos': pos, 'q': q}) FROM c WHERE c.b = z.b AND c.f = z.f AND (NOT coalesce(z.timed, false) OR c.final)).q AS q FROM z),
        y AS (SELECT r.b, CASE WHEN r.b % 11 = 0 THEN 'batch_failed' WHEN total IS NULL THEN 'not_reported' WHEN r.b % 3 = 0 AND r.b % 9 = 0 AND r.b % 4 <> 0 THEN 'contradictory' WHEN r.b % 3 = 0 THEN 'ok' WHEN r.b % 4 <> 0 THEN 'derived' ELSE 'not_reported' END AS status, total + CASE WHEN r.b % 9 = 0 THEN 1 ELSE 0 END AS v FROM r LEFT JOIN w USING (b) WHERE r.f = 'S')
        SELECT concat(b, '|', f) AS id, status, CASE WHEN status = 'ok' THEN CAST(q AS VARCHAR) END AS value, CASE WHEN status = 'ok' THEN concat('n ', q) END AS quote,
            CASE status WHEN 'batch_failed' THEN 'no answer' WHEN 'ambiguous' THEN 'arms: nothing to assign' WHEN 'scope_unresolved' THEN 'no reading of the population asked for' WHEN 'timepoint_unresolved' THEN 'two readings are as near to the timepoint' WHEN 'contradictory' THEN 'readings differ' WHEN 'not_reported' THEN CASE WHEN b IN (SELECT b FROM a) THEN 'no arm of the batch is the one asked for' ELSE 'no usable reading' END END AS reason FROM x
        UNION ALL SELECT concat(b, '|S'), status, CASE WHEN status IN ('ok', 'derived') THEN CAST(v AS VARCHAR) END, CASE WHEN status = 'ok' THEN CAST(v AS VARCHAR) END, CASE status WHEN 'batch_failed' THEN 'no answer' WHEN 'contradictory' THEN 'the printed total and the arms differ' WHEN 'not_reported' THEN 'no usable reading' END FROM y""",
    "cell_origins": """WITH l AS (SELECT p_size AS t, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) WHEN p_partkey % 4 = 1 THEN p_name WHEN p_partkey % 4 = 2 AND p_partkey % 5 = 0 THEN '' ELSE 'no such column' END AS c, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 END AS r, CASE WHEN p_partkey % 2 = 0 THEN 'read' WHEN p_partkey % 3 = 0 THEN 'derived' ELSE 'computed' END AS v, p_partkey AS pos FROM part),
        c AS (SELECT p_partkey, p_size AS t, lower(concat(p_type, ' / ', p_name)) AS path, p_partkey % 7 AS r FROM part),
        h AS (SELECT p_partkey, v, pos, CASE WHEN l.c = '' THEN 3 WHEN NOT (contains(path, l.c) OR contains(l.c, path)) THEN NULL WHEN l.r = c.r THEN 1 WHEN l.r IS NULL THEN 2 END AS level FROM c JOIN l USING (t)),
        b AS (SELECT p_partkey, min({'level': level, 'pos': pos, 'v': v}) AS best, count(DISTINCT v) FILTER (level = 2) > 1 AS conflict FROM h WHERE level IS NOT NULL GROUP BY p_partkey)
        SELECT p_partkey, best.v AS value_source, CASE best.level WHEN 1 THEN 'row' WHEN 2 THEN 'column' WHEN 3 THEN 'table' END AS level, coalesce(conflict, false) AS conflict FROM c LEFT JOIN b USING (p_partkey)""",
}
