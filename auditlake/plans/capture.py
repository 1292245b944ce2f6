"""Queries over captured tables, cohorts and anchored evidence. Markup, labels and passages are made from the tables by integer arithmetic, so that both engines make the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.operators import anchoring, cohorts, tables, targets
from auditlake.sources.tables import spread, table


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marked-up table of each customer's orders, by priority; the priority spans its rows, and the head has two rows."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    by = Window.partitionBy("o_custkey", "o_orderpriority")
    first = F.row_number().over(by.orderBy("o_orderkey")) == 1
    opens = F.when(first, F.concat(F.lit('<td rowspan="'), F.count("*").over(by).cast("string"), F.lit('">'), "o_orderpriority", F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), opens, F.lit("<td><b>"), F.col("o_orderkey").cast("string"), F.lit("</b></td><td> "), "o_orderstatus", F.lit("</td></tr>"))
    body = orders.withColumn("row", row).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderkey", "row")))["row"], "").alias("body"))
    head = '<thead><tr><th rowspan="2">Priority</th><th colspan="2">Order</th></tr><tr><th>key</th><th>status</th></tr></thead>'
    name = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(' id="T'), F.col("o_custkey").cast("string"), F.lit('"'))).otherwise("")
    caption = F.when(F.col("o_custkey") % 3 == 0, "Table 1. Orders").otherwise("Orders")
    xml = F.concat(F.lit("<article><p>text</p><table-wrap"), name, F.lit("><label>Table 1</label><caption>"), caption, F.lit(f"</caption><table>{head}<tbody>"), "body", F.lit("</tbody></table></table-wrap></article>"))
    return body.select(F.col("o_custkey").alias("doc_id"), xml.alias("xml"))


def captured_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every customer's table, spans filled in."""
    return tables.cells_from_xml(_markup(spark, sf_dir))


def _head_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of a head and one of a body for each part."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), "p_brand", "p_type")
    text = F.array(F.array(F.lit("Study"), F.col("p_brand"), F.lit(" "), F.when(F.col("table_id") % 2 == 0, "").otherwise(F.col("p_type"))), F.array(F.lit(""), F.lit("n"), F.lit("mean "), F.col("p_type")), F.array(F.lit("a"), F.lit("1"), F.lit("2"), F.lit("3")))
    rows = parts.select("table_id", F.posexplode(text).alias("i", "row")).select("table_id", "i", F.posexplode("row").alias("c", "text"))
    return rows.select("table_id", (F.col("i") < 2).alias("head"), F.when(F.col("i") < 2, F.col("i")).otherwise(0).alias("r"), "c", "text")


def header_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_paths(_head_cells(spark, sf_dir), ["table_id"])


def table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as rows of tables whose first column is blank where a part goes on, with a Year column that is stated now and then."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("int").alias("r"), "l_partkey", F.year("l_shipdate").cast("string").alias("y"))
    # a table has one row of a number
    lines = lines.groupBy("table_id", "r").agg(F.min(F.struct("l_partkey", "y")).alias("x")).select("table_id", "r", "x.*")
    texts = F.array(F.when(F.col("r") % 3 == 1, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).otherwise(" "), F.when(F.col("r") % 2 == 1, F.concat(F.lit("in "), "y")).otherwise(""), F.lit("x"))
    body = lines.select("table_id", F.lit(False).alias("head"), "r", F.posexplode(texts).alias("c", "text"))
    names = F.array(F.lit("Item"), F.lit("Year"), F.lit("Value"))
    head = lines.select("table_id").distinct().select("table_id", F.lit(True).alias("head"), F.lit(0).alias("r"), F.posexplode(names).alias("c", "text"))
    return tables.row_labels(body.unionByName(head), ["table_id"])


def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of suppliers, of which some lack a head, rows or cells, or name columns twice or not at all; and whether their rows name studies."""
    k = F.col("table_id")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("table_id"))
    head = F.array(F.lit("Study"), F.when(k % 5 == 0, "Study").otherwise("n"), F.when(k % 7 == 0, "").otherwise("mean"))
    body = F.when(k % 11 == 0, F.array(F.lit("a"), F.lit("1"))).otherwise(F.array(F.lit("a"), F.lit("1"), F.lit("2")))
    cells = rows.where("table_id % 3 <> 0").select("table_id", F.lit(True).alias("head"), F.lit(0).alias("r"), F.posexplode(head).alias("c", "text"))
    cells = cells.unionByName(rows.where("table_id % 13 <> 0").select("table_id", F.lit(False).alias("head"), F.explode(F.array(F.lit(0), F.lit(1))).alias("r"), F.col("table_id").alias("k")).select("table_id", "head", "r", F.posexplode(F.when((F.col("r") == 1), body).otherwise(F.array(F.lit("a"), F.lit("1"), F.lit("2")))).alias("c", "text")))
    axis = F.when(k % 2 == 0, F.array(F.lit("First author / x"))).when(k % 5 == 0, F.array(F.lit("End-point"))).otherwise(F.array().cast("array<string>"))
    named = tables.names_studies(axis, F.when(k % 3 == 0, "Outcomes ").otherwise("other"))
    return tables.shape_complaints(cells, ["table_id"]).withColumn("names_studies", named)


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with empty rows, missing cells and line breaks, as tables and as lines of text; those of every third customer are dropped with a reason."""
    name = F.col("c_name")
    row = lambda *xs: F.array(*xs)
    null = F.lit(None).cast("string")
    grid = F.array(row(null, F.lit(" ")), row(F.lit("Name"), F.lit("seg\nment"), null), row(F.lit(""), null), row(name, F.col("c_mktsegment")))
    grids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_id"), F.when(F.col("c_custkey") % 4 == 0, F.array(row(name, F.lit("x")))).otherwise(grid).alias("grid"))
    text = tables.as_text(tables.cells_from_grid(grids), ["table_id"], " | ")
    return tables.keep_tables(text, text.where("table_id % 3 <> 0"), ["table_id"], "not selected")


def header_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms that the headers of each part's table imply."""
    k = F.col("p_partkey")
    heads = F.array(F.concat(F.lit("Events "), "p_brand"), F.lit("Total red (RD)"), F.concat(F.lit("n "), F.lower("p_brand")), F.when(k % 3 == 0, "events").otherwise("blue events"), F.lit("total green"), F.when(k % 2 == 0, "N Red").otherwise("size"))
    headers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.posexplode(heads).alias("pos", "header"))
    return tables.header_arms(headers, ["table_id"])


ALIASES = {"b12": ["brand#12", "twelve"], "b3": ["brand#3"]}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a review, which is a size: brands, with the case and spaces changed here and there, and words for everyone."""
    k = F.col("p_partkey")
    label = F.when(k % 9 == 0, " Overall").when(k % 10 == 0, "").when(k % 4 == 0, F.concat(F.lit("  "), F.upper("p_brand"))).when(k % 7 == 0, F.concat(F.lit("the "), "p_brand", F.lit(" arm"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("review"), k.alias("pos"), label.alias("label"))


def cohort_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cohorts.registry(_labels(spark, sf_dir), ALIASES)
    return found.select("review", "place", "key", "display", F.size("variants").cast("long").alias("wordings"), "source")


def cohort_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label against the cohorts that are discovered from plain brands."""
    known = cohorts.registry(_labels(spark, sf_dir).where("pos % 4 <> 0 and pos % 7 <> 0"))
    return cohorts.resolve(_labels(spark, sf_dir).withColumnRenamed("pos", "id"), known).groupBy("review", "status", "key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def comparison_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two brands set against each other in several ways of writing, and the tokens that tell the left one."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lower("p_brand"), F.lit("_vs_"), F.lower("p_type"))).when(k % 5 == 1, F.concat("p_brand", F.lit("  Versus "), "p_type")).when(k % 5 == 2, F.concat("p_brand", F.lit(" vs. a vs b"))).when(k % 5 == 3, F.lit("vs. x")).otherwise(F.concat("p_brand", F.lit(" 3 mg group - vs - the "), "p_type"))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey").select("p_partkey", cohorts.comparison(text).alias("c"))
    return rows.select("p_partkey", F.col("c.left").alias("left_side"), F.col("c.right").alias("right_side"), F.array_join(cohorts.telling_tokens(F.col("c.left")), " ").alias("tokens"))


def arm_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arms of each supplier's review against the arms that its paper names."""
    k = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier").select(k.alias("study"))
    s = F.col("study")
    ours = F.array(F.struct(F.lit("a").alias("arm"), F.lit("red dose").alias("label")), F.struct(F.lit("b").alias("arm"), F.lit("red plus blue").alias("label")), F.struct(F.lit("c").alias("arm"), F.when(s % 5 == 0, "unlike").otherwise("placebo").alias("label")))
    theirs = F.when(s % 3 == 0, F.array(F.lit("Red group (n=9)"), F.lit("red + blue plus"), F.lit("placebo arm"))).when(s % 3 == 1, F.array(F.lit("green"), F.lit("yellow"))).otherwise(F.array(F.lit("Red"), F.lit("red arm")))
    review = supplier.select("study", F.explode(ours).alias("x")).select("study", "x.*")
    paper = supplier.where("study % 7 <> 0").select("study", F.explode(theirs).alias("label"))
    return targets.assign_arms(review, paper)


def arm_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier's paper reports for three arms of its review, and for one that the review doesn't have."""
    s = F.col("study")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study"))
    ours = F.array(F.struct(F.lit("a").alias("arm"), F.lit("red dose").alias("label")), F.struct(F.lit("b").alias("arm"), F.lit("red plus blue").alias("label")), F.struct(F.lit("c").alias("arm"), F.when(s % 5 == 0, "unlike").otherwise("placebo").alias("label")))
    theirs = F.when(s % 3 == 0, F.array(F.lit("Red group (n=9)"), F.lit("red + blue plus"), F.lit("placebo arm"))).when(s % 3 == 1, F.array(F.lit("green"), F.lit("yellow"))).otherwise(F.array(F.lit("Red"), F.lit("red arm")))
    review = supplier.select("study", F.explode(ours).alias("x")).select("study", "x.*")
    arms = supplier.where("study % 7 <> 0").select("study", F.posexplode(theirs).alias("pos", "label"))
    value = F.when((s % 4 == 3) & (F.col("pos") == 1), None).otherwise((s * 3 + F.col("pos") + 10).cast("string"))
    quote = F.when(s % 2 == 0, F.concat_ws(" ", F.lit("red"), (s * 3 + 10 + (s % 4 == 2).cast("int")).cast("string"), F.lit("against red blue plus"), (s * 3 + 11 - (s % 4 == 2).cast("int")).cast("string"))).otherwise("")
    arms = arms.select("study", "pos", "label", value.alias("value"), F.lit("n").alias("unit"), quote.alias("quote"))
    requests = supplier.select(F.explode(F.array(*map(F.lit, "abcz"))).alias("target"), "study").select(F.concat_ws("|", F.col("study").cast("string"), "target").alias("id"), "study", "target", F.lit("").alias("quote"))
    return targets.resolve_arms(requests, review, arms).select("id", "status", "paper_label", "value", F.array_join("rivals", ",").alias("rivals"))


def value_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two values stand by the arms they are given to, in sentences of several orders."""
    k = F.col("c_custkey")
    one, two = (k % 90 + 10).cast("string"), (k % 700 + 200).cast("string")
    said = lambda *parts: F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x for x in parts))
    label = F.lower("c_mktsegment")
    text = F.when(k % 4 == 0, said(label, one, ", control", two)).when(k % 4 == 1, said(label, "and control had", one, "and", two)).when(k % 4 == 2, said("control", one, "but", label, two)).otherwise(said(one, label, two, "control"))
    claims = F.array(F.struct(label.alias("label"), one.alias("value")), F.struct(F.lit("control").alias("label"), two.alias("value")))
    rows = spread(table(spark, sf_dir, "customer").select(k, "c_mktsegment"), "c_custkey").select(k, F.upper(text).alias("text"), claims.alias("claims"))
    return targets.by_their_labels(rows, "text", "claims").select("c_custkey", "locality")


def cohort_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a paper calls an arm, against the arms of its review."""
    k = F.col("o_orderkey")
    claims = table(spark, sf_dir, "orders").select((k % 2).alias("review"), k.alias("id"), F.element_at(F.array(*map(F.lit, ("red", "blue", "all", "green"))), (k % 4 + 1).cast("int")).alias("target"), F.element_at(F.array(*map(F.lit, ("red arm", "Blue Ring", "", "purple", "red blue"))), (k % 5 + 1).cast("int")).alias("label"))
    known = spark.createDataFrame([(0, "red", ["red arm", "red"]), (0, "blue", ["blue ring"])], "review long, key string, variants array<string>")
    return cohorts.cohort_verdict(claims, known).groupBy("review", "target", "label", "verdict").agg(F.count("*").alias("n"))


def witness_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage of each document, written with other spaces and hyphens, against the windows that were sent of it; batches of ten documents are counted."""
    k = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    passage = F.regexp_replace(F.substring(text, 41, 60), " ", " -\n ")
    quote = F.when(k % 7 == 0, "zzqq wholly elsewhere qqzz").otherwise(passage)
    reach = F.when(k % 3 == 0, 30).otherwise(1 << 30)
    windows = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(0).alias("start"), reach.alias("end")))
    docs = table(spark, sf_dir, "documents").select("doc_id", anchoring.witness_outcome(text, quote, F.when(k % 11 == 0, "figure").otherwise("text"), windows).alias("outcome"), (k % 2 == 0).alias("windowed"), F.floor(k / 10).cast("long").alias("batch"))
    return anchoring.window_tally(docs, ["batch"])


def binding_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase and a value in documents that put them in one quote, near each other, far apart, or in different blocks."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    pad = F.when(k % 4 == 2, F.repeat(F.lit("filler text "), 60)).otherwise("")
    gap = F.when(k % 4 == 3, "\n \n").otherwise("  and ")
    document = F.concat(F.lit("Title.\n\nThe  treated-\npeople"), gap, pad, F.lit("numbered "), n, F.lit(" in all."))
    quote = F.when(k % 4 == 0, F.concat(F.lit("the treated-people and numbered "), n)).otherwise(F.concat(F.lit("numbered "), n, F.lit(" in")))
    rows = spread(table(spark, sf_dir, "orders").select(k), "o_orderkey").select((k % 4).alias("kind"), F.when(k % 9 == 0, "").when(k % 10 == 0, "absent").otherwise("treated-people").alias("phrase"), n.alias("value"), quote.alias("quote"), document.alias("document"))
    return anchoring.binding(rows, "phrase", "value", "quote", "document").groupBy("kind", "phrase", "binding").agg(F.count("*").alias("n"))


def interval_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were read of an effect whose sentence prints its interval, and a rival's."""
    k, p = F.col("l_partkey"), F.col("p")
    rows = table(spark, sf_dir, "lineitem").select((k % 6).alias("kind"), (k % 80 + 10).cast("int").alias("p")).distinct()
    value = F.concat(F.lit("0."), p.cast("string"))
    low, high = F.concat(F.lit("0."), (p - 5).cast("string")), F.concat(F.lit("1."), p.cast("string"))
    quote = F.concat(F.lit("ratio "), value, F.lit("; 95% CI, "), F.lpad(low, 4, "0"), F.lit(" to "), high, F.when(F.col("kind") == 5, "; 7.5 in the other").otherwise("."))
    number = lambda c: c.cast("double")
    none = F.lit(None).cast("double")
    claimed = F.struct(
        F.when(F.col("kind") == 1, 9.9).otherwise(none).alias("point"), F.when(F.col("kind").isin(0, 5), 95.0).when(F.col("kind") == 2, 90.0).otherwise(none).alias("level"),
        F.when(F.col("kind").isin(0, 3, 5), number(low)).otherwise(none).alias("lower"), F.when(F.col("kind").isin(0, 3, 5), number(high)).when(F.col("kind") == 4, number(value)).otherwise(none).alias("upper"),
    )
    made = rows.where("p >= 15").select("kind", "p", value.alias("value"), quote.alias("quote"), claimed.alias("claimed"), F.when(F.col("kind") == 5, F.array(F.lit("7.5"))).otherwise(F.array().cast("array<string>")).alias("rivals"))
    got = anchoring.checked_components(made, "claimed", "value", "quote", "rivals")
    own = anchoring.owned_interval(F.col("quote"), F.col("value"), F.col("rivals"))
    return got.select("kind", "p", "component_status", F.array_join("missing", ",").alias("missing"), anchoring.canonical_value(number(F.col("value")), own["level"], own["lower"], own["upper"]).alias("canonical"))


def evidence_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on ages of two arms whose evidence is good, of another arm, rounded, repeated, of another field, or far off."""
    k = F.col("o_orderkey")
    age = F.concat((k % 40 + 30).cast("string"), F.lit(".25"))
    filler = F.repeat(F.lit("words go on "), 30)
    quote = F.when(k % 8 == 2, F.concat(F.lit("was "), F.substring(age, 1, 4))).when(k % 8 == 3, F.concat(F.lit("was "), age, F.lit(" or "), age)).when(k % 8 == 4, "is not there").otherwise(F.concat(F.lit("was "), age))
    said = F.when(k % 8 == 2, F.substring(age, 1, 4)).otherwise(age)
    field = F.when(k % 8 == 5, F.lit("body mass")).when(k % 8 == 6, F.concat(F.lit("mean age "), filler)).otherwise("mean age")
    printed = F.when(k % 8 == 4, F.concat(F.lit("was "), age)).otherwise(quote)
    document = F.concat(F.lit("Intro on ages.\n\nIn the Blue arm all was well; in the Red arm "), field, F.lit(" at week 12 "), printed, F.lit(" years; the Blue arm followed.\n\nEnd"))
    rows = table(spark, sf_dir, "orders").select(
        (k % 8).alias("kind"), (k % 3).alias("arm"), document.alias("document"), F.when(k % 40 == 0, "metadata_only").when(k % 40 == 1, "unknown").otherwise("full_text").alias("scope"), quote.alias("quote"), said.alias("source_value"), age.alias("review_value"),
        F.array(F.lit("age"), F.lit("years of life")).alias("phrases"), F.when(k % 3 == 0, "all").otherwise("arm").alias("group"), F.when(k % 3 == 1, "Red arm").when(k % 3 == 2, "Blue arm").alias("label"), F.array(F.lit("Red arm"), F.lit("Blue arm")).alias("labels"),
        F.when(k % 8 == 7, "week 24").otherwise("week 12").alias("timepoint"), F.when(k % 5 == 0, "treated").alias("review_population"), F.when(k % 10 == 0, "randomised").otherwise("treated").alias("source_population"), F.lit(None).cast("string").alias("review_set"), F.lit(None).cast("string").alias("source_set"),
    )
    got = anchoring.adequacy_refusal(anchoring.adequacy(rows))
    return got.groupBy("kind", "arm", "scope", *(f"axis_{a}" for a in anchoring.AXES), "adequacy", "label", "review_required", "reason").agg(F.count("*").alias("n")).drop("label").withColumn("compared", ~F.col("review_required"))


QUERIES = {
    f.__name__: f
    for f in (captured_cells, header_paths, table_labels, shape_checks, table_text, header_arms, cohort_registry, cohort_resolution, comparison_targets, arm_assignment, arm_targets, value_locality, cohort_conflicts, witness_coverage, binding_verdicts, interval_owner, evidence_adequacy)
}

LABEL_SQL = "SELECT p_size AS review, p_partkey AS pos, CASE WHEN p_partkey % 9 = 0 THEN ' Overall' WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN concat('  ', upper(p_brand)) WHEN p_partkey % 7 = 0 THEN concat('the ', p_brand, ' arm') ELSE p_brand END AS label FROM part"
SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"

ORACLE_SQL = {
    "captured_cells": """WITH o AS (SELECT o_custkey AS d, o_orderpriority AS p, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) - 1 AS INTEGER) AS r FROM orders),
        b AS (SELECT d, false AS head, r, unnest([0, 1, 2]) AS c, unnest([p, k, s]) AS text FROM o UNION ALL SELECT d, true, h.r, h.c, h.t FROM (SELECT DISTINCT d FROM o), (VALUES (0, 0, 'Priority'), (0, 1, 'Order'), (0, 2, 'Order'), (1, 0, 'Priority'), (1, 1, 'key'), (1, 2, 'status')) h(r, c, t))
        SELECT d AS doc_id, CASE WHEN d % 2 = 0 THEN concat('T', d) ELSE 'table_1' END AS table_id, CASE WHEN d % 3 = 0 THEN 'Table 1. Orders' ELSE 'Table 1 Orders' END AS caption, head, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, text FROM b""",
    "header_paths": "SELECT p_partkey AS table_id, CAST(c AS INTEGER) AS c, CASE c WHEN 0 THEN 'Study' WHEN 1 THEN concat(p_brand, ' / n') WHEN 2 THEN concat(p_brand, ' / mean') ELSE CASE WHEN p_partkey % 2 = 0 THEN concat(p_brand, ' / ', p_type) ELSE p_type END END AS path FROM part, range(4) v(c)",
    "table_labels": """WITH l AS (SELECT l_orderkey AS table_id, CAST(l_linenumber AS INTEGER) AS r, min(struct_pack(p := l_partkey, y := CAST(year(l_shipdate) AS VARCHAR))) AS x FROM lineitem GROUP BY 1, 2)
        SELECT table_id, r, coalesce(last_value(CASE WHEN r % 3 = 1 THEN concat('part ', x.p) END IGNORE NULLS) OVER w, '') AS label, coalesce(last_value(CASE WHEN r % 2 = 1 THEN x.y END IGNORE NULLS) OVER w, '') AS year FROM l WINDOW w AS (PARTITION BY table_id ORDER BY r ROWS UNBOUNDED PRECEDING)""",
    "shape_checks": """WITH k AS (SELECT s_suppkey AS table_id, s_suppkey % 3 = 0 AS headless, s_suppkey % 13 = 0 AS bodyless FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 13 = 0)),
        c AS (SELECT table_id, 'no rows' AS complaint, NULL AS place FROM k WHERE bodyless UNION ALL SELECT table_id, 'no head', NULL FROM k WHERE headless UNION ALL SELECT table_id, 'ragged row', 1 FROM k WHERE NOT bodyless AND table_id % 11 = 0
          UNION ALL SELECT table_id, 'repeated column', 1 FROM k WHERE NOT headless AND table_id % 5 = 0 UNION ALL SELECT table_id, 'unnamed column', 2 FROM k WHERE NOT headless AND table_id % 7 = 0 UNION ALL SELECT table_id, 'unnamed column', i FROM k, (VALUES (0), (1), (2)) v(i) WHERE headless)
        SELECT table_id, complaint, CAST(place AS INTEGER) AS place, CASE WHEN table_id % 2 = 0 THEN true WHEN table_id % 5 = 0 THEN false ELSE table_id % 3 <> 0 END AS names_studies FROM c""",
    "table_text": "SELECT c_custkey AS table_id, concat('Name | seg ment | ', chr(10), c_name, ' | ', c_mktsegment, ' | ') AS text, CASE WHEN c_custkey % 3 = 0 THEN 'not selected' END AS dropped FROM customer WHERE c_custkey % 4 <> 0",
    "header_arms": """WITH h AS (SELECT p_partkey AS t, p_brand AS b FROM part),
        a AS (SELECT t, 0 AS o, 0 AS pos, b AS arm FROM h WHERE t % 3 <> 0 UNION ALL SELECT t, 0, 3, 'blue' FROM h WHERE t % 3 <> 0 UNION ALL SELECT t, 1, 1, 'RD' FROM h UNION ALL SELECT t, 1, 4, 'green' FROM h UNION ALL SELECT t, 2, 2, lower(b) FROM h WHERE t % 2 = 0 UNION ALL SELECT t, 2, 5, 'Red' FROM h WHERE t % 2 = 0),
        f AS (SELECT t, lower(arm) AS k, min(struct_pack(o, pos, arm)) AS x FROM a GROUP BY ALL)
        SELECT t AS table_id, CAST(row_number() OVER (PARTITION BY t ORDER BY x.o, x.pos) AS INTEGER) AS place, x.arm AS arm FROM f""",
    "cohort_registry": f"""WITH l AS (SELECT review, pos, trim(label) AS d, lower(trim(label)) AS n FROM ({LABEL_SQL})), k AS (SELECT *, CASE WHEN regexp_matches(n, '(^|[^a-z0-9])brand#12($|[^a-z0-9])') THEN 'b12' WHEN regexp_matches(n, '(^|[^a-z0-9])brand#3($|[^a-z0-9])') THEN 'b3' END AS a FROM l WHERE n NOT IN ('', 'overall')),
        w AS (SELECT review, coalesce(a, {SLUG.format("d")}) AS key, d, min(pos) AS pos, max(a) AS a FROM k GROUP BY ALL)
        SELECT review, CAST(row_number() OVER (PARTITION BY review ORDER BY min(pos)) AS INTEGER) AS place, key, arg_min(d, pos) AS display, count(*) AS wordings, CASE WHEN max(a) IS NULL THEN 'discovered' ELSE 'alias' END AS source FROM w GROUP BY review, key""",
    "cohort_resolution": f"""WITH l AS (SELECT review, pos AS id, label, lower(trim(label)) AS n FROM ({LABEL_SQL})), c AS (SELECT review, {SLUG.format("n")} AS key, n, min(id) AS pos FROM l WHERE id % 4 <> 0 AND id % 7 <> 0 AND n NOT IN ('', 'overall') GROUP BY ALL),
        m AS (SELECT l.review, l.id, arg_min(c.key, CASE WHEN l.n = c.n THEN -1 ELSE c.pos END) AS key, bool_or(l.n = c.n) AS exact FROM l JOIN c ON l.review = c.review AND l.n NOT IN ('', 'overall') AND (l.n = c.n OR l.n = concat('the ', c.n, ' arm')) GROUP BY ALL)
        SELECT l.review, CASE WHEN l.n IN ('', 'overall') THEN 'combined' WHEN m.exact THEN 'resolved' WHEN m.key IS NOT NULL THEN 'alias' ELSE 'unknown' END AS status, CASE WHEN l.n IN ('', 'overall') THEN 'all' ELSE coalesce(m.key, '') END AS key, count(*) AS n, min(l.id) AS first_id FROM l LEFT JOIN m USING (review, id) GROUP BY 1, 2, 3""",
    "comparison_targets": """WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(replace(p_brand, '_', ' ')) WHEN 1 THEN lower(p_brand) WHEN 4 THEN concat(lower(p_brand), ' 3 mg group') END AS l, CASE p_partkey % 5 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_type) WHEN 4 THEN concat('the ', lower(p_type)) END AS r FROM part)
        SELECT p_partkey, l AS left_side, r AS right_side, array_to_string(list_distinct_in_order, ' ') AS tokens FROM (SELECT *, CASE WHEN l IS NULL THEN [] ELSE list_filter(regexp_extract_all(l, '[a-z0-9]+'), lambda t: NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ('mg', 'group')) END AS list_distinct_in_order FROM s)""",
    "arm_assignment": """SELECT s_suppkey AS study, v.arm, v.label, NULL AS reason FROM supplier, (VALUES ('a', 'Red group (n=9)'), ('b', 'red + blue plus'), ('c', 'placebo arm')) v(arm, label) WHERE s_suppkey % 7 <> 0 AND s_suppkey % 3 = 0 AND NOT (v.arm = 'c' AND s_suppkey % 5 = 0)
        UNION ALL SELECT s_suppkey, NULL, NULL, CASE WHEN s_suppkey % 7 = 0 THEN 'nothing to assign' WHEN s_suppkey % 3 = 1 THEN 'no likeness' ELSE 'ambiguous' END FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 3 <> 0""",
    "arm_targets": """WITH r AS (SELECT s_suppkey AS k, v.t, v.i, v.l FROM supplier, (VALUES ('a', 0, 'Red group (n=9)'), ('b', 1, 'red + blue plus'), ('c', 2, 'placebo arm'), ('z', NULL, NULL)) v(t, i, l)),
        s AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'not_reported' WHEN t = 'z' THEN 'unsupported' WHEN k % 3 <> 0 THEN 'ambiguous' WHEN t = 'c' AND k % 5 = 0 THEN 'not_reported' WHEN k % 4 = 3 AND i = 1 THEN 'not_reported' WHEN k % 4 = 2 THEN 'inconsistent' ELSE 'ok' END AS status FROM r)
        SELECT concat(k, '|', t) AS id, status, CASE WHEN status IN ('ok', 'inconsistent') OR status = 'not_reported' AND k % 7 <> 0 AND k % 4 = 3 AND i = 1 THEN l END AS paper_label, CASE WHEN status = 'ok' THEN CAST(k * 3 + i + 10 AS VARCHAR) END AS value,
            CASE WHEN status = 'ok' THEN array_to_string(list_transform(list_filter([0, 1, 2], lambda j: j <> i AND NOT (k % 4 = 3 AND j = 1)), lambda j: CAST(k * 3 + j + 10 AS VARCHAR)), ',') END AS rivals FROM s""",
    "value_locality": """WITH t AS (SELECT c_custkey, lower(c_mktsegment) AS l, CAST(c_custkey % 90 + 10 AS VARCHAR) AS one, CAST(c_custkey % 700 + 200 AS VARCHAR) AS two FROM customer),
        x AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN concat_ws(' ', l, one, ', control', two) WHEN 1 THEN concat_ws(' ', l, 'and control had', one, 'and', two) WHEN 2 THEN concat_ws(' ', 'control', one, 'but', l, two) ELSE concat_ws(' ', one, l, two, 'control') END AS text FROM t),
        p AS (SELECT c_custkey, unnest([{'a': l, 'b': one, 'w': 'ii'}, {'a': 'control', 'b': two, 'w': 'ii'}, {'a': l, 'b': two, 'w': 'swap'}, {'a': 'control', 'b': one, 'w': 'swap'}]) AS q, text FROM x),
        d AS (SELECT c_custkey, q.w AS w, instr(text, q.a) - 1 AS s, instr(text, q.a) - 1 + length(q.a) AS e, instr(concat(' ', text, ' '), concat(' ', q.b, ' ')) - 1 AS v FROM p),
        g AS (SELECT c_custkey, sum(CASE WHEN v BETWEEN s AND e THEN 0 ELSE least(abs(v - s), abs(v - e)) END) FILTER (w = 'ii') AS mine, sum(CASE WHEN v BETWEEN s AND e THEN 0 ELSE least(abs(v - s), abs(v - e)) END) FILTER (w = 'swap') AS other FROM d GROUP BY c_custkey)
        SELECT c_custkey, CASE WHEN other < mine THEN 'other' WHEN other - mine < 4 THEN 'close' ELSE 'ok' END AS locality FROM g""",
    "cohort_conflicts": """WITH c AS (SELECT o_orderkey % 2 AS review, CASE o_orderkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'all' ELSE 'green' END AS target, CASE o_orderkey % 5 WHEN 0 THEN 'red arm' WHEN 1 THEN 'Blue Ring' WHEN 2 THEN '' WHEN 3 THEN 'purple' ELSE 'red blue' END AS label FROM orders)
        SELECT review, target, label, CASE WHEN review = 1 OR target = 'all' OR label = '' THEN 'ok' WHEN target = 'green' THEN 'ambiguous' WHEN label = 'purple' THEN 'ambiguous' WHEN label = 'red arm' THEN CASE WHEN target = 'red' THEN 'ok' ELSE 'wrong_cohort' END WHEN label = 'Blue Ring' THEN CASE WHEN target = 'blue' THEN 'ok' ELSE 'wrong_cohort' END
          ELSE CASE WHEN target = 'red' THEN 'ok' ELSE 'wrong_cohort' END END AS verdict, count(*) AS n FROM c GROUP BY ALL""",
    "witness_coverage": """WITH d AS (SELECT doc_id // 10 AS batch, doc_id % 2 = 0 AS windowed, CASE WHEN doc_id % 11 = 0 THEN 'non' WHEN doc_id % 7 = 0 OR regexp_replace(substr(coalesce(text, ''), 41, 60), '[\\s-]', '', 'g') = '' THEN 'lost' WHEN doc_id % 3 = 0 AND length(regexp_replace(substr(text, 41, 60), '[\\s-]', '', 'g')) > 30 THEN 'missed' ELSE 'covered' END AS o FROM documents),
        b AS (SELECT batch, bool_or(windowed) AS w, count(*) FILTER (o <> 'non') AS t, count(*) FILTER (o = 'lost') AS l, count(*) FILTER (o = 'missed') AS m FROM d GROUP BY batch)
        SELECT count(*) FILTER (w) AS windowed, count(*) FILTER (t > 0 AND l = 0) AS assessable, count(*) FILTER (t > 0 AND l = 0 AND m = 0) AS covered, count(*) FILTER (t > 0 AND l = 0 AND m > 0) AS missing, count(*) FILTER (t > 0 AND l > 0) AS unlocatable FROM b""",
    "binding_verdicts": "SELECT o_orderkey % 4 AS kind, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 10 = 0 THEN 'absent' ELSE 'treated-people' END AS phrase, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 10 = 0 THEN 'unbound' WHEN o_orderkey % 4 = 0 THEN 'same_quote' WHEN o_orderkey % 4 = 1 THEN 'same_block' ELSE 'unbound' END AS binding, count(*) AS n FROM orders GROUP BY ALL",
    "interval_owner": """WITH r AS (SELECT DISTINCT l_partkey % 6 AS kind, CAST(l_partkey % 80 + 10 AS INTEGER) AS p FROM lineitem WHERE l_partkey % 80 + 10 >= 15), t AS (SELECT *, CASE WHEN p % 10 = 0 THEN p // 10 ELSE p END AS q, CASE WHEN (p - 5) % 10 = 0 THEN (p - 5) // 10 ELSE p - 5 END AS s FROM r)
        SELECT kind, p, CASE WHEN kind IN (1, 2) THEN 'protocol_error' WHEN kind = 4 THEN 'protocol_error' WHEN kind = 3 THEN 'incomplete' ELSE 'ok' END AS component_status, CASE WHEN kind = 3 THEN 'level' ELSE '' END AS missing,
        concat('0.', q, ' (95% CI 0.', s, '-1.', q, ')') AS canonical FROM t""",
    "evidence_adequacy": """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 8 AS kind, o_orderkey % 3 AS arm, CASE o_orderkey % 40 WHEN 0 THEN 'metadata_only' WHEN 1 THEN 'unknown' ELSE 'full_text' END AS scope FROM orders),
        a AS (SELECT *, CASE kind WHEN 2 THEN 'FAIL' WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN 'FAIL' ELSE 'PASS' END AS v, CASE kind WHEN 5 THEN 'FAIL' WHEN 4 THEN 'FAIL' WHEN 3 THEN 'UNKNOWN' WHEN 6 THEN 'UNKNOWN' ELSE 'PASS' END AS f,
          CASE WHEN arm = 0 THEN 'NOT_REQUIRED' WHEN kind IN (3, 4) THEN 'UNKNOWN' WHEN arm = 1 THEN 'PASS' ELSE 'FAIL' END AS t, CASE WHEN k % 5 <> 0 THEN 'NOT_REQUIRED' WHEN k % 10 = 0 THEN 'FAIL' ELSE 'PASS' END AS p, CASE WHEN kind IN (4, 7) THEN 'UNKNOWN' ELSE 'PASS' END AS w FROM k),
        s AS (SELECT kind, arm, scope, CASE scope WHEN 'metadata_only' THEN 'NOT_REQUIRED' WHEN 'unknown' THEN 'UNKNOWN' ELSE v END AS v, CASE scope WHEN 'metadata_only' THEN 'NOT_REQUIRED' WHEN 'unknown' THEN 'UNKNOWN' ELSE f END AS f, CASE WHEN t = 'NOT_REQUIRED' OR scope = 'metadata_only' THEN 'NOT_REQUIRED' WHEN scope = 'unknown' THEN 'UNKNOWN' ELSE t END AS t,
          CASE WHEN p = 'NOT_REQUIRED' OR scope = 'metadata_only' THEN 'NOT_REQUIRED' WHEN scope = 'unknown' THEN 'UNKNOWN' ELSE p END AS p, CASE scope WHEN 'metadata_only' THEN 'NOT_REQUIRED' WHEN 'unknown' THEN 'UNKNOWN' ELSE w END AS w FROM a),
        d AS (SELECT *, CASE WHEN scope = 'metadata_only' THEN 'insufficient' WHEN list_contains([v, f, t, p, w], 'FAIL') THEN 'insufficient' WHEN list_contains([v, f, t, p, w], 'UNKNOWN') THEN 'unknown' ELSE 'sufficient' END AS adequacy FROM s)
        SELECT kind, arm, scope, v AS axis_value, f AS axis_field, t AS axis_target, p AS axis_population, w AS axis_timepoint, 'NOT_REQUIRED' AS axis_analysis_set, adequacy, adequacy <> 'sufficient' AS review_required, adequacy = 'sufficient' AS compared,
          CASE WHEN adequacy <> 'sufficient' THEN concat('evidence ', adequacy, ': ', concat_ws(', ', CASE WHEN v IN ('FAIL', 'UNKNOWN') THEN concat('value=', lower(v)) END, CASE WHEN f IN ('FAIL', 'UNKNOWN') THEN concat('field=', lower(f)) END, CASE WHEN t IN ('FAIL', 'UNKNOWN') THEN concat('target=', lower(t)) END, CASE WHEN p IN ('FAIL', 'UNKNOWN') THEN concat('population=', lower(p)) END, CASE WHEN w IN ('FAIL', 'UNKNOWN') THEN concat('timepoint=', lower(w)) END)) END AS reason, count(*) AS n FROM d GROUP BY ALL""",
}
