"""Queries over knowledge, references, studies, checklists, totals, forest plots and sections. Inputs are made from the tables by integer arithmetic, so that both engines make the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import checklist, forest, identity, knowledge, references, sections, totals
from auditlake.sources.tables import table


def _pick(i: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))


def kb_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names of parts' concepts mean: some are one concept's, some are shared and told apart by modality or unit."""
    k = F.col("p_partkey")
    asked = table(spark, sf_dir, "part").select(k.alias("id"), _pick(k, "Mass-x", "vol", "Size", "nothing", "V O L").alias("name"), _pick(k, "cc", "mm", "", "ML").alias("unit"), _pick(k, "by MRI scan", "", "ct").alias("modality"))
    names = spark.createDataFrame([("mass_x", "mass x", "kg"), ("vol_mri", "vol", "cm3"), ("vol_ct", "vol", "l"), ("size_a", "size", "mm"), ("size_b", "size", "mm")], "field_type string, name string, default_unit string")
    rules = spark.createDataFrame([("vol_ct", 1, "mri", "vol_mri"), ("vol_mri", 1, "mri", "vol_mri"), ("size_a", 1, "ct", "elsewhere")], "field_type string, pos int, signal string, target string")
    return knowledge.resolve_names(asked, names, rules)


def kb_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional entries that three or more users' events agree on are promoted."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("field_type"), (F.col("user_id") % 7).alias("run")).where("run < 4")
    k = F.col("id")
    entries = spark.range(60).select(F.concat(F.lit("f"), k.cast("string")).alias("field_type"), F.when(k % 3 == 0, "authoritative").otherwise("provisional").alias("status"), F.when(k % 2 == 0, "seed").alias("citation"))
    return knowledge.promote(entries, knowledge.agreed_runs(events, ["field_type"], "run"))


def knowledge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of customers' entries as one: stated fields of the later one, synonyms of both."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    seed = rows.where(k % 3 != 0).select(k.alias("field_type"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("concept"), F.lit("cohort").alias("scope"), F.array(F.lit("a"), F.col("c_mktsegment")).alias("synonyms"))
    later = rows.where(k % 5 != 0).select(k.alias("field_type"), F.when(k % 7 < 4, F.upper(F.substring("c_mktsegment", 1, 4))).alias("concept"), F.when(k % 4 == 0, "study").alias("scope"), F.array(F.lit("b"), F.lit("a")).alias("synonyms"))
    out = knowledge.merge(seed, later, ["concept", "scope"])
    return out.select("field_type", "concept", "scope", F.array_join("synonyms", ",").alias("synonyms"), "status", "change", F.array_join("conflicts", ",").alias("conflicts"))


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight entries most like each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query"), "vector")
    return knowledge.most_similar(asked, vectors, 8).select("query", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations against candidates with the same title or none of its letters, other authors, years next to each other, and abbreviated journals."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        (k % 60).alias("kind"), F.lit("On the sum").alias("title"), F.array(F.lit("Berg A"), F.lit("Tal, B")).alias("authors"), (F.lit(2000) + k % 3).cast("int").alias("year"), _pick(k, "J Clin Sums", "", "Ann Math").alias("journal"),
        F.when(k % 2 == 0, "ON THE SUM").otherwise("xyz vkq").alias("c_title"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Berg Anna"), F.lit("Zorn Q"))).alias("c_authors"), (F.lit(2000) + k % 4).cast("int").alias("c_year"), _pick(k, "Journal of Clinical Sums", "x").alias("c_journal"),
    )
    judged = references.gate(rows.where("kind % 3 < 2").distinct())
    return judged.select("kind", "year", "c_year", "journal", "c_journal", F.size("c_authors").alias("n_authors"), "fits", (F.col("score") >= 0.72).alias("alike"), "accepted")


def reference_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles once what differs by source is gone, authors by surname and initial, and how sure a record is."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), _pick(k, "<i>On</i> the β-sum &amp; more.", "Sums – a survey", "").alias("a"), _pick(k, "on the beta-sum & more", "Sums - a survey", "x").alias("b"), _pick(k, "Berg A", "A Berg", "Berg, Anna", "Berg").alias("one"), _pick(k, "Berg Anna", "Berg B", "Zuk C").alias("two"), (k % 2 == 0).alias("by_doi"), F.when(k % 5 > 0, 2000 + k % 2).alias("y"))
    share = references.author_share(rows.select("id", F.array("one").alias("authors"), F.array("two").alias("others")), "authors", "others", "id")
    title = references.title_likeness(references.title_key(F.col("a")), references.title_key(F.col("b")))
    out = rows.withColumn("title", title).join(share, "id")
    return out.select("id", F.round("title", 6).alias("title"), "author_share", F.round(references.verification(F.col("title"), F.col("author_share"), F.col("y"), F.lit(2001), F.col("by_doi")), 6).alias("confidence"), references.citation_journal(F.concat(F.lit("Berg A et al. Ann. Sums. "), (2000 + F.col("id") % 9).cast("string"), F.lit(";1:2"))).alias("journal"))


def local_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to files by DOI, PMID, title or study name, some of which several files have."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    long = lambda n: F.concat(F.lit("A long title on part "), n.cast("string"), F.lit("."))
    refs = parts.select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("doi:10.1/"), k.cast("string"))).alias("doi"), F.when(k % 4 == 1, (k + 100_000).cast("string")).alias("pmid"), F.when(k % 4 == 2, long(k)).when(k % 4 == 3, F.concat(F.lit("Part "), k.cast("string"))).alias("title"))
    files = parts.where(k % 5 != 0).select(F.explode(F.when(k % 7 == 0, F.array(k * 2, k * 2 + 1)).otherwise(F.array(k * 2))).alias("record"), F.concat(F.lit("10.1/"), k.cast("string")).alias("doi"), (k + 100_000).cast("string").alias("pmid"), F.upper(long(k)).alias("title"), F.concat(F.lit("part_"), k.cast("string")).alias("name"))
    return references.local_papers(refs, files)


def study_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names of citations, of which many have the same surname and year."""
    k = F.col("c_custkey")
    name = _pick(k, "Ünal", "van der Berg", "Løken", "et al")
    cite = F.concat(name, F.lit(" A et al. ["), (2000 + k % 30).cast("string"), F.lit("]"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 11 == 0, "  ").otherwise(cite).alias("citation"))
    out = identity.study_slugs(rows, "citation", ["id"])
    parts = identity.slug_parts(F.col("slug"))
    return out.select("id", "slug", parts["surname"].alias("surname"), parts["year"].alias("year"), identity.row_key(F.substring_index("citation", "[", 1), F.substring_index("citation", "[", -1)).alias("row_key"))


def study_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that name suppliers in their own words, with the suppliers' ids, and how many claims each has; those of unknown ones keep their words."""
    k = F.col("s_suppkey")
    studies = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string"), F.lit("_2001")).alias("study_id"), F.concat(F.lit("Supp"), k.cast("string"), F.lit("x and others 2001")).alias("label"))
    claims = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(F.lit("Supp"), k.cast("string"), F.lit("x et al. 2001")), F.concat(F.lit("Supp"), k.cast("string"), F.lit("x 1999")), F.concat(F.lit("S"), k.cast("string"), F.lit("_2001")))).alias("study_id"))
    return identity.relabelled(claims, studies).groupBy("study_id", "resolved").agg(F.count("*").alias("claims"))


def uncited_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("study_id"))
    cited = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 29).alias("study_id"))
    return identity.uncited(orders, cited)


ITEMS = [
    ("age", 1, "per_study", "value", True, ["age"], ["years of age"], None), ("sd", 2, "per_study", "value", False, ["age"], None, ["sd"]), ("n", 3, "per_cohort", "value", True, None, ["arm size", "n total"], None),
    ("any", 4, "review", "value", True, None, ["arm size"], None), ("flow", 5, "review", "presence", True, None, ["flow chart"], None), ("none", 6, "per_study", "value", False, ["absent"], None, None),
]


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, s = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("claim"), F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("s"), (s % 50).cast("string"))).alias("study_id"), _pick(k, "red", "-", "blue").alias("group"), F.when(s % 50 < 20, "age").otherwise(_pick(k, "other_type", "size")).alias("field_type"),
        F.when((s % 50 == 30) & (k % 2 == 0), "Arm-size, all").otherwise("x").alias("raw_name"), F.lit(None).cast("string").alias("header"), F.when(s % 50 < 10, "5 ± 1").when(s % 50 == 11, "").otherwise("5").alias("value"),
    )
    items = spark.createDataFrame(ITEMS, "item string, pos int, scope string, kind string, required boolean, field_types array<string>, aliases array<string>, parts array<string>")
    return rows, items


def checklist_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.coverage(*_claims(spark, sf_dir))


def checklist_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.gaps(*_claims(spark, sf_dir))


def checklist_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, items = _claims(spark, sf_dir)
    return checklist.owners(claims, items).groupBy("checklist_id").agg(F.count("*").alias("claims"), F.min("claim").alias("first_claim"))


def chosen_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on totals against three sets of counts of each study, some of them broken or of another population or moment."""
    k = F.col("o_orderkey")
    claims = table(spark, sf_dir, "orders").select(k.alias("claim"), F.when(k % 50 == 49, -1).otherwise(k % 6).alias("study"), F.when(k % 13 == 0, "arm").otherwise("study").alias("shape"), F.when(k % 17 == 0, "age").otherwise("sample_size").alias("field_type"), F.when(k % 7 != 0, _pick(k, "allocated", "treated")).alias("basis"), F.lit(None).cast("string").alias("analysis"), F.when(k % 5 == 0, "Week 12").alias("timepoint"))
    rows = [
        (0, 1, "allocated", None, "week-12", False), (0, 2, "treated", None, "week 24", False), (1, 3, "allocated", None, None, False), (1, 4, "allocated", None, None, False), (2, 5, "treated", None, "week 12", True), (2, 6, "allocated", None, "week 12.", False),
        (3, 7, "treated", None, "week 12", False), (4, 8, None, None, "week 12", True), (4, 9, "allocated", None, "week 12", False),
    ]
    sets = spark.createDataFrame(rows, "study long, `set` int, basis string, analysis string, timepoint string, broken boolean")
    out = totals.choose_set(claims, sets, ["sample_size"])
    axes = totals.effective_axes(F.col("shape"), F.col("field_type"), F.array(F.lit("timepoint")), F.array(F.lit("analysis_set")), ["study"], ["sample_size"], ["population_basis"])
    return out.join(claims.select("claim", "study", F.array_join(axes, ",").alias("axes")), "claim").groupBy("study", "set", "reason", "aside", "axes").agg(F.count("*").alias("n"))


def printed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed totals of orders' quantities beside their sums."""
    q = F.col("l_quantity").cast("long")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q).alias("s"))
    k, s = F.col("l_orderkey"), F.col("s")
    made = sums.select("l_orderkey", totals.total_of(F.when(k % 4 == 0, s).when(k % 4 == 1, s + 1), F.when(k % 3 > 0, s)).alias("t"))
    return made.select("l_orderkey", F.col("t.total").alias("total"), F.col("t.status").alias("status"))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest table for each supplier: studies with events and totals of two arms, and a row of totals."""
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    rows = F.array(
        F.array(F.lit("Study"), F.lit("red Events"), F.lit("red  Total"), F.lit("blue events"), F.lit("Weight")), F.array(F.lit("Berg 2001"), s(k % 50), s(k + 9), F.lit("-"), F.lit("9%")), F.array(F.lit("Tal 2002"), s(k % 7), F.lit("10"), F.lit("x"), F.lit("8%")),
        F.array(F.when(k % 4 == 0, "All").otherwise("Total (95% CI)"), s(k % 50 + k % 7 + F.when(k % 3 == 0, 1).otherwise(0)), s(k + 19), F.lit(""), F.lit("100%")),
    )
    held = table(spark, sf_dir, "supplier").select(k.alias("table_id"), F.posexplode(rows).alias("i", "row"))
    return held.select("table_id", (F.col("i") == 0).alias("head"), F.greatest(F.col("i") - 1, F.lit(0)).alias("r"), F.posexplode("row").alias("c", "text"))


def forest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.checksums(_forest(spark, sf_dir), ["table_id"])


def forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.long_rows(_forest(spark, sf_dir), ["table_id"])


def core_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text put into sections under marks, under bare headings, or as it is; what is kept of it, and what windows of it are read."""
    k, body = F.col("doc_id"), F.col("body")
    marked = F.concat(F.lit("Title\n## Introduction\n"), body, F.lit("\n## Methods and more\n"), body, F.lit("\n## Discussion of results\n"), body, F.lit("\n## Results\n"), body)
    bare = F.concat(F.lit("title\nIntroduction\n"), body, F.lit("\n2. Methods:\n"), body, F.lit("\nResults\n"), body, F.lit("\nReferences\n"), body)
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 < 2").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", "").alias("body"))
    docs = docs.select("doc_id", F.when(k % 3 == 0, marked).otherwise(bare).alias("text"))
    core, seen = sections.core_text(F.col("text")), sections.windows(F.col("text"))
    read = docs.select("doc_id", core.alias("core"), F.length(seen["front"]).alias("front"), F.length(seen["results"]).alias("results"))
    return read.select("doc_id", "core.filtered", F.length("core.text").alias("size"), "front", "results")


QUERIES = {
    f.__name__: f
    for f in (kb_resolve, kb_promotion, knowledge_merge, embedding_topk, citation_gate, reference_checks, local_papers, study_slugs, study_relabel, uncited_studies, checklist_coverage, checklist_gaps, checklist_owners, chosen_sets, printed_totals, forest_states, forest_rows, core_sections)
}


def _among(i: str, *values: str | None) -> str:
    return f"CASE {i} % {len(values)} " + " ".join(f"WHEN {n} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for n, v in enumerate(values)) + " END"


CLAIM_SQL = f"""WITH c AS (SELECT o_orderkey AS claim, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('s', o_custkey % 50) END AS study_id, {_among("o_orderkey", "red", "-", "blue")} AS grp, o_custkey % 50 < 20 AS age, o_custkey % 50 < 10 AS sd, o_custkey % 50 <> 11 AS has, o_custkey % 50 = 30 AND o_orderkey % 2 = 0 AS arm FROM orders),
m AS (SELECT claim, study_id, grp, v.item, v.pos FROM c, (VALUES ('age', 1), ('sd', 2), ('n', 3), ('any', 4)) v(item, pos) WHERE has AND CASE item WHEN 'age' THEN age WHEN 'sd' THEN age AND sd ELSE arm END)"""

ORACLE_SQL = {
    "kb_resolve": f"""WITH a AS (SELECT p_partkey AS id, p_partkey % 5 AS n, {_among("p_partkey", "cc", "mm", "", "ML")} AS unit, p_partkey % 3 AS m FROM part)
        SELECT id, CASE WHEN n = 0 THEN 'mass_x' WHEN n IN (1, 4) THEN CASE WHEN m = 0 OR unit IN ('cc', 'ML') THEN 'vol_mri' END END AS field_type, CASE WHEN n = 0 THEN 'only' WHEN n = 3 THEN 'unknown' WHEN n IN (1, 4) THEN CASE WHEN m = 0 THEN 'modality' WHEN unit IN ('cc', 'ML') THEN 'unit' ELSE 'ambiguous' END ELSE 'ambiguous' END AS how FROM a""",
    "kb_promotion": """WITH v AS (SELECT concat('f', event_id % 40) AS field_type, count(DISTINCT user_id % 7) AS runs FROM events WHERE user_id % 7 < 4 GROUP BY 1)
        SELECT concat('f', k) AS field_type, CASE WHEN k % 3 = 0 OR runs >= 3 THEN 'authoritative' ELSE 'provisional' END AS status, CASE WHEN k % 3 <> 0 AND runs >= 3 THEN concat(CASE WHEN k % 2 = 0 THEN 'seed | ' ELSE '' END, 'promoted (repeated agreement (x', runs, '))') WHEN k % 2 = 0 THEN 'seed' END AS citation FROM range(60) r(k) LEFT JOIN v ON v.field_type = concat('f', k)""",
    "knowledge_merge": """WITH r AS (SELECT c_custkey AS k, c_mktsegment AS m, c_custkey % 3 <> 0 AS s, c_custkey % 5 <> 0 AS l FROM customer), f AS (SELECT *, CASE WHEN s AND k % 2 = 0 THEN m END AS c1, CASE WHEN l AND k % 7 < 4 THEN upper(substr(m, 1, 4)) END AS c2, CASE WHEN l AND k % 4 = 0 THEN 'study' END AS s2 FROM r WHERE s OR l)
        SELECT k AS field_type, coalesce(c2, c1) AS concept, coalesce(s2, CASE WHEN s THEN 'cohort' END) AS scope, CASE WHEN s AND l THEN concat('a,', m, ',b') WHEN s THEN concat('a,', m) ELSE 'b,a' END AS synonyms, CASE WHEN l THEN 'authoritative' ELSE 'provisional' END AS status, CASE WHEN s AND l THEN 'merged' WHEN s THEN 'kept' ELSE 'added' END AS change,
          concat_ws(',', CASE WHEN c1 <> c2 THEN 'concept' END, CASE WHEN s AND s2 IS NOT NULL THEN 'scope' END) AS conflicts FROM f""",
    "embedding_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.id AS query, e.id, coalesce(list_dot_product(q.v, e.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)), 0), 0) AS score FROM v q, v e WHERE q.id % 50 = 0)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 8""",
    "citation_gate": f"""WITH r AS (SELECT DISTINCT o_orderkey % 60 AS kind, CAST(2000 + o_orderkey % 3 AS INTEGER) AS year, CAST(2000 + o_orderkey % 4 AS INTEGER) AS c_year, {_among("o_orderkey", "J Clin Sums", "", "Ann Math")} AS journal, {_among("o_orderkey", "Journal of Clinical Sums", "x")} AS c_journal, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS n_authors FROM orders WHERE o_orderkey % 60 % 3 < 2),
        s AS (SELECT *, kind % 2 = 0 AS t, journal = '' OR (journal = 'J Clin Sums' AND c_journal <> 'x') AS j, CASE WHEN year = c_year THEN 1 WHEN abs(year - c_year) = 1 THEN 0.5 ELSE 0 END AS y FROM r),
        n AS (SELECT *, (0.6 * t::INT + CASE WHEN n_authors = 2 THEN 0.1 ELSE 0 END + 0.1 * y + CASE WHEN journal <> '' AND c_journal <> 'x' THEN 0.1 * 0.6 ELSE 0 END) / (0.7 + CASE WHEN n_authors = 2 THEN 0.2 ELSE 0 END + CASE WHEN journal <> '' THEN 0.1 ELSE 0 END) AS score FROM s)
        SELECT kind, year, c_year, journal, c_journal, CAST(n_authors AS INTEGER) AS n_authors, year = c_year AND j AS fits, score >= 0.72 AS alike, year = c_year AND j AND score >= 0.72 AS accepted FROM n""",
    "reference_checks": """WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 2 THEN 0.0 ELSE 1.0 END AS title, CASE WHEN s_suppkey % 3 = 2 THEN 0.0 WHEN s_suppkey % 3 = 0 THEN 1.0 WHEN s_suppkey % 4 = 3 THEN 1.0 ELSE 0.0 END AS a, CASE WHEN s_suppkey % 5 > 0 THEN 2000 + s_suppkey % 2 END AS y FROM supplier)
        SELECT id, title::DOUBLE AS title, a::DOUBLE AS author_share, round(CASE WHEN id % 2 = 0 THEN 0.25 + title * 0.35 + a * 0.25 + CASE WHEN y IS NULL THEN 0.08 WHEN y = 2001 THEN 0.15 ELSE 0 END ELSE title * 0.5 + a * 0.3 + CASE WHEN y IS NULL THEN 0.1 WHEN y = 2001 THEN 0.2 ELSE 0 END END, 6)::DOUBLE AS confidence, 'Ann. Sums' AS journal FROM r""",
    "local_papers": """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_partkey * 2 END AS record, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE concat(CASE WHEN p_partkey % 7 = 0 THEN 'ambiguous ' ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'pmid' WHEN 2 THEN 'title' ELSE 'name' END) END AS found_by FROM part""",
    "study_slugs": f"""WITH r AS (SELECT c_custkey AS id, c_custkey % 11 = 0 AS blank, {_among("c_custkey", "unal", "vanderberg", "loken", None)} AS s, 2000 + c_custkey % 30 AS y, {_among("c_custkey", "Ünal", "van der Berg", "Løken", "et al")} AS n FROM customer),
        b AS (SELECT *, CASE WHEN blank THEN 'study' WHEN s IS NULL THEN CAST(y AS VARCHAR) ELSE concat(s, '_', y) END AS base FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS i FROM b)
        SELECT id, CASE WHEN i = 1 OR i > 26 THEN base ELSE concat(base, '_', chr(CAST(96 + i AS INTEGER))) END AS slug, CASE WHEN blank THEN CASE WHEN i = 1 OR i > 26 THEN 'study' ELSE concat('study', chr(CAST(96 + i AS INTEGER))) END WHEN s IS NULL THEN CASE WHEN i = 1 OR i > 26 THEN base ELSE concat(base, chr(CAST(96 + i AS INTEGER))) END ELSE s END AS surname, CASE WHEN blank THEN '' ELSE CAST(y AS VARCHAR) END AS year,
          CASE WHEN blank THEN 'study' ELSE concat(n, ' A et al. ', y) END AS row_key FROM k""",
    "study_relabel": """SELECT concat('s', s_suppkey, '_2001') AS study_id, true AS resolved, CAST(2 AS BIGINT) AS claims FROM supplier UNION ALL SELECT concat('Supp', s_suppkey, 'x 1999'), false, 1 FROM supplier""",
    "uncited_studies": "SELECT o_custkey % 40 AS study_id, count(*) AS claims FROM orders WHERE o_custkey % 40 NOT IN (SELECT c_custkey % 29 FROM customer) GROUP BY 1",
    "checklist_coverage": CLAIM_SQL + """, i AS (SELECT * FROM (VALUES ('age', 'per_study', true), ('sd', 'per_study', false), ('n', 'per_cohort', true), ('any', 'review', true), ('flow', 'review', true), ('none', 'per_study', false)) v(item, scope, required)),
        t AS (SELECT 'review' AS scope, '' AS s, '' AS g UNION ALL SELECT DISTINCT 'per_study', study_id, '' FROM c WHERE study_id <> '' UNION ALL SELECT DISTINCT 'per_cohort', study_id, grp FROM c WHERE study_id <> '' AND grp <> '-'),
        h AS (SELECT DISTINCT i.item, CASE WHEN scope = 'review' THEN '' ELSE study_id END AS s, CASE WHEN scope = 'per_cohort' THEN grp ELSE '' END AS g FROM m JOIN i USING (item)),
        e AS (SELECT i.item, i.scope, required, count(t.s) AS expected, count(h.item) AS found FROM i LEFT JOIN t USING (scope) LEFT JOIN h ON h.item = i.item AND h.s = t.s AND h.g = t.g GROUP BY ALL)
        SELECT *, CASE WHEN expected = 0 THEN 'not_applicable' WHEN found = expected THEN 'covered' WHEN found > 0 THEN 'partial' WHEN required THEN 'missing_required' ELSE 'missing_optional' END AS status FROM e""",
    "checklist_gaps": CLAIM_SQL + " SELECT DISTINCT 'age' AS item, study_id FROM c WHERE study_id <> '' AND study_id NOT IN (SELECT study_id FROM m WHERE item = 'age')",
    "checklist_owners": CLAIM_SQL + ", o AS (SELECT claim, arg_min(item, pos) AS item FROM m GROUP BY claim) SELECT o.item AS checklist_id, count(*) AS claims, min(c.claim) AS first_claim FROM c LEFT JOIN o USING (claim) GROUP BY 1",
    "chosen_sets": f"""WITH c AS (SELECT o_orderkey AS claim, CASE WHEN o_orderkey % 50 = 49 THEN -1 ELSE o_orderkey % 6 END AS study, o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS ok, CASE WHEN o_orderkey % 7 <> 0 THEN {_among("o_orderkey", "allocated", "treated")} END AS b, o_orderkey % 5 = 0 AS t FROM orders),
        s(study, st, basis, tp, broken) AS (VALUES (0, 1, 'allocated', 'week 12', false), (0, 2, 'treated', 'week 24', false), (1, 3, 'allocated', NULL, false), (1, 4, 'allocated', NULL, false), (2, 5, 'treated', 'week 12', true), (2, 6, 'allocated', 'week 12', false), (3, 7, 'treated', 'week 12', false), (4, 8, NULL, 'week 12', true), (4, 9, 'allocated', 'week 12', false)),
        m AS (SELECT claim, count(*) FILTER (broken AND NOT other AND NOT moved) AS blocking, count(*) FILTER (broken AND (other OR moved)) AS aside, count(*) FILTER (NOT broken) AS offered, count(*) FILTER (NOT broken AND same AND silent) AS untimed, count(*) FILTER (NOT broken AND same) AS fitting, count(*) FILTER (NOT broken AND same AND NOT moved) AS lft, min(st) FILTER (NOT broken AND same AND NOT moved) AS chosen
          FROM (SELECT claim, st, broken, coalesce(b <> basis, false) AS other, coalesce(b = basis, false) AS same, t AND tp IS NULL AS silent, t AND tp IS NOT NULL AND tp <> 'week 12' AS moved FROM c JOIN s USING (study)) GROUP BY claim),
        r AS (SELECT c.study, chosen, coalesce(aside, 0) AS aside, CASE WHEN ok THEN 'analysis_set,population_basis,timepoint' ELSE 'timepoint' END AS axes, CASE WHEN NOT ok THEN 'not_permitted' WHEN blocking > 0 THEN 'broken_set' WHEN coalesce(offered, 0) = 0 THEN 'nothing_offered' WHEN b IS NULL THEN 'population_not_named' WHEN untimed > 0 THEN 'set_without_timepoint' WHEN fitting > 0 AND lft = 0 THEN 'other_timepoint' WHEN lft = 0 THEN 'no_fitting_population' WHEN lft > 1 THEN 'several_sets' END AS reason FROM c LEFT JOIN m USING (claim))
        SELECT study, CASE WHEN reason IS NULL THEN CAST(chosen AS INTEGER) END AS "set", reason, aside, axes, count(*) AS n FROM r GROUP BY ALL""",
    "printed_totals": """WITH s AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1)
        SELECT k AS l_orderkey, CASE WHEN k % 4 = 1 AND k % 3 > 0 THEN NULL WHEN k % 4 = 0 THEN s WHEN k % 4 = 1 THEN s + 1 WHEN k % 3 > 0 THEN s END AS total, CASE WHEN k % 4 = 1 AND k % 3 > 0 THEN 'contradictory' WHEN k % 4 < 2 THEN 'ok' WHEN k % 3 > 0 THEN 'derived' ELSE 'not_reported' END AS status FROM s""",
    "forest_states": """SELECT s_suppkey AS table_id, CAST(v.c AS INTEGER) AS c, v.path, v.f AS field_type, CASE c WHEN 1 THEN s_suppkey % 50 + s_suppkey % 7 + CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 50 + s_suppkey % 7 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END WHEN 2 THEN s_suppkey + 19 + CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 19 ELSE 0 END END AS column_sum,
        CASE WHEN c = 3 THEN 'missing' WHEN s_suppkey % 4 = 0 THEN 'unchecked' WHEN c = 1 AND s_suppkey % 3 = 0 AND s_suppkey % 50 + s_suppkey % 7 <> s_suppkey + 19 THEN 'failed' ELSE 'verified' END AS state FROM supplier, (VALUES (1, 'red Events', 'events'), (2, 'red  Total', 'subgroup_n'), (3, 'blue events', 'events')) v(c, path, f)""",
    "forest_rows": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 = 0 AS bare, s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0 AND s_suppkey % 50 + s_suppkey % 7 <> s_suppkey + 19 AS failed FROM supplier),
        r AS (SELECT k, failed, 0 AS r, 'Berg 2001' AS study, k % 50 AS e, k + 9 AS n, '-' AS x FROM s UNION ALL SELECT k, failed, 1, 'Tal 2002', k % 7, 10, 'x' FROM s UNION ALL SELECT k, failed, 2, 'All', k % 50 + k % 7 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, k + 19, '' FROM s WHERE bare)
        SELECT k AS table_id, CAST(r AS INTEGER) AS r, study, 'red Events' AS path, 'events' AS field_type, CAST(e AS VARCHAR) AS value FROM r WHERE NOT failed UNION ALL SELECT k, CAST(r AS INTEGER), study, 'red  Total', 'subgroup_n', CAST(n AS VARCHAR) FROM r UNION ALL SELECT k, CAST(r AS INTEGER), study, 'blue events', 'events', x FROM r""",
    "core_sections": """WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g') AS b FROM documents WHERE doc_id % 3 < 2), d AS (SELECT doc_id, doc_id % 3 = 0 AS marked, length(b) AS n, length(rtrim(b)) AS t FROM b),
        k AS (SELECT *, CASE WHEN marked THEN 81 + 4 * n ELSE 53 + 4 * n END AS whole, CASE WHEN marked THEN 40 + 2 * t ELSE 22 + 2 * t END AS kept, CASE WHEN marked THEN 81 + 4 * n WHEN n >= 32 THEN 9 + n ELSE 20 + 2 * n END AS results FROM d)
        SELECT doc_id, whole >= 3000 AND kept >= 1500 AS filtered, CAST(CASE WHEN whole >= 3000 AND kept >= 1500 THEN kept ELSE whole END AS INTEGER) AS size, CAST(CASE WHEN marked THEN least(4000, whole) ELSE 6 END AS INTEGER) AS front, CAST(least(45000, results) AS INTEGER) AS results FROM k""",
}
