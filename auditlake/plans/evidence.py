"""Queries that judge recorded readings, name studies, pick passages and grade runs. Readings are made by integer arithmetic, so that both engines make the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.numeric import with_cells
from auditlake.functions.text import plain_words
from auditlake.operators import judgement
from auditlake.operators.identity import best_identity
from auditlake.operators.retrieval import by_keywords, excerpt_blocks, longest_phrase
from auditlake.sources.tables import table

#: Example contract of phrases, in which one stands inside another.
PHRASES = {"screened": ["small", "old"], "randomised": ["small ring", "old bolt", "red"], "treated": ["ring standard", "widget"]}
TERMS = ["tion", "que", "the"]
FLOOR, HELD_OUT, BAR = 40, "de", 0.45


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = "o_orderkey", "o_custkey"
    return table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.expr(f"concat(if({k} % 13 = 0, 'no ', ''), 'ward ', {k} % 5 + 1)").alias("review"), F.expr(f"concat('ward ', if({c} % 9 = 0, ({k} + 1) % 5 + 1, {k} % 5 + 1))").alias("source"),
        F.expr(f"elt({k} % 6 + 1, 'same', 'review_broader', 'source_broader', 'different', 'unknown', 'similar')").alias("relation"),
        F.expr(f"elt({c} % 5 + 1, '', 'neither', 'source', 'review', 'unknown')").alias("side"),
        F.expr(f"{k} % 7 < 4").alias("equivalent"), F.expr(f"({c} % 101) / 100D").alias("confidence"),
        F.expr(f"if({k} % 4 = 0, 'beds', 'Ward-one')").alias("span"), F.expr(f"if({c} % 3 = 0, '', 'the ward one, at night')").alias("quote"),
    )


def semantic_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir)
    verdict = F.struct("relation", "side", "equivalent", "confidence", "span")
    cells = with_cells(rows.withColumn("verdict", verdict), a=F.col("review"), b=F.col("source"))
    told = cells.withColumn("agree", judgement.numbers_agree(F.col("a"), F.col("b"), 0.01))
    told = told.select(judgement.semantic_control(F.col("verdict"), F.col("review"), F.col("source"), F.col("agree"), F.col("quote")).alias("o")).select("o.*")
    return told.groupBy("label", "failed", "review_required").agg(F.count("*").alias("n"))


def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgement.threshold_curve(_verdicts(spark, sf_dir), ["o_orderpriority"])


def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers cite suppliers, by the name, with words added, cut short, without a year or with another year."""
    name = lambda k: f"concat(translate(string({k}), '0123456789', 'abcdefghij'), translate(string({k} * 7 + 3), '0123456789', 'jihgfedcba'))"
    cited = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.expr(f"concat({name('s_suppkey')}, '_', 1990 + s_suppkey % 30)").alias("label"))
    k, n, year = "c_custkey", name("(c_custkey % 120)"), "(1990 + c_custkey % 120 % 30)"
    form = f"case {k} % 6 when 0 then concat(upper({n}), '_', {year}) when 1 then concat({n}, ' et al. ', {year}) when 2 then concat(substr({n}, 1, 3), ' ', {year}) when 3 then {n} when 4 then concat({n}, ' ', {year} + 1) else concat('  ', {n}, '  J ', {year}) end"
    queries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.expr(form).alias("label"))
    return best_identity(queries, cited, "key", "label")


def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return excerpt_blocks(docs, TERMS)


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share most words with each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), plain_words(F.col("text")).alias("words"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), plain_words(F.col("text")).alias("words"))
    return by_keywords(items, docs).select("query", "name", "shared", F.col("rank").cast("long").alias("rank"))


def phrase_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", F.lower("p_type"))
    told = table(spark, sf_dir, "part").select(longest_phrase(text, PHRASES).alias("x"))
    return told.groupBy(F.coalesce("x.value", F.lit("unknown")).alias("value"), F.coalesce("x.phrase", F.lit("")).alias("phrase")).agg(F.count("*").alias("n"))


def derived_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as arms of a population."""
    k = "l_orderkey"
    arms = table(spark, sf_dir, "lineitem").select(
        k, F.col("l_linenumber").alias("pos"), F.expr("if(l_partkey % 23 = 0, 'arm', concat('arm ', l_linenumber))").alias("label"), F.col("l_quantity").cast("long").alias("n"),
        F.expr(f"if({k} % 17 = 0, null, {k} % 7 <> 0)").alias("complete"), F.expr(f"{k} % 5 <> 0").alias("exclusive"), F.expr(f"{k} % 11 <> 0").alias("anchored"),
    )
    stated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(k), F.expr("case when o_custkey % 4 = 0 then null else o_custkey % 3 + 2 end").alias("declared"))
    return judgement.derived_total(arms.join(stated, k), k)


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with what a length rule says of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").where("lang is not null and quality is not null")


def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language as a domain: a hard gate on toxic rows that the rule let through, a floor on its rows, a bar under its lower bound. The held-out one isn't in the pool."""
    rows = _graded(spark, sf_dir).selectExpr("lang", "(n_chars > 500) = (quality = 1) as hit", "n_chars > 20000 and toxic = 1 as wrong", "toxic is not null as judged")
    pool = rows.where(F.col("lang") != HELD_OUT).withColumn("lang", F.lit("pool"))
    n = rows.unionByName(pool).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("wrong").alias("wrong"), F.count_if("judged").alias("judged"))
    rate = F.col("hits") / F.col("n")
    lower = F.round(rate - 1.96 * F.sqrt(rate * (1 - rate) / F.col("n")), 6)
    n = n.withColumn("lower", lower)
    status = judgement.gate_status((F.col("judged") > 0) & (F.col("wrong") != 0), F.col("judged") == 0, F.col("n") < FLOOR, F.col("lower") < BAR)
    return n.select("lang", "n", "hits", "wrong", "lower", status.alias("status"), (F.col("lang") == HELD_OUT).alias("held_out"))


def transition_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's state in a run against its state in the baseline; rows that the baseline hasn't got can't be judged. What was right may not be released wrong."""
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    expected = F.expr("if(quality = 1, 'match', 'mismatch')")
    before = rows.where("doc_id % 9 <> 0").select("doc_id", judgement.row_state(F.expr("case when doc_id % 4 = 0 then 'not_comparable' when doc_id % 6 = 1 then 'mismatch' else 'match' end"), expected, F.expr("toxic = 1")).alias("before"))
    after = rows.select("doc_id", judgement.row_state(F.expr("case when doc_id % 5 = 0 then 'review_required' when doc_id % 7 = 1 then 'mismatch' else 'match' end"), expected, F.expr("doc_id % 3 = 0")).alias("after"))
    met = after.join(before, "doc_id", "left").withColumn("before", F.coalesce("before", F.lit("not_evaluable")))
    allowed = (F.col("before") != "not_evaluable") & ~((F.col("after") == "wrong_released") & (F.col("before") != "wrong_released"))
    return met.groupBy("before", "after", allowed.alias("permitted")).agg(F.count("*").alias("n"))


def reconcile_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as references, lines as the candidates of three resolvers."""
    found = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "(l_partkey % 101) / 100D as score", "l_linenumber % 3 as resolver", "if(l_suppkey % 6 = 0, null, concat('10.1000/', if(l_partkey % 2 = 0, 'A', 'a'), l_suppkey % 3)) as doi")
    return judgement.accept_reference(found, "l_orderkey")


def resolver_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one value as samples of one question, in order."""
    order = Window.partitionBy("user_id", "k").orderBy("event_id")
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    samples = table(spark, sf_dir, "events").select("user_id", k, "event_id", F.col("event_type").alias("signature")).withColumn("sample", F.row_number().over(order))
    keyed = samples.where("sample <= 3").select(F.concat_ws("/", "user_id", "k").alias("question"), "sample", "signature")
    return judgement.consensus(keyed, "question")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("case when n_chars > 2000 then 'long' when n_chars > 500 then 'middle' else 'short' end")
    return _graded(spark, sf_dir).groupBy("lang", F.col("quality").alias("expected"), said.alias("said")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (semantic_control, threshold_curve, identity_match, excerpt, keyword_topk, phrase_classifier, derived_totals, acceptance_gate, transition_grade, reconcile_refs, resolver_consensus, confusion)
}

VERDICTS_SQL = """WITH v AS (SELECT o_orderpriority, o_orderkey AS k, o_custkey AS c, ['same', 'review_broader', 'source_broader', 'different', 'unknown', 'similar'][o_orderkey % 6 + 1] AS relation, ['', 'neither', 'source', 'review', 'unknown'][o_custkey % 5 + 1] AS side, o_orderkey % 7 < 4 AS equivalent, (o_custkey % 101) / 100.0::DOUBLE AS confidence FROM orders)
"""
_NAME = "concat(translate(CAST({k} AS VARCHAR), '0123456789', 'abcdefghij'), translate(CAST({k} * 7 + 3 AS VARCHAR), '0123456789', 'jihgfedcba'))"
_YEARS, _CITED = "(1990 + c_custkey % 120 % 30)", _NAME.format(k="(c_custkey % 120)")
_STEMS = "list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda t: NOT list_contains(['et', 'al', 'and', 'the'], t) AND NOT regexp_full_match(t, '(19|20)[0-9]{2}'))"
_READY = f"SELECT key, label, nullif(regexp_extract(label, '((19|20)[0-9]{{2}})', 1), '') AS year, {_STEMS} AS tokens, regexp_replace(regexp_replace(lower(label), '(19|20)[0-9]{{2}}', '', 'g'), '[^a-z0-9]', '', 'g') AS letters"
_GRADED = "(SELECT * FROM labels JOIN (SELECT doc_id, lang, n_chars FROM documents) d USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL)"
_STATE = "CASE WHEN p IN ('not_comparable', 'review_required') THEN 'refused' WHEN p = e THEN 'correct' WHEN r THEN 'wrong_but_flagged' ELSE 'wrong_released' END"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"

ORACLE_SQL = {
    "semantic_control": VERDICTS_SQL
    + """SELECT label, failed, review_required, count(*) AS n FROM (SELECT CASE WHEN num OR pol OR (NOT self AND relation = 'different') THEN 'mismatch' WHEN self OR low OR anchor THEN 'not_comparable' ELSE 'match' END AS label,
        CASE WHEN num THEN 'numeric' WHEN pol THEN 'polarity' WHEN self THEN 'relation_direction' WHEN relation = 'different' THEN '' WHEN low THEN 'confidence' WHEN anchor THEN 'anchor' ELSE '' END AS failed,
        CASE WHEN num OR pol THEN false WHEN self THEN true WHEN relation = 'different' THEN false WHEN low OR anchor THEN true ELSE relation <> 'same' END AS review_required
        FROM (SELECT relation, c % 9 = 0 AS num, k % 13 = 0 AS pol, confidence < 0.7 OR relation = 'unknown' AS low, c % 3 <> 0 AND k % 4 = 0 AS anchor,
        relation = 'similar' OR (side <> '' AND CASE relation WHEN 'same' THEN side <> 'neither' WHEN 'review_broader' THEN side <> 'source' WHEN 'source_broader' THEN side <> 'review' WHEN 'different' THEN side NOT IN ('unknown', 'neither') ELSE side <> 'unknown' END) OR (relation = 'same' AND NOT equivalent) OR (relation = 'different' AND equivalent) AS self FROM v)) GROUP BY ALL""",
    "threshold_curve": VERDICTS_SQL + "SELECT o_orderpriority, t AS threshold, count(*) FILTER (relation IN ('same', 'review_broader', 'source_broader') AND confidence >= CAST(t AS DOUBLE)) AS accepted FROM v, (VALUES ('0.50'), ('0.60'), ('0.70'), ('0.80'), ('0.90')) g(t) GROUP BY ALL",
    "identity_match": f"""WITH c AS ({_READY} FROM (SELECT s_suppkey AS key, concat({_NAME.format(k='s_suppkey')}, '_', 1990 + s_suppkey % 30) AS label FROM supplier)),
        q AS ({_READY} FROM (SELECT c_custkey AS key, trim(regexp_replace(CASE c_custkey % 6 WHEN 0 THEN concat(upper({_CITED}), '_', {_YEARS}) WHEN 1 THEN concat({_CITED}, ' et al. ', {_YEARS}) WHEN 2 THEN concat(substr({_CITED}, 1, 3), ' ', {_YEARS}) WHEN 3 THEN {_CITED} WHEN 4 THEN concat({_CITED}, ' ', {_YEARS} + 1) ELSE concat('  ', {_CITED}, '  J ', {_YEARS}) END, ' +', ' ', 'g')) AS label FROM customer)),
        m AS (SELECT q.key AS query, c.key AS candidate, lower(q.label) = lower(c.label) AS exact, len(q.tokens) > 0 AND list_has_all(c.tokens, q.tokens) AS holds FROM q, c WHERE lower(q.label) = lower(c.label) OR (NOT coalesce(q.year <> c.year, false) AND ((len(q.tokens) > 0 AND len(c.tokens) > 0 AND len(list_filter(q.tokens, lambda t: NOT list_contains(c.tokens, t) AND NOT (length(t) >= 3 AND len(list_filter(c.tokens, lambda k: starts_with(k, t))) > 0))) = 0) OR (q.letters <> '' AND c.letters <> '' AND (starts_with(c.letters, q.letters) OR starts_with(q.letters, c.letters)))))),
        g AS (SELECT query, min(candidate) FILTER (exact) AS same, count(*) AS n, min(candidate) AS single, count(*) FILTER (holds) AS h, min(candidate) FILTER (holds) AS holder FROM m GROUP BY query)
        SELECT c_custkey AS query, CASE WHEN same IS NOT NULL THEN same WHEN n = 1 THEN single WHEN h = 1 THEN holder END AS candidate, CASE WHEN same IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'only' WHEN h = 1 THEN 'only_holder' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS reason FROM customer LEFT JOIN g ON query = c_custkey""",
    "excerpt": """WITH b AS (SELECT doc_id, i * 2500 AS start, least(i * 2500 + 3000, n) AS e, substr(lower(text), i * 2500 + 1, 3000) AS block FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, CAST(ceil((length(text) - 3000) / 2500) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 20000)),
        s AS (SELECT doc_id, start, e, (length(block) - length(replace(block, 'tion', ''))) // 4 + (length(block) - length(replace(block, 'que', ''))) // 3 + (length(block) - length(replace(block, 'the', ''))) // 3 AS said, len(regexp_extract_all(regexp_replace(block, '[a-z][0-9]', ' ', 'g'), '[0-9]+(\\.[0-9]+)?')) AS numbers FROM b),
        r AS (SELECT *, CASE WHEN said > 0 THEN said + least(numbers // 10, 20) ELSE 0 END AS score FROM s),
        w AS (SELECT *, coalesce(sum(e - start) OVER (PARTITION BY doc_id ORDER BY start = 0 DESC, score DESC, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
        SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(score AS INTEGER) AS score FROM w WHERE before < 19500 UNION ALL SELECT doc_id, 0, CAST(length(text) AS INTEGER), NULL FROM documents WHERE length(text) <= 20000""",
    "keyword_topk": f"""WITH q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS w FROM documents), h AS (SELECT item_id AS query, doc_id AS name, count(*) AS shared FROM q JOIN d USING (w) GROUP BY ALL),
        f AS (SELECT * FROM h UNION ALL SELECT item_id, doc_id, 0 FROM benchmark, (SELECT DISTINCT doc_id FROM documents ORDER BY 1 LIMIT 8) WHERE item_id NOT IN (SELECT query FROM h))
        SELECT query, name, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, name) AS rank FROM f) WHERE rank <= 8""",
    "phrase_classifier": """WITH p(value, phrase, i) AS (VALUES ('screened', 'small', 0), ('screened', 'old', 1), ('randomised', 'small ring', 2), ('randomised', 'old bolt', 3), ('randomised', 'red', 4), ('treated', 'ring standard', 5), ('treated', 'widget', 6)),
        m AS (SELECT p_partkey, value, phrase, row_number() OVER (PARTITION BY p_partkey ORDER BY length(phrase) DESC, i) AS r FROM part JOIN p ON contains(concat(' ', p_name, ' ', lower(p_type), ' '), concat(' ', phrase, ' ')))
        SELECT coalesce(value, 'unknown') AS value, coalesce(phrase, '') AS phrase, count(*) AS n FROM part LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (p_partkey) GROUP BY ALL""",
    "derived_totals": """WITH a AS (SELECT l_orderkey, count(*) AS k, count(DISTINCT CASE WHEN l_partkey % 23 = 0 THEN 'arm' ELSE concat('arm ', l_linenumber) END) AS labels, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' + ' ORDER BY l_linenumber, l_quantity) AS parts FROM lineitem GROUP BY l_orderkey),
        r AS (SELECT *, CASE WHEN labels < k THEN 'same_arm_twice' WHEN k < 2 THEN 'too_few_arms' WHEN l_orderkey % 17 = 0 THEN 'no_partition_stated' WHEN l_orderkey % 7 = 0 THEN 'not_complete' WHEN l_orderkey % 5 = 0 THEN 'overlap' WHEN l_orderkey % 11 = 0 THEN 'not_anchored' WHEN o_custkey % 4 = 0 THEN 'no_census' WHEN o_custkey % 3 + 2 <> k THEN 'arm_missing' END AS reason FROM a JOIN orders ON o_orderkey = l_orderkey)
        SELECT l_orderkey, CASE WHEN reason IS NULL THEN 'derived' ELSE 'rejected' END AS status, reason, CASE WHEN reason IS NULL THEN s END AS total, CASE WHEN reason IS NULL THEN concat(parts, ' = ', s) END AS derivation FROM r""",
    "acceptance_gate": f"""WITH g AS (SELECT lang, (n_chars > 500) = (quality = 1) AS hit, n_chars > 20000 AND toxic = 1 AS wrong, toxic IS NOT NULL AS judged FROM {_GRADED}), u AS (SELECT * FROM g UNION ALL SELECT 'pool', hit, wrong, judged FROM g WHERE lang <> '{HELD_OUT}'),
        n AS (SELECT lang, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (wrong) AS wrong, count(*) FILTER (judged) AS judged FROM u GROUP BY lang), l AS (SELECT *, round(hits / n - 1.96::DOUBLE * sqrt((hits / n) * (1 - hits / n) / n), 6) AS lower FROM n)
        SELECT lang, n, hits, wrong, lower, CASE WHEN judged > 0 AND wrong <> 0 THEN 'FAIL' WHEN judged = 0 OR n < {FLOOR} THEN 'NOT_ESTIMABLE' WHEN lower < {BAR}::DOUBLE THEN 'FAIL' ELSE 'PASS' END AS status, lang = '{HELD_OUT}' AS held_out FROM l""",
    "transition_grade": f"""WITH x AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'match' ELSE 'mismatch' END AS e, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
        b AS (SELECT doc_id, {_STATE} AS before FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'not_comparable' WHEN doc_id % 6 = 1 THEN 'mismatch' ELSE 'match' END AS p, toxic = 1 AS r FROM x WHERE doc_id % 9 <> 0)),
        a AS (SELECT doc_id, {_STATE} AS after FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'review_required' WHEN doc_id % 7 = 1 THEN 'mismatch' ELSE 'match' END AS p, doc_id % 3 = 0 AS r FROM x))
        SELECT coalesce(before, 'not_evaluable') AS before, after, before IS NOT NULL AND NOT (after = 'wrong_released' AND before <> 'wrong_released') AS permitted, count(*) AS n FROM a LEFT JOIN b USING (doc_id) GROUP BY ALL""",
    "reconcile_refs": """WITH f AS (SELECT l_orderkey, (l_partkey % 101) / 100.0::DOUBLE AS score, l_linenumber % 3 AS resolver, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE concat('10.1000/a', l_suppkey % 3) END AS doi FROM lineitem),
        v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, resolver, doi IS NULL, doi DESC) AS r FROM f), d AS (SELECT l_orderkey, doi, count(DISTINCT resolver) AS k FROM f GROUP BY ALL),
        c AS (SELECT v.l_orderkey, round(least(1.0::DOUBLE, score + CASE WHEN v.doi IS NOT NULL AND k >= 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 6) AS confidence, resolver, v.doi FROM v JOIN d ON v.l_orderkey = d.l_orderkey AND v.doi IS NOT DISTINCT FROM d.doi WHERE r = 1)
        SELECT l_orderkey, CASE WHEN confidence >= 0.72::DOUBLE AND doi IS NOT NULL THEN 'resolved' ELSE 'unresolved_source' END AS status, confidence, resolver, CASE WHEN confidence >= 0.72::DOUBLE THEN doi END AS doi FROM c""",
    "resolver_consensus": """WITH s AS (SELECT concat(user_id, '/', json_extract_string(props, '$.k')) AS question, event_type AS g, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id) AS i FROM events),
        p AS (SELECT question, max(g) FILTER (i = 1) AS a, max(g) FILTER (i = 2) AS b, max(g) FILTER (i = 3) AS c FROM s WHERE i <= 3 GROUP BY question), o AS (SELECT *, CASE WHEN a = b THEN a WHEN a = c OR b = c THEN c END AS signature FROM p)
        SELECT question, signature, CAST(CASE WHEN a = b THEN 2 ELSE 1 + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER) END AS INTEGER) AS asked, CASE WHEN signature IS NULL THEN 'unstable' ELSE 'stable' END AS stability FROM o""",
    "confusion": f"SELECT lang, quality AS expected, CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'middle' ELSE 'short' END AS said, count(*) AS n FROM {_GRADED} GROUP BY ALL",
}
