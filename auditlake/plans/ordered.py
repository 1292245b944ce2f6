"""Queries over order, shape, sets, text and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.text import contains_normally, printed_dois, shared_share, supports
from auditlake.operators import batches, checklist, gates, identity, knowledge, scoring
from auditlake.operators.matching import unique_or_refuse
from auditlake.operators.ordered import fill_down, first_values, top, within_budget
from auditlake.sources.tables import table


def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's customers are lettered by their first order, and each one's orders numbered."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).select("c_nationkey", "o_custkey", "o_orderkey")
    return identity.claim_ids(rows, "c_nationkey", "o_custkey", "o_orderkey").select("c_nationkey", "o_orderkey", "claim_id")


def study_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return first_values(rows, ["o_custkey"], ["o_orderkey"], "o_orderpriority")


def fill_down_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("").alias("label"))
    return fill_down(events, ["user_id"], ["event_id"], "label")


def within_block_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's longest documents, while those before hold under 20,000 characters."""
    docs = table(spark, sf_dir, "documents").where("n_chars is not null").select("source", "doc_id", "n_chars")
    return within_budget(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], "n_chars", 20_000, -F.col("n_chars"))


def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most sold parts of each supplier."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("sold"))
    return top(sold, ["l_suppkey"], [F.desc("sold"), F.col("l_partkey")], 3).select("l_suppkey", "l_partkey", "sold", F.col("rank").cast("long").alias("rank"))


def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    wide = table(spark, sf_dir, "lineitem").select("l_returnflag", cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"))
    long = wide.unpivot("l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "field_type", "value")
    return long.groupBy("l_returnflag", "field_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))


def forest_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of each order's lines against the total printed for it; columns whose sum is off are set apart."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("column_sum"), F.sum(F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("long")).otherwise(0)).alias("printed"))
    return sums.select("l_orderkey", "column_sum", "printed", F.when(F.col("column_sum") == F.col("printed"), "verified").otherwise("quarantined").alias("state"))


def unique_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every tenth part the brand of its size whose names describe it best, refused where brands tie. Equal names are scored once."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.split("p_name", " ").alias("tokens"))
    brands = parts.select("p_size", "p_brand", "tokens").distinct()
    asked = parts.where("p_partkey % 10 = 0").select("p_partkey", "p_size", F.col("tokens").alias("wanted"))
    names = asked.select("p_size", "wanted").distinct().join(brands, "p_size")
    scored = names.select("p_size", "wanted", "p_brand", F.round(shared_share(F.col("wanted"), F.col("tokens")), 6).alias("score")).distinct()
    best = unique_or_refuse(scored, ["p_size", "wanted"], "score", "p_brand")
    return asked.join(best, ["p_size", "wanted"]).select("p_partkey", "score", "n_tied", "p_brand", "reason")


def ontology_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the later source states goes before the seed; where both state something else, that is a conflict."""
    none = F.array().cast("array<string>").alias("synonyms")
    seed = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.expr("if(c_custkey % 2 = 0, c_mktsegment, null)").alias("value"), none)
    later = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key"), F.expr("if(c_custkey % 7 < 4, upper(substr(c_mktsegment, 1, 4)), c_mktsegment)").alias("value"), none)
    return knowledge.merge(seed, later, ["value"], "key").select("key", "value", (F.size("conflicts") > 0).alias("conflict"))


def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys of two sets agree: found, missing and made up."""
    lines = table(spark, sf_dir, "lineitem")
    n = scoring.set_scores(lines.where("l_quantity > 10"), lines.where("l_partkey % 7 <> 0"), ["l_orderkey", "l_linenumber"])
    return n.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def value_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote built around an event's number holds it, its parts or another."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("n"), F.get_json_object("props", "$.k").alias("k"))
    quote = F.concat(F.lit("arm of "), "n", F.lit(" patients, median "), "k", F.lit(" months"))
    return events.select("event_id", supports(quote, F.concat("n", F.lit(" / "), "k")).alias("run"), supports(quote, F.concat("k", F.lit(" then "), "n")).alias("reversed"), supports(quote, F.lit("Median!")).alias("wording"), contains_normally(quote, F.lit("pati-ents")).alias("wrapped"))


def doi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see https://doi.org/10."), F.col("page_id") + 1000, F.lit("/AB.1), also doi:10.12/x and 10.5555/c"), F.col("page_id") % 5, F.lit("/.")).alias("t"))
    found = pages.select("page_id", F.posexplode(printed_dois(F.col("t"))).alias("pos", "doi"))
    return found.select("page_id", "pos", "doi")


def inverted_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from the places of their words."""
    places = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = places.groupBy("conv_id", "turn", "word").agg(F.collect_list("pos").alias("at"))
    return batches.text_from_index(index, ["conv_id", "turn"], "word", "at")


def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects from answers that wrap them in thoughts, fences or prose."""
    raw = F.concat(F.when(F.col("event_id") % 3 == 0, "<think>maybe {\"k\": 0}</think>").otherwise(""), F.when(F.col("event_id") % 2 == 0, "Answer: ").otherwise("```json\n"), F.col("props"), F.lit("\n```"))
    events = table(spark, sf_dir, "events").select("event_id", batches.answer_json(raw).alias("answer"))
    return events.select("event_id", F.from_json("answer", "k int")["k"].cast("long").alias("k"))


def journal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.count("*").alias("steps"), F.max("event_id").alias("last_step"), F.max_by("event_type", "event_id").alias("live"))


def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that stay null where nothing was reported, apart from zero."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("batch"), F.when((F.col("user_id") % 10 > 2) & (F.col("event_id") % 3 > 0), k).alias("tokens"))
    return batches.rollup(rows, ["event_type", "batch"], "tokens")


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("opens"), "event_type", "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with less than 12 hours between them."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    gap = F.col("us") - F.lag("us").over(order)
    told = events.withColumn("new", F.coalesce((gap >= 43_200_000_000).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's labels against those given: counts, accuracy, precision, recall and F1, null where undefined."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labels.join(docs.select("doc_id", "n_chars", "lang"), "doc_id")
    n = scoring.binary_metrics(rows, ["lang"], F.col("n_chars") > 500, F.col("quality") == 1)
    return n.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


def domain_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over languages of their rates, so that a large one doesn't decide."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labels.join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    by = scoring.domain_weighted(rows, "lang", quality=F.avg("quality"), toxic=F.avg("toxic"))
    return by.select("domains", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources drawn again within each language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    clusters = labels.join(docs.select("doc_id", "lang", "source"), "doc_id").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    return gates.bootstrap(clusters, "lang", "source", draws=400).drop("note")


def cluster_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of finished orders, customers drawn again."""
    clusters = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.count("*").alias("n"))
    return gates.bootstrap(clusters, None, "o_custkey", draws=200).drop("note")


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that enough users agree on are promoted."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", (F.get_json_object("props", "$.k").cast("long") % 20).alias("proposal"))
    return knowledge.agreed_runs(events, ["event_type", "proposal"], "user_id")


def search_count_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far counts without errors are from all counts; here one of zero has a flag of its own."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("actual"), F.count_if(F.col("event_type") != "error").alias("reported"))
    return n.withColumn("flag", F.when(F.col("reported") == 0, "zero").otherwise(batches.count_difference(F.col("reported"), F.col("actual"))))


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that one reading answers, by paper and field; how many there are, and of one claim only."""
    held = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("claims"))
    return batches.plan_counts(held, ["l_returnflag"])


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's documents, how many carry a label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = docs.join(labels.select("doc_id", "quality").withColumn("found", F.lit(1)), "doc_id", "left").groupBy("source").agg(F.count("*").alias("expected"), F.count("found").alias("found"))
    return n.withColumn("status", checklist.status_of(F.col("expected"), F.col("found")))


QUERIES = {
    f.__name__: f
    for f in (claim_ids, study_dedupe, fill_down_labels, within_block_budget, top_parts, unpivot_long, forest_checksum, unique_best, ontology_merge, set_scores, value_supported, doi_scan, inverted_index_text, json_recovery, journal_latest, telemetry_rollup, windowed_events, sessions, score_metrics, domain_weighted, bootstrap_interval, cluster_interval, promotions, search_count_flags, batch_plan, coverage_gaps)
}

LETTER_SQL = "CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN concat(chr(CAST(64 + i // 26 AS INTEGER)), chr(CAST(65 + i % 26 AS INTEGER))) WHEN i < 18278 THEN concat(chr(CAST(65 + (i - 702) // 676 AS INTEGER)), chr(CAST(65 + ((i - 702) // 26) % 26 AS INTEGER)), chr(CAST(65 + (i - 702) % 26 AS INTEGER))) ELSE concat(chr(CAST(65 + (i - 18278) // 17576 AS INTEGER)), chr(CAST(65 + ((i - 18278) // 676) % 26 AS INTEGER)), chr(CAST(65 + ((i - 18278) // 26) % 26 AS INTEGER)), chr(CAST(65 + (i - 18278) % 26 AS INTEGER))) END"
LABELLED = "labels JOIN (SELECT doc_id, n_chars, lang, source FROM documents) d USING (doc_id)"

_MOD = "18446744073709551616::UHUGEINT"


def _interval(clusters: str, draws: int, seed: int = 20_260_810) -> str:
    """Every pick a row here, joined to its cluster; the mixing goes step by step, as each step names the one before it several times."""
    steps, last = [], f"SELECT *, {seed}::UHUGEINT AS z FROM c, range({draws}) x(draw)"
    for name, count in (("a", "draw"), ("b", "d"), ("e", "slot")):
        steps.append(f"{name}0 AS ({last}), {name}1 AS (SELECT * REPLACE ((z + {gates.SPREAD}::UHUGEINT * ({count} + 1)::UHUGEINT) % {_MOD} AS z) FROM {name}0)")
        for i, (shift, factor) in enumerate(gates.MIXING):
            steps.append(f"{name}{i + 2} AS (SELECT * REPLACE (xor(z, z // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT % {_MOD} AS z) FROM {name}{i + 1})")
        last = f"SELECT * REPLACE (xor(z, z // {1 << 31}::UHUGEINT) AS z) FROM {name}3"
    return f"""WITH g AS ({clusters}), c AS (SELECT *, dense_rank() OVER (ORDER BY domain NULLS FIRST) - 1 AS d, row_number() OVER (PARTITION BY domain ORDER BY cluster NULLS FIRST) - 1 AS slot, count(*) OVER (PARTITION BY domain) AS k FROM g),
        {", ".join(steps)}, p AS (SELECT d, draw, CAST(z % k::UHUGEINT AS BIGINT) AS slot FROM ({last})), r AS (SELECT draw, d, sum(good)::DOUBLE / nullif(sum(n), 0)::DOUBLE AS rate FROM p JOIN c USING (d, slot) GROUP BY ALL), s AS (SELECT list_sort(list(stat)) AS l FROM (SELECT draw, round(avg(rate), 9) AS stat FROM r GROUP BY draw) WHERE stat IS NOT NULL),
        o AS (SELECT avg(rate) AS point FROM (SELECT sum(good)::DOUBLE / nullif(sum(n), 0)::DOUBLE AS rate FROM g GROUP BY domain))
        SELECT round(point, 6) AS point, CAST(len(l) AS BIGINT) AS draws, round(l[greatest(1, len(l) * 25 // 1000)], 6) AS lower, round(l[least(len(l), len(l) * 975 // 1000 + 1)], 6) AS upper FROM s, o"""


ORACLE_SQL = {
    "claim_ids": f"""WITH r AS (SELECT c_nationkey, o_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT c_nationkey, o_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY min(o_orderkey)) - 1 AS i FROM r GROUP BY c_nationkey, o_custkey)
        SELECT r.c_nationkey, o_orderkey, concat({LETTER_SQL}, '_', lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS claim_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM r) r JOIN f USING (o_custkey)""",
    "study_dedupe": """WITH h AS (SELECT o_custkey, o_orderkey, o_orderpriority, first_value(o_orderpriority) OVER w AS f, row_number() OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), c AS (SELECT o_custkey, bool_or(o_orderpriority <> f) AS conflict FROM h GROUP BY o_custkey)
        SELECT o_custkey, o_orderkey, o_orderpriority, conflict FROM h JOIN c USING (o_custkey) WHERE p = 1 OR o_orderpriority <> f""",
    "fill_down_labels": "SELECT user_id, event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events",
    "within_block_budget": "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE n_chars IS NOT NULL) WHERE before < 20000",
    "top_parts": "SELECT l_suppkey, l_partkey, CAST(sold AS BIGINT) AS sold, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY sold DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS sold FROM lineitem GROUP BY ALL)) WHERE rank <= 3",
    "unpivot_long": """SELECT l_returnflag, field_type, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, max(value) AS largest FROM (UNPIVOT (SELECT l_returnflag, CAST(round(l_quantity * 100) AS BIGINT) AS l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice, CAST(round(l_discount * 100) AS BIGINT) AS l_discount, CAST(round(l_tax * 100) AS BIGINT) AS l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME field_type VALUE value) GROUP BY ALL""",
    "forest_checksum": "SELECT *, CASE WHEN column_sum = printed THEN 'verified' ELSE 'quarantined' END AS state FROM (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS column_sum, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linenumber <> 7), 0) AS BIGINT) AS printed FROM lineitem GROUP BY l_orderkey)",
    "unique_best": """WITH p AS (SELECT p_partkey, p_brand, p_size, string_split(p_name, ' ') AS t FROM part), s AS (SELECT a.p_partkey, b.p_brand, round(max(2.0::DOUBLE * len(list_intersect(a.t, b.t)) / (len(list_distinct(a.t)) + len(list_distinct(b.t)))), 6) AS score FROM p a JOIN p b USING (p_size) WHERE a.p_partkey % 10 = 0 GROUP BY ALL),
        m AS (SELECT p_partkey, max(score) AS score FROM s GROUP BY p_partkey)
        SELECT p_partkey, score, count(*) AS n_tied, CASE WHEN count(*) = 1 THEN min(p_brand) END AS p_brand, CASE WHEN count(*) > 1 THEN 'tie' END AS reason FROM s JOIN m USING (p_partkey, score) GROUP BY p_partkey, score""",
    "ontology_merge": """SELECT key, coalesce(b, a) AS value, coalesce(a <> b, false) AS conflict FROM (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS a FROM customer WHERE c_custkey % 3 <> 0) FULL JOIN (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 < 4 THEN upper(substr(c_mktsegment, 1, 4)) ELSE c_mktsegment END AS b FROM customer WHERE c_custkey % 5 <> 0) USING (key)""",
    "set_scores": """WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10), p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 7 <> 0), c AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp)
        SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""",
    "value_supported": "SELECT event_id, true AS run, event_id = CAST(json_extract_string(props, '$.k') AS BIGINT) AS reversed, true AS wording, true AS wrapped FROM events",
    "doi_scan": "SELECT page_id, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN concat('10.', page_id + 1000, '/ab.1') ELSE concat('10.5555/c', page_id % 5) END AS doi FROM pages, (VALUES (0), (1)) v(p)",
    "inverted_index_text": "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL",
    "json_recovery": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "journal_latest": "SELECT user_id, count(*) AS steps, max(event_id) AS last_step, arg_max(event_type, event_id) AS live FROM events GROUP BY user_id",
    "telemetry_rollup": "SELECT event_type, user_id % 10 AS batch, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens, count(t) AS reported FROM (SELECT *, CASE WHEN user_id % 10 > 2 AND event_id % 3 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS t FROM events) GROUP BY 1, 2",
    "windowed_events": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS opens, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sessions": """WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT user_id, event_id, CAST(sum(CASE WHEN gap IS NULL OR gap >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS session FROM g)
        SELECT user_id, session, count(*) AS events, min(event_id) AS first_event FROM s GROUP BY ALL""",
    "score_metrics": f"""WITH r AS (SELECT lang, n_chars > 500 AS said, quality = 1 AS yes FROM {LABELLED}), n AS (SELECT lang, count(*) FILTER (said AND yes) AS tp, count(*) FILTER (said AND NOT yes) AS fp, count(*) FILTER (NOT said AND yes) AS fn, count(*) FILTER (NOT said AND NOT yes) AS tn FROM r GROUP BY lang)
        SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM n""",
    "domain_weighted": f"SELECT count(*) AS domains, round(avg(q), 6) AS quality, round(avg(t), 6) AS toxic FROM (SELECT lang, avg(quality) AS q, avg(toxic) AS t FROM {LABELLED} WHERE lang IS NOT NULL GROUP BY lang)",
    "bootstrap_interval": _interval(f"SELECT lang AS domain, source AS cluster, CAST(sum(quality) AS BIGINT) AS good, count(*) AS n FROM {LABELLED} WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source", 400),
    "cluster_interval": _interval("SELECT 0 AS domain, o_custkey AS cluster, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) AS n FROM orders GROUP BY o_custkey", 200),
    "promotions": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS proposal, count(DISTINCT user_id) AS runs, count(DISTINCT user_id) >= 3 AS promoted FROM events GROUP BY 1, 2",
    "search_count_flags": "SELECT user_id, actual, reported, CASE WHEN reported = 0 THEN 'zero' WHEN abs(reported - actual) / actual > 0.3 THEN 'major' WHEN abs(reported - actual) / actual > 0.05 THEN 'minor' ELSE 'none' END AS flag FROM (SELECT user_id, count(*) AS actual, count(*) FILTER (event_type <> 'error') AS reported FROM events GROUP BY user_id)",
    "batch_plan": "SELECT l_returnflag, count(*) AS batches, CAST(sum(c) AS BIGINT) AS claims, count(*) FILTER (c = 1) AS singletons, max(c) AS largest FROM (SELECT l_partkey, l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY l_returnflag",
    "coverage_gaps": "SELECT source, count(*) AS expected, count(l.doc_id) AS found, CASE WHEN count(l.doc_id) = 0 THEN 'missing' WHEN count(l.doc_id) < count(*) THEN 'partial' ELSE 'covered' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source",
}
