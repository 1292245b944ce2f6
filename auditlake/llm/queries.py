"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import alignment, ann_graph, decontam, langid, packing, rlz_dedup, simhash, sketches, suffix_dedup, token_counts, token_store, toxicity, vector_codes
from auditlake.llm.common import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), window=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(), limit=2048)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.dedup_spans(table(spark, sf_dir, "documents"), window=20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_ids(table(spark, sf_dir, "documents"), tokenizer())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), capacity=4096)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_graph.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=3)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_with_digest(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, sf_dir, "documents"), *paths)[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_toxicity, op3_token_counts, op4_substring_dedup, op5_language_id, op6_token_store, op7_packing, op8_nearest, op9_simhash, op10_decontamination, op11_vector_codes, op12_sketches, op13_alignment)
}

#: Bytes are pairs of hexadecimal digits; windows are cut from stretches of 1,000 bytes, so that no long text is gone through for each of them.
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, length(h) // 2 AS n, unnest(range(CAST(0 AS BIGINT), CAST(length(h) // 2 AS BIGINT), CAST(1000 AS BIGINT))) AS base, h FROM d),
p AS (SELECT doc_id, base, substring(h, 2 * base + 1, 2198) AS h, least(1000, n - base) AS n FROM s),
b AS (SELECT doc_id, base, unnest(range(CAST(n AS BIGINT))) AS j, h FROM p),
w AS (SELECT doc_id, base + j AS i, CASE WHEN 2 * j + 200 <= length(h) THEN md5(substring(h, 2 * j + 1, 200)) END AS win, substring(h, 2 * j + 1, 2) AS byte FROM b),
f AS (SELECT doc_id, i, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

SPAN_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER v = 20 THEN string_agg(word, ' ') OVER v END AS win FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: Parts of four components. A distance and its entry are one number, so that its least has the first of equals; sums are made divisible before they are divided, as floors go down.
ASSIGNED_SQL = "SELECT p.part, p.r, p.v, min((({v}[1] - {c}[1])**2 + ({v}[2] - {c}[2])**2 + ({v}[3] - {c}[3])**2 + ({v}[4] - {c}[4])**2)::BIGINT * 64 + b.entry) AS best FROM p JOIN {book} b USING (part) GROUP BY ALL".replace("{v}", "p.v").replace("{c}", "b.c")
REFINED_SQL = """
SELECT b.part, b.entry, CASE WHEN s.n IS NULL THEN b.c ELSE list_transform(s.sums, lambda x: (x - ((x % s.n) + s.n) % s.n) // s.n) END AS c
FROM {book} b LEFT JOIN (SELECT part, best % 64 AS entry, count(*) AS n, [sum(v[1])::BIGINT, sum(v[2])::BIGINT, sum(v[3])::BIGINT, sum(v[4])::BIGINT] AS sums FROM {found} GROUP BY ALL) s USING (part, entry)
"""
CODES_SQL = f"""
WITH k AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS (SELECT r, embedding, unnest(range(16)) AS part FROM k),
p AS (SELECT r, part, list_transform(embedding[4 * part + 1 : 4 * part + 4], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM e),
b0 AS (SELECT part, r AS entry, v AS c FROM p WHERE r < 64),
f0 AS ({ASSIGNED_SQL.format(book="b0")}),
b1 AS ({REFINED_SQL.format(book="b0", found="f0")}),
f1 AS ({ASSIGNED_SQL.format(book="b1")}),
b2 AS ({REFINED_SQL.format(book="b1", found="f1")}),
f2 AS ({ASSIGNED_SQL.format(book="b2")}),
c AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM f2 GROUP BY r)
SELECT vec_id, code, error, label, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, entry) FROM b2)) AS codebooks_sha256 FROM k JOIN c USING (r)
"""

#: Statements of the two operators over windows and of vector codes, for tables whose ids don't repeat. The others rest on hashes, tokenizers, trained models, sequences that may be numbered in any way or an approximate search, which DuckDB has not got or can't decide; tests hold those against brute force, the libraries, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": SUFFIX_SQL, "op4_substring_dedup": SPAN_SQL, "op11_vector_codes": CODES_SQL}
