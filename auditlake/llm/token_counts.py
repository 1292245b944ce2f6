"""Token counts through a cache of digests.

Texts are digested, digests are joined to the counts stored for the tokenizer's version, and only the
distinct texts that miss are encoded, each once; their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut, ensure_checkpoint_dir, look_up, texts
from auditlake.llm.tokens import encoder

CACHE_DDL = "tokenizer string, digest binary, n_tokens long"


def version(path: str) -> str:
    """Digest of the tokenizer's file: another vocabulary or setting is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def stored(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """Counts in the cache for this tokenizer, one for a digest; none where the cache has not been written."""
    spark = docs.sparkSession
    try:
        held = spark.read.schema(CACHE_DDL).parquet(cache)
        held.isStreaming  # resolves the path
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], CACHE_DDL)
    return held.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each text.

    The content that is digested is the UTF-8 text with null made empty; any other normalisation
    could change a count. cache: a folder that all executors reach, kept from call to call; without
    one a new cache is laid under the shared checkpoint folder. Empty texts count 0. Rows without a
    doc_id take no part; rows that repeat a doc_id are all returned, each with its own text's count,
    which is found by the text's SHA-256 alone. However often a text is repeated, under one doc_id or
    many, it is encoded once and makes one row of the cache.
    Texts of any length are encoded whole. Further columns aren't used. An empty table gives none.
    """
    spark = docs.sparkSession
    cache = cache or f"{ensure_checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    name = version(tokenizer)
    rows = texts(docs)
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    keys = cut(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")))
    by_row = keys.groupBy("digest", "doc_id").agg(F.count("*").alias("n_rows"))
    texts_of = cut(by_row.groupBy("digest").agg(F.sum("n_rows").alias("n_rows"), F.min(F.struct("doc_id", F.col("n_rows").alias("same"))).alias("at")))
    misses = cut(texts_of.join(stored(docs, cache, name), "digest", "left_anti").select("at.*", "digest"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer).ids
        for batch in batches:
            n = [len(count(t.as_py())) // 4 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    # a doc_id may have other texts as well
    asked = rows.join(misses.hint("shuffle_hash"), "doc_id").where(digest == F.col("digest"))
    todo = asked.where("same = 1").select("digest", "text")
    if not misses.where("same > 1").isEmpty():
        todo = todo.unionByName(asked.where("same > 1").select("digest", "text").dropDuplicates(["digest"]))
    new = todo.mapInArrow(encode, "digest binary, n_tokens long").select(F.lit(name).alias("tokenizer"), "digest", "n_tokens")
    new.write.mode("append").parquet(cache)
    counts = stored(docs, cache, name).join(texts_of.select("digest", "n_rows"), "digest")
    counted = look_up(keys, counts, "digest", keys.count())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
