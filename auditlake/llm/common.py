"""What the operators of this subpackage share: tables, checkpoints, Arrow helpers and packed rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.sources.tables import tidy as tidy

#: White space that separates words; every other byte belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session gets a temporary one; a cluster is refused, as its executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared folder that survives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many marks before it as it takes to be none of the columns; upper and lower case are the same to Spark."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bytes of a batch that goes to a Python worker. An executor holds a few of them for each of its cores, beside its heap.
BATCH_BYTES = 2 << 20


def short_batches(spark: SparkSession) -> None:
    """From now on this session's batches of rows for Python have BATCH_BYTES at most, if they may have more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows of a few numbers for which a file of their own is laid.
FILE_ROWS = 1 << 13


def few_files(df: DataFrame, most_rows: int) -> DataFrame:
    """df, known to have at most so many rows of a few numbers, in as few partitions as hold FILE_ROWS each, so that small results don't make a file (and what it takes to lay one) for each of many partitions. The rows are exchanged for it, so that the work before keeps its own partitions."""
    return df.repartition(min(partitions(df.sparkSession), most_rows // FILE_ROWS + 1))


def few_tasks(df: DataFrame, most_rows: int) -> DataFrame:
    """df, known to have at most so many rows of a few numbers, worked on by as few tasks as get FILE_ROWS each. Nothing is exchanged for it: each task takes on several partitions, so that a step whose work is small doesn't run a task, with its files and its events, for each partition of a shuffle. A single task's rows need no exchange in later steps either."""
    tasks = most_rows // FILE_ROWS + 1
    return df if tasks >= partitions(df.sparkSession) else df.coalesce(tasks)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id and text (null: empty). Rows without a doc_id have no identity and take no part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text.alias("text"), *more)


def tagged_texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """As texts, with a tag that keeps the texts of one doc_id apart and in order: 64 bits of the text's hash where any doc_id is repeated, 0 where none is. Only doc_ids are read to tell."""
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long")).count().where("count > 1")
    rows = texts(docs, *more)
    tag = F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")
    return rows.withColumn("tag", tag)


#: Rows of a few numbers each that may be broadcast.
TOLD = 1 << 20


def small(rows: DataFrame, otherwise: str | None = None, most: int | None = None) -> DataFrame:
    """rows, of a few numbers each, to be broadcast if they are counted (or, with most, known) to be at most TOLD; else with the given join hint, or none."""
    if (rows.count() if most is None else most) <= TOLD:
        return F.broadcast(rows)
    return rows.hint(otherwise) if otherwise else rows


#: Of the rows of a table, a key with more than this share is heavy; so there are at most as many heavy keys as its inverse.
HEAVY = 0.001


def look_up(rows: DataFrame, entries: DataFrame, key: str, total: int) -> DataFrame:
    """rows (`total` of them) with the columns of their entries, one for each key, whose column `n_rows` (which goes) says how many rows have the key. Entries of heavy keys, a thousand at most, are broadcast, so that no task gets all rows of one; the others are shuffled."""
    many = F.col("n_rows") > max(10_000, int(HEAVY * total))
    heavy = cut(entries.where(many).drop("n_rows"))
    light = entries.where(~many).drop("n_rows")
    if heavy.isEmpty():
        return rows.join(light, key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return rest.unionByName(rows.join(F.broadcast(heavy), key))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batched(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most_bytes or len(held) >= most_rows:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def held_out(modulus: int, rest: int) -> Column:
    """Rows set aside: crc32 of the doc_id as text has this remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


def bounded_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` of the rows, chosen by a hash of their doc_id: the same at every run and partitioning."""
    return ids.orderBy(F.xxhash64("doc_id"), *(c for c in ids.columns)).limit(most)


def one_text_each(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text and more) of few doc_ids, one row for each: where a doc_id has several, the first by its text's hash, then by the other columns, so that a bound on doc_ids is one on rows."""
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    more = [c for c in rows.columns if c not in ("doc_id", "text")]
    first = F.min_by(F.struct("text", *more), F.struct(F.xxhash64("text"), *more))
    return rows.groupBy("doc_id").agg(first.alias("held")).select("doc_id", "held.*").select(*rows.columns)
