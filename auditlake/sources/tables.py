"""Reading tables, claim files and knowledge files."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an entry of a knowledge file.
ENTRY = "struct<synonyms:array<string>,unit_equivalences:array<string>,plausible_range:array<double>,scope:string,status:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys to as many tasks as a shuffle has, before costly work on each of them: what is a file of a few MB is read by one task, whatever its rows. Later groups and windows by the keys need no other exchange."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 8 << 20


def short_batches(spark: SparkSession) -> None:
    """From now on this session's batches of rows for Python have BATCH_BYTES at most, if they may have more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def settled(df: DataFrame) -> DataFrame:
    """Compute once what several branches use, in the shared folder of spark.checkpoint.dir, which outlives a lost executor. A local session without one gets a folder of its own; a cluster is refused, as its executors would each write to their own disk."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that end within it take their shuffle files with them. What a checkpoint was made from isn't read again, but else its files stay until the driver happens to collect its garbage, and those of all steps lie there at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def first_stated(df: DataFrame, *names: str, default: str | None = None) -> Column:
    """The first of several columns that is there and not blank, untrimmed."""
    held = [F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*held, F.lit(default))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark before the header is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims or evidence, one value a row. Rows without a study or a field can't be matched and go."""
    df = read_csv(spark, path)
    return df.select(
        first_stated(df, "review_data_id", "claim_id", "audit_id").alias("id"),
        first_stated(df, "study_id").alias("study_id"),
        first_stated(df, "group", default="-").alias("group"),
        first_stated(df, "timepoint", default="single").alias("timepoint"),
        first_stated(df, "field_type").alias("field_type"),
        first_stated(df, "value", "review_value", "source_value").alias("value"),
        first_stated(df, "unit", "source_unit").alias("unit"),
    ).where("study_id is not null and field_type is not null")


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    stated = first_stated(df, "reported_N", "reported_n")
    return df.select(first_stated(df, "study_id").alias("study_id"), first_stated(df, "review_citation", "citation").alias("citation"), F.when(stated.rlike("^[0-9]+$"), stated.cast("int")).alias("reported_n"), first_stated(df, "modality").alias("modality"), first_stated(df, "doi").alias("doi")).where("study_id is not null")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by field type, a row for each key."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("field_type", "entry")).select("field_type", "entry.*")
