"""Small steps run few tasks, and queries take their shuffle files with them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import common, simhash
from corpus_pipeline import drop_near_copies


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def tasks_of(spark, group, run):
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        got = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return got, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f"{at}/{f}" for d in dirs for at, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_few_links_are_joined_by_few_tasks(spark, many_partitions):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got, tasks = tasks_of(spark, "few links", lambda: {r.component for r in simhash.components(chain.coalesce(1)).collect()})
    assert got == {0}
    # a round took some hundred tasks before, of which most had no rows
    assert tasks < 60


def test_few_tasks_keep_many_rows_apart(spark, many_partitions):
    rows = spark.range(100).repartition(40)
    assert common.few_tasks(rows, 100).rdd.getNumPartitions() == 1
    assert common.few_tasks(rows, 3 * common.FILE_ROWS).rdd.getNumPartitions() == 4
    assert common.few_tasks(rows, 1 << 30).rdd.getNumPartitions() == 40


def test_queries_take_their_shuffle_files_with_them(spark, docs):
    spark.sparkContext._jvm.System.gc()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, had = shuffle_files(spark), spark.conf.get(name, None)
    drop_near_copies(spark, docs, None)
    # a query that only looks for a first row may leave a little
    left = {f: os.path.getsize(f) for f in shuffle_files(spark) - before}
    assert sum(left.values()) < 2_000
    assert spark.conf.get(name, None) == had


def test_links_that_span_an_entry_are_links_themselves():
    # a chain by three bits each, in any order: its ends are not linked, whatever comes first
    chain = np.array([(1 << 3 * i) - 1 for i in range(12)], np.uint64)
    for order in ([*range(12)], [*range(11, -1, -1)], [5, 0, 11, 3, 8, 1, 10, 2, 9, 4, 7, 6]):
        fp = chain[order]
        a, b = simhash.table_entry(fp, np.ones(12, bool), 3)
        assert len(a) == 11 and (a < b).all() and (np.bitwise_count(fp[a] ^ fp[b]) <= 3).all()
        parent = np.arange(12)
        simhash.spanning(a, b, parent)
        assert not parent.any()
