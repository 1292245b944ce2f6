"""Costly work on rows is dealt to many tasks before it starts, and is done once a row."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import cohorts, gates, tables
from auditlake.plans import capture, review, scores


def plan_lines(df):
    return df._jdf.queryExecution().sparkPlan().toString().splitlines()


def depth(lines, word):
    """The deepest lines that hold a word, counted from the root; -1 without one."""
    return max((i for i, line in enumerate(lines) if word in line), default=-1)


def dealt_before(df, word):
    """Whether all work with this word stands above an exchange that has the number of a shuffle."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return -1 < depth(lines, word) < depth(lines, "REPARTITION_BY_NUM")


def test_headers_are_read_once_and_by_many_tasks(spark):
    rows = [(t, i, h) for t in range(50) for i, h in enumerate(("Events A", "events B", "Total red (RD)", "n x", "blue total", None, "", "N"))]
    headers = spark.createDataFrame(rows, "table_id long, pos int, header string").coalesce(1)
    got = tables.header_arms(headers, ["table_id"])
    assert dealt_before(got, "regexp_replace")
    assert sum(line.count("regexp_replace(") for line in plan_lines(got)) == 1
    assert {(r.place, r.arm) for r in got.where("table_id = 3").collect()} == {(1, "A"), (2, "B"), (3, "RD"), (4, "blue")}
    assert got.groupBy("table_id").count().where("count <> 4").isEmpty()
    assert headers.select(tables.measure_of(F.col("header")).alias("m")).where("m is not null").count() == 250


def test_executions_are_checked_by_order_and_plans_in_one_count(spark, sf):
    got = scores.execution_checks(spark, sf)
    assert dealt_before(got, "collect_set")
    sets = lambda *xs: spark.createDataFrame([(x,) for x in xs], "claim_ids array<string>")
    found = gates.plan_difference(sets(["b", "a"], ["c"], ["c"], ["d"]), sets(["a", "b"], ["d"], ["e"], ["e"]))
    assert sorted((r.members, r.why) for r in found.collect()) == [("c", "not planned"), ("e", "not made")]
    assert sum("Aggregate" in line for line in plan_lines(found)) <= 2


def test_claims_that_say_the_same_are_judged_once(spark):
    claims = spark.range(0, 20_000, 1, 1).select((F.col("id") % 2).alias("review"), "id", F.element_at(F.array(*map(F.lit, ("red", "blue", "all"))), (F.col("id") % 3 + 1).cast("int")).alias("target"), F.when(F.col("id") % 4 == 0, "Red Arm").when(F.col("id") % 4 < 3, "blue ring").alias("label"))
    known = spark.createDataFrame([(0, "red", ["red arm", "red"]), (0, "blue", ["blue ring"])], "review long, key string, variants array<string>")
    met = cohorts.cohort_verdict(claims, known)
    joined = [line for line in plan_lines(met) if "Join" in line]
    assert len(joined) == 2
    # the second join, of claims with verdicts, is by more than a review's few wordings
    assert any("share" in line for line in joined)
    got = {(r.review, r.target, r.label): r.verdict for r in met.select("review", "target", "label", "verdict").distinct().collect()}
    assert got[(0, "red", "Red Arm")] == "ok" and got[(0, "red", "blue ring")] == "wrong_cohort" and got[(0, "all", "Red Arm")] == "ok" and got[(1, "red", "blue ring")] == "ok"
    assert met.count() == 20_000


def test_claims_meet_a_checklist_where_they_are(spark, sf):
    for query in (review.checklist_coverage, review.checklist_gaps, review.checklist_owners):
        lines = query(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not any("hashpartitioning(_key" in line for line in lines)
        assert any("REPARTITION_BY_NUM" in line for line in lines)


@pytest.mark.parametrize(
    ("query", "word"),
    [
        (capture.comparison_targets, "regexp_replace"),
        (capture.value_locality, "regexp_replace"),
        (capture.header_paths, "Window"),
        (review.local_papers, "regexp_replace"),
        (capture.binding_verdicts, "regexp_replace"),
    ],
)
def test_costly_rows_are_dealt_before_they_are_read(spark, sf, query, word):
    assert dealt_before(query(spark, sf), word)


def test_a_comparison_is_parsed_once(spark):
    rows = spark.createDataFrame([("Red_vs._blue",), ("a vs b vs c",), ("vs x",), (None,)], "t string")
    got = rows.select(cohorts.comparison(F.col("t")).alias("c"))
    assert [(r.c and tuple(r.c)) for r in got.collect()] == [("red", "blue"), None, None, None]
    assert sum(line.count("regexp_replace(") for line in plan_lines(got)) == 1
