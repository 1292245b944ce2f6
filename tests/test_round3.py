"""What larger tables brought to light: years inside numbers, edges that are estimated twice, work that grew with a square."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditlake.operators import identity, knowledge, lookup, ordered, precedence, targets


def test_digits_of_a_longer_number_are_no_year(spark):
    years = {"s1999_2001": "2001", "Supp2001x 1999": "1999", "s12000_2001": "2001", "Berg2001": "2001", "Berg 2001a": "2001", "Berg 12001": None, "unal_2000_b": "2000", "none": None}
    rows = spark.createDataFrame([(t,) for t in years], "t string")
    assert {r.t: r.y for r in rows.select("t", identity.year_of(F.col("t")).alias("y")).collect()} == years
    studies = spark.createDataFrame([(f"s{k}_2001", f"Supp{k}x and others 2001") for k in (1, 199, 1990, 1999, 2001, 12000)], "study_id string, label string")
    claims = spark.createDataFrame([(t,) for k in (1999, 2001, 12000) for t in (f"Supp{k}x et al. 2001", f"Supp{k}x 1999", f"S{k}_2001")], "study_id string")
    got = sorted((r.study_id, r.resolved) for r in identity.relabelled(claims, studies).collect())
    assert got == sorted(x for k in (1999, 2001, 12000) for x in ((f"s{k}_2001", True), (f"s{k}_2001", True), (f"Supp{k}x 1999", False)))


def test_places_do_not_depend_on_the_order_in_which_rows_arrive(spark):
    def in_any_order(batches):
        import pandas as pd

        rows = pd.concat(list(batches))
        yield rows.iloc[np.random.default_rng().permutation(len(rows))]

    rows = spark.range(0, 300_000, 1, 1).select(F.lit(1).alias("part"), (F.col("id") * 7 % 300_007).alias("k")).mapInPandas(in_any_order, "part int, k long")
    # an exchange that is read twice may give its rows in two orders, as one that is made twice does
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert ordered.numbered(rows, ["part"], "k").select("place").distinct().count() == 300_000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_origins_meet_by_wordings_not_by_cells(spark):
    # many cells and labels of one table with few wordings: held against one another one by one they are 2.5 billion pairs
    n = 50_000
    labels = spark.range(n).select(F.lit("t").alias("table_id"), F.concat(F.lit("Col "), F.col("id") % 3).alias("column_path"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).cast("int").alias("row"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("value_source"), F.col("id").alias("pos"))
    cells = spark.range(n).select(F.col("id").alias("cell"), F.lit("t").alias("table_id"), F.concat(F.lit("Arm / col  "), F.col("id") % 4).alias("path"), (F.col("id") % 6).cast("int").alias("row"))
    held = [(f"col {i % 3}", i % 5 if i % 2 == 0 else None, f"s{i % 4}" if i % 7 else None) for i in range(500)]

    def expected(cell):
        path, row = f"col {cell % 4}", cell % 6
        mine = [x for x in held if x[0] == path]
        whole = [x[2] for x in mine if x[1] is None]
        by_row = next((x[2] for x in mine if x[1] == row), None)
        by_column = whole[0] if whole else None
        return by_row or by_column, "row" if by_row else "column" if by_column else None, len(set(whole)) > 1

    got = precedence.origins(cells, labels).select("cell", "value_source", "level", "conflict").collect()
    assert len(got) == n
    assert {(r.cell % 12, r.value_source, r.level, r.conflict) for r in got} == {(c, *expected(c)) for c in range(12)}


def test_studies_that_state_the_same_are_assigned_once(spark):
    # seven arms on both sides of each study: worked out one by one they took many minutes
    n = 20_000
    arms = spark.range(n).select(F.col("id").alias("study"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    review = arms.select("study", F.concat(F.lit("a"), F.col("i")).alias("arm"), F.concat(F.lit("drug x"), F.col("i")).alias("label"))
    paper = arms.select("study", F.concat(F.lit("Drug x"), F.col("i") + F.col("study") % 2, F.lit(" group")).alias("label"))
    began = time.time()
    got = targets.assign_arms(review, paper).groupBy("arm", "label", "reason").count().collect()
    assert time.time() - began < 100
    pairs = {(r.arm, r.label): r["count"] for r in got if r.reason is None}
    assert all(pairs[f"a{i}", f"Drug x{i} group"] == (n if i else n // 2) for i in range(7))


def test_a_block_of_queries_takes_bounded_memory():
    draw = np.random.default_rng(3)
    vectors, asked = draw.normal(size=(10_000, 8)), draw.normal(size=(4096, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(vectors))], ["id", "vector"])
    tracemalloc.start()
    rows = {}
    for got in knowledge._best_of(list(range(4096)), asked.tolist(), 3)(iter([batch])):
        for query, entry in zip(got.column("query").to_pylist(), got.column("id").to_pylist()):
            rows.setdefault(query, []).append(entry)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    score = asked @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    assert rows == {i: np.argsort(-score[i])[:3].tolist() for i in range(4096)}


def test_a_document_is_put_into_normal_form_once_however_many_values_it_is_asked_for(spark):
    # a document of 2 MB for 400 values
    document = spark.range(1).select(F.lit(1).alias("source"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200_000)), lambda i: F.concat(F.lit("Wé-"), i)), " ").alias("text"))
    said = spark.range(400).select(F.lit(1).alias("source"), F.concat(F.lit("we "), F.col("id") * 100, F.when(F.col("id") % 4 == 0, " and no").otherwise("")).alias("said"))
    began = time.time()
    assert lookup.verbatim(said, document).count() == 300
    assert time.time() - began < 60
