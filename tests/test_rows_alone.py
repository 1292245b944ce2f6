"""Work on a text needs no other row."""

import numpy as np
from pyspark.sql import functions as F

from auditlake.operators import lookup, retrieval, sections
from auditlake.plans import review


def test_sections_of_a_text_are_chosen_in_its_row(spark, sf):
    plan = review.core_sections(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1


def test_core_sections_row_by_row(spark):
    fill = "word " * 400
    marked = f"Start \n## Introduction\n{fill}\n##  Results of it \n{fill}\n\n## Discussion\n{fill}\n## Table 1"
    lines = f"intro\nMethods:\n{fill}\n2. Results\n{fill}\nReferences\n{fill}"
    two = f"a\nMethods\n{fill}\nResults\n{fill}"
    rows = [(1, marked), (1, lines), (None, lines), (2, two), (3, "## Methods\nshort"), (4, None)]
    got = sections.core_sections(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    kept = f"Start\n\n## Results of it\n{fill.rstrip()}\n\n## Table 1\n"
    by_line = f"Methods:\n{fill.rstrip()}\n\n2. Results\n{fill.rstrip()}"
    want = [(1, kept, True), (1, by_line, True), (None, by_line, True), (2, two, False), (3, "## Methods\nshort", False), (4, "", False)]
    assert [(r.doc_id, r.text, r.filtered) for r in got] == want


def test_windows_as_stated(spark):
    text = "Title\nIntroduction\nx\n1. Methods\nm\nResults\n" + "r" * 60 + "\nDiscussion\nd\nReferences\n1"
    seen = spark.createDataFrame([(text,), ("plain " * 100 + "\nReferences\n1",), (None,)], "t string").select(sections.windows(F.col("t")).alias("w")).select("w.*")
    assert [tuple(r) for r in seen.collect()] == [
        ("Title\n", "Results\n" + "r" * 60 + "\n", "1. Methods\nm\nResults\n" + "r" * 60 + "\n"),
        ("plain " * 100 + "\nReferences\n1", "plain " * 100 + "\n", "plain " * 100 + "\n"),
        ("", "", ""),
    ]


def test_keywords_are_counted_where_the_texts_are(spark, sf):
    """What leaves a task is a few entries a query, not a row for each pair that shares a word."""
    rng = np.random.default_rng(2)
    line = lambda n: [f"w{i}" for i in rng.integers(0, 60, n)]
    asked = [(q, line(8)) for q in (*range(30), 7)] + [(99, ["none"]), (98, [])]
    said = [(f"d{i}", line(rng.integers(0, 30))) for i in (*range(900), 5)] + [("e", None), (None, line(20))]
    queries, entries = spark.createDataFrame(asked, "query int, words array<string>"), spark.createDataFrame(said, "name string, words array<string>").repartition(3)
    found = retrieval.by_keywords(queries, entries, 5)
    sets = lambda rows: {k: {w for x, ws in rows if x == k for w in ws or []} for k, _ in rows}
    have, want = sets(said), set()
    for q, words in sets(asked).items():
        hits = sorted((-len(words & have[d]), d is not None, d or "", d) for d in have)
        hits = [(d, -n) for n, *_, d in hits if n] or [(d, 0) for _, d in sorted((d or "", d) for d in have)]
        want |= {(q, d, n, i + 1) for i, (d, n) in enumerate(hits[:5])}
    assert {tuple(r) for r in found.select("query", "name", "shared", "rank").collect()} == want
    held = retrieval._most_shared(queries.toArrow(), 5)
    out = list(held(iter(entries.toArrow().to_batches(max_chunksize=100))))
    assert sum(b.num_rows for b in out) <= 5 * len(asked)


def test_tables_are_found_by_their_axes_alone(spark):
    """Only the columns that are asked for are worked out, and what claims say in the same words is put into normal form once, also where a word is missing."""
    cells = spark.createDataFrame([(1, "t", "", h, r, c, x) for h, r, c, x in ((True, 0, 1, "Red (n = 4)"), (False, 0, 0, "Weight"), (False, 1, 0, "Weight"), (False, 1, 1, "7"))], "source long, table_id string, caption string, head boolean, r int, c int, text string")
    some = lookup.table_records(cells, *lookup.AXES)
    assert some.columns == ["source", "table_id", *lookup.AXES]
    [whole] = lookup.table_records(cells).select("rows", *lookup.AXES).collect()
    assert [tuple(whole[c] for c in lookup.AXES)] == [tuple(r[c] for c in lookup.AXES) for r in some.collect()]
    assert whole.rows == [["Weight", ""], ["Weight", "7"]] and whole.row_words == ["weight"] and whole.row_text == "Weight | Weight"
    said = [("a", 1, None, "red", None, None, ["weight"]), ("b", 2, None, "red", None, None, ["weight"]), ("c", 1, " Mean ", None, None, [], None), ("d", 1, "x_y", "all", "", ["z"], [])]
    claims = spark.createDataFrame([(*c, "") for c in said], "claim string, source long, kind string, group string, cohort string, variants array<string>, names array<string>, mapped string")
    asked = lookup.asked(claims)
    assert "regexp_replace" not in asked._jdf.queryExecution().executedPlan().toString()
    got = {r.claim: (r.kind, r.combined, r.fields, r.cohorts) for r in asked.collect()}
    assert got == {"a": ("", False, ["weight"], ["red"]), "b": ("", False, ["weight"], ["red"]), "c": ("mean", True, ["mean"], []), "d": ("x_y", True, ["x y"], [])}
    found = {r.claim: (r.status, r.matched) for r in lookup.locate_tables(asked, some).collect()}
    assert found == {"a": ("unique", ["t"]), "b": ("no_tables", []), "c": ("none", []), "d": ("none", [])}
