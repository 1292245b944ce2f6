"""Contracts, recorded answers, records of services, and operators that no query over the tables shows."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from auditlake.operators import batches, cohorts, forest, gates, knowledge, ordered, references, retrieval, sections, tables, targets, totals
from auditlake.plans.ordered import LETTER_SQL
from auditlake.sources import contracts
from auditlake.streaming import journal


def put(path, body):
    path.write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return str(path)


def test_contracts_are_read_or_refused(spark, tmp_path):
    good = put(tmp_path / "a.json", "﻿" + json.dumps({"_remark": "x", "population_basis": {"treated": ["got a dose", "was treated"]}, "analysis_set": {"itt": ["as meant"]}, "randomisation_stated": ["at random"]}))
    axes = contracts.read_phrases(spark, good)
    got = spark.createDataFrame([("All who got a dose, as meant, at random.",), ("none",)], "t string").select(retrieval.population(F.col("t"), axes).alias("p")).collect()
    assert [got[0].p[a].value for a in axes] == ["treated", "itt", "true"] and got[1].p.population_basis is None
    with pytest.raises(ValueError, match="not known"):
        contracts.read_phrases(spark, put(tmp_path / "b.json", {"population_basis": {"guessed": ["x"]}}))
    assert contracts.read_aliases(spark, put(tmp_path / "c.json", {"_doc": ["x"], "red": ["r", 1], "odd": "no"})) == {"red": ["r", "1"]}
    assert sorted(map(tuple, contracts.read_tolerances(spark, put(tmp_path / "d.json", {"age": 0.5, "*": 0.01})).collect())) == [("*", 0.01), ("age", 0.5)]


def test_declared_scopes(spark):
    rows = spark.createDataFrame([("Treated/ITT",), ("analysed",), (None,)], "t string")
    assert [tuple(r.s) for r in rows.select(contracts.declared_scope(F.col("t")).alias("s")).collect()] == [("treated", "itt"), ("analysed", None), (None, None)]
    with pytest.raises(Exception, match="not known"):
        spark.createDataFrame([("some/itt",)], "t string").select(contracts.declared_scope(F.col("t")).alias("s")).collect()


def test_knowledge_files(spark, tmp_path):
    seed = put(tmp_path / "seed.json", {"age": {"synonyms": ["years"], "scope": "cohort"}, "sex": {"synonyms": ["m/f"]}})
    late, early = put(tmp_path / "b.json", {"age": {"synonyms": ["aged"], "scope": "study"}}), put(tmp_path / "A.json", {"age": {"scope": "first"}, "new": {"synonyms": []}})
    got = {r.field_type: r for r in contracts.read_runtime_knowledge(spark, seed, [late, early]).collect()}
    assert set(got) == {"age", "sex", "new"} and got["age"].scope == "study" and got["age"].synonyms == ["years", "aged"]
    entries = contracts.read_runtime_knowledge(spark, seed, [])
    contracts.write_knowledge(entries, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    one, other = (knowledge.fingerprint(entries.repartition(n)).first().fingerprint for n in (1, 3))
    assert one == other != knowledge.fingerprint(entries.where("field_type = 'age'")).first().fingerprint


def test_recorded_answers(spark):
    recorded = spark.createDataFrame([("a", 1, 1, "old"), ("a", 1, 2, "new"), ("b", 1, 1, "x")], "q string, n int, at int, answer string")
    asked = spark.createDataFrame([("a", 1), ("c", 1)], "q string, n int")
    assert {r.q: r.answer for r in contracts.replayed(asked, recorded, ["q", "n"], cache_only=False).collect()} == {"a": "new", "c": None}
    assert contracts.replayed(asked.where("q = 'a'"), recorded, ["n", "q"]).first().answer == "new"
    with pytest.raises(Exception, match="no answer is recorded"):
        contracts.replayed(asked, recorded, ["q", "n"]).collect()


def test_annotated_cells(spark, tmp_path):
    cell = {"document_id": "d", "table_id": "t", "row_id": "r", "column_id": "c", "raw_value": "1", "normalized_value": "1", "blank_kind": "value", "source_locator": "p"}
    rows = [cell, cell | {"row_id": "s", "raw_value": ""}, cell | {"row_id": "u", "blank_kind": "merged"}, cell | {"row_id": "v", "table_id": ""}, cell | {"row_id": "w"}, cell | {"row_id": "w"}]
    got = contracts.read_gold(spark, put(tmp_path / "gold.jsonl", "\n".join(map(json.dumps, rows))))
    assert sorted((r.row_id, r.fault) for r in got.collect() if r.fault) == [("s", "no value"), ("u", "value in a blank"), ("v", "no identity"), ("w", "annotated twice"), ("w", "annotated twice")]


def test_records_of_services(spark):
    alex = {"doi": "https://doi.org/10.1/A", "display_name": "On", "publication_year": 2001, "authorships": [{"author": {"display_name": "B"}}, {"author": {}}], "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/12345"}, "open_access": {"is_oa": False, "oa_url": "no"}, "locations": [{"is_oa": False, "pdf_url": "x"}, {"is_oa": True, "pdf_url": "y"}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}
    cross = {"DOI": "10.1/B", "title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2002, 1]]}, "alternative-id": ["99", "654321"]}
    rows = spark.createDataFrame([(1, json.dumps(alex))], "id int, record string")
    [w] = contracts.openalex_candidates(rows).collect()
    assert (w.doi, w.title, w.authors, w.year, w.pmid, w.pdf_url, w.abstract) == ("10.1/a", "On", ["B"], 2001, "12345", "y", "a b a")
    [c] = contracts.crossref_candidates(spark.createDataFrame([(1, json.dumps(cross))], "id int, record string")).collect()
    assert (c.doi, c.title, c.authors, c.year, c.pmid) == ("10.1/b", "T", ["A B", "C"], 2002, "654321")
    text = spark.range(1).select(contracts.fallback_text(F.lit("T"), F.array(F.lit("A")), F.lit(""), F.lit(2001)).alias("t")).first().t
    assert text.startswith("Title: T\nAuthors: A\nYear: 2001\n\n[Full text")
    tiers = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "id int, tier int, text string")
    assert {r.id: r.text for r in references.first_tier(tiers, "id").collect()} == {1: "a", 2: "c"}
    assert [r.o for r in spark.createDataFrame([("pmc",), ("local_pdf_title",), ("",), ("openalex_pdf",)], "k string").select(references.origin(F.col("k")).alias("o")).collect()] == ["PMC (online)", "uploaded (matched by title)", "not retrieved", "OpenAlex (online)"]


def test_journal_at_rest(spark, tmp_path):
    steps = spark.createDataFrame([("r", 1, "gate"), ("r", 2, "show"), ("r", 3, "note")], "run_id string, index long, kind string")
    said = spark.createDataFrame([("r", 1, 1, "drop"), ("r", 1, 2, "keep")], "run_id string, index long, at int, decision string")
    assert {r["index"]: r.decision for r in journal.decided(steps, said).collect()} == {1: "keep", 2: "show", 3: "silent"}
    lines = spark.sql("select 'r' as run_id, 1L as index, timestamp'2020-01-01' as ts, 's' as stage, 't' as title, 0 as warnings")
    journal.append_steps(lines, str(tmp_path / "j"))
    journal.append_steps(lines.withColumn("index", F.lit(2).cast("long")), str(tmp_path / "j"))
    assert journal.latest(journal.read_steps(spark, str(tmp_path / "j"))).first()["index"] == 2


def test_places_in_a_large_part(spark):
    """Stretches give the places that one sort would, and letters go on past three."""
    rows = spark.range(40_000).selectExpr("id % 2 as part", "cast((id * 7919) % 40009 as long) as v", "id")
    got = ordered.numbered(rows, ["part"], "v").orderBy("part", "v").collect()
    for part in (0, 1):
        mine = [r for r in got if r.part == part]
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
    shown = duckdb.sql(f"SELECT {LETTER_SQL} FROM range(18270, 18290) t(i)").fetchall()
    from auditlake.functions.text import letter

    assert [r.x for r in spark.range(18270, 18290).select(letter(F.col("id")).alias("x")).collect()] == [x for (x,) in shown]
    held = rows.selectExpr("part", "id", "cast(v % 100 + 1 as long) as size")
    plain = ordered.within_budget(held, ["part"], [F.desc("size"), F.col("id")], "size", 5000)
    assert sorted(plain.collect()) == sorted(ordered.within_budget(held, ["part"], [F.desc("size"), F.col("id")], "size", 5000, -F.col("size")).collect())


def test_arms_are_assigned_all_at_once(spark):
    review = spark.createDataFrame([(1, "a", "red"), (1, "b", "red plus blue"), (2, "a", "x"), (3, "a", "red"), (3, "b", "blue")] + [(4, f"k{i}", f"w{i}") for i in range(8)], "study int, arm string, label string")
    paper = spark.createDataFrame([(1, "Blue plus red group"), (1, "red group"), (2, "y"), (3, "red blue"), (3, "blue red arm"), (4, "w1")], "study int, label string")
    got = {(r.study, r.arm): (r.label, r.reason) for r in targets.assign_arms(review, paper).collect()}
    assert got == {(1, "a"): ("red group", None), (1, "b"): ("Blue plus red group", None), (2, None): (None, "no likeness"), (3, None): (None, "ambiguous"), (4, None): (None, "too many arms")}


def test_tables_without_ids_or_sense(spark):
    xml = ["<a", "<a><table-wrap><table><tr><td colspan='x'>h</td></tr><tr><td>1</td><td rowspan='2'>2</td></tr><tr><td>3</td><td>4</td></tr></table></table-wrap></a>", None, "<a><table-wrap id='q'/></a>"]
    cells = tables.cells_from_xml(spark.createDataFrame(list(enumerate(xml)), "doc_id long, xml string"))
    got = {(r.doc_id, r.table_id, r["head"], r.r, r.c): r.text for r in cells.collect()}
    assert got == {(1, "table_1", True, 0, 0): "h", (1, "table_1", False, 0, 0): "1", (1, "table_1", False, 0, 1): "2", (1, "table_1", False, 1, 0): "3", (1, "table_1", False, 1, 1): "2", (1, "table_1", False, 1, 2): "4"}
    label = spark.createDataFrame([("median (range)",), ("Median age",), ("",)], "l string")
    assert [r.x for r in label.select(tables.is_continuation(F.col("l")).alias("x")).collect()] == [True, False, False]


def test_small_decisions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(forest.has_grid(lit("Forest\nBerg et al. 2001 3 10 0.5\n"))) and not one(forest.has_grid(lit("Berg 2001 3.5 x")))
    grids = {"Smith J 2010 3 40": True, "Smith J et al. 2010 3 40": True, "Smith J. K. 2010 3 40": True, "van Berg 2010a 3 40": True, "2010 3 40": False, "Smith 2010 3": False, "Smith 20101 3 40": False, "12 2010 3 40": False, "et al 2010 3 4": True, "(Smith 2010 3.5 4 5 6": True}
    assert {t: one(forest.has_grid(lit(t))) for t in grids} == grids
    assert [one(forest.kind_note(lit("Total"), lit("study"))), one(forest.kind_note(lit("Berg"), lit("summary"))), one(forest.kind_note(lit("Berg"), lit("")))] == ["looks like a summary", "looks like a study", None]
    assert one(sections.missed_forest(lit("a Forest plot"), F.array(lit("table")))) and one(sections.clipped(lit(" a  b c"), 2)) == "a b"
    assert one(sections.without_references(lit("x" * 300 + "\nReferences\n1"))) == "x" * 300 + "\n"
    assert one(batches.search_query(F.array(lit("a"), lit("b")), lit("raw"), lit("2001:2002"))) == "a AND b AND (2001:2002[dp])" and one(batches.without_field_tags(lit("a[ti]  or b [mesh]"))) == "a or b"
    assert [one(batches.count_difference(lit(a), lit(b))) for a, b in ((None, 3), (0, 0), (5, 0), (10, 6), (100, 93), (100, 99))] == ["none", "none", "zero", "major", "minor", "none"]
    assert one(batches.escalates(lit("not_comparable"), lit("value could not be parsed"), lit("warm"), lit("hot"))) and not one(batches.escalates(lit("not_comparable"), lit("value could not be parsed"), lit("NR"), lit("hot")))
    assert one(batches.declared_id(lit(" "), lit(None), lit(" x "))) == "x" and one(batches.claim_locator(lit(1), lit(None), lit("b"))) == "1||b"
    assert one(batches.leaked(lit("use foo here"), ["foo", "bar"])) == ["foo"]
    assert one(batches.answer_json(lit("<think>{}</think> so\n```json\n{\"a\": 1}\n``` or {"))) == '{"a": 1}' and one(batches.answer_json(lit("none"))) is None
    assert one(totals.moment(lit(" Week-12. "))) == "week 12" and one(references.resolvable(lit(""), lit("unresolved: x"))) is False
    assert one(knowledge.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0)))) == 0 and abs(one(knowledge.cosine(F.array(lit(1.0), lit(1.0)), F.array(lit(2.0), lit(2.0)))) - 1) < 1e-12


def test_intervals_need_defined_draws(spark):
    clusters = spark.createDataFrame([("a", "x", 1, 0), ("a", "y", 0, 0)], "d string, c string, good int, n int")
    got = gates.bootstrap(clusters, "d", "c", draws=20).first()
    assert got.lower is None and got.note
    whole = gates.bootstrap(spark.createDataFrame([("x", 1, 2), ("y", 2, 2)], "c string, good int, n int"), None, "c", draws=40).first()
    assert 0.5 <= whole.lower <= whole.upper <= 1 and whole.note is None
    rows = spark.createDataFrame([(1, "e", 2), (2, "e", 1), (3, "f", 3)], "v int, execution_id string, at int")
    assert {r.execution_id: r.v for r in batches.once(rows, "execution_id", "at").collect()} == {"e": 2, "f": 3}
    assert gates.added_columns(rows, rows.withColumn("w", F.lit(1))) == ["w"]


@pytest.mark.parametrize("k", [7, 100, 101])
def test_intervals_are_as_wide_as_theory_says(spark, k):
    """Clusters of one claim each: the mean of k of them deviates by the root of p(1 - p) / k."""
    clusters = spark.createDataFrame([(i, int(i % 10 < 3), 1) for i in range(k)], "c int, good int, n int")
    got = gates.bootstrap(clusters, None, "c").first()
    p = sum(i % 10 < 3 for i in range(k)) / k
    assert abs(got.point - p) < 1e-6 and got.draws == 2000 and got.note is None and got.lower <= p <= got.upper
    assert abs((got.upper - got.lower) / (2 * 1.96 * (p * (1 - p) / k) ** 0.5) - 1) < (0.25 if k < 10 else 0.1)


def test_draws_are_the_same_however_they_are_made(spark, monkeypatch):
    rows = [(d, i, i % 3, 2 + i % 2) for d, k in ((None, 1), ("a", 40), ("b", 3), ("c", 2100)) for i in range(k)]
    clusters = spark.createDataFrame([*rows, ("e", 1, 0, 0)], "d string, c int, good int, n int")
    got = [gates.bootstrap(clusters, "d", "c", draws=60).first()]
    monkeypatch.setattr(gates, "SLOTS", 17)
    got.append(gates.bootstrap(clusters.repartition(7), "d", "c", draws=60).first())
    monkeypatch.setattr(gates, "TOLD", 5)
    got.append(gates.bootstrap(clusters.repartition(3), "d", "c", draws=60).first())
    assert got[0] == got[1] == got[2] and got[0].note is None
    assert gates.bootstrap(clusters.where("c = 0"), "d", "c", draws=60).first().note == "no domain has two clusters"
    empty = gates.bootstrap(clusters.where("false"), "d", "c", draws=60).first()
    assert empty.lower is None and empty.note and empty.point is None
    other = gates.bootstrap(clusters, "d", "c", draws=60, seed=5).first()
    assert (other.lower, other.upper) != (got[0].lower, got[0].upper)


def test_places_are_found_once_and_fast(spark):
    """Places of many matches in one long text, against Python's, in time that grows with the text."""
    import re
    import time

    from auditlake.functions import text as T
    from auditlake.operators import anchoring

    long = " ".join(f"n {i % 97} x" for i in range(8000))
    held = spark.createDataFrame([(long,), ("",), (None,), ("7",), ("a 7 7a",)], "t string")
    began = time.time()
    got = [[tuple(m) for m in r[0]] for r in held.select(T.matches(F.col("t"), "[0-9]+")).collect()]
    assert got == [[(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", t or "")] for t in (long, "", None, "7", "a 7 7a")]
    got = [r[0] for r in held.select(T.occurrences(F.col("t"), F.lit("n 7 x"))).collect()]
    assert got[0] == [m.start() for m in re.finditer("n 7 x", long)] and got[1:] == [[], [], [], []]
    places = held.select(anchoring.nearest(T.occurrences(F.col("t"), F.lit("7")), T.occurrences(F.col("t"), F.lit("a")))).collect()
    assert [tuple(r[0]) if r[0] else None for r in places] == [None, None, None, None, (1, 4, 5)]
    assert time.time() - began < 10


@pytest.mark.parametrize(
    "said, want",
    [
        ("hr 0.5 (95% ci 0.4-0.7)", [(95, 0.4, 0.7)]), ("95 % confidence interval: -1.2 to -0.3", [(95, -1.2, -0.3)]), ("90.5% ci 2, 3 and 99%ci 1–4", [(90.5, 2, 3), (99, 1, 4)]), ("95% cigarettes 1 to 2", []),
        ("95% ci of the whole population 1 to 2", []), ("5% ci 1 to 2", []), ("95% ci 1 or 2", []), ("95% ci -1--2", [(95, -1, -2)]), ("95% ci", []), ("", []),
    ],
)
def test_printed_intervals(spark, said, want):
    from auditlake.operators import anchoring

    [row] = spark.createDataFrame([(said,)], "t string").select(anchoring.printed_intervals(F.col("t"))).collect()
    assert [(x.level, x.lower, x.upper) for x in row[0]] == want


def test_restated_readings(spark):
    """Titles, ids and headers are read as before, accents composed or not."""
    one = lambda c: spark.range(1).select(c).first()[0]
    from auditlake.functions import text as T

    lit = F.lit
    assert one(references.title_key(lit("Caf\u0065\u0301 &amp; \u03b2-blockers\u2014why?"))) == one(references.title_key(lit("CAF\u00c9 & \u03b2-Blockers-Why"))) == "caf\u00e9 & beta-blockers-why"
    assert one(T.composed(lit("o\u0308ne \u00e9 n\u0303 x\u0301"))) == "\u00f6ne \u00e9 \u00f1 x\u0301" and one(T.composed(lit(None).cast("string"))) is None
    assert one(references.title_key(lit("a &amp;lt; b"))) == "a < b"
    ids = {"PMID: 12345": "12345", "x pmid 123456789; PMID:  234567.": "234567", "XPMID: 12345": "", "PMID 1234": "", "pmid12345678": "12345678", "PMID 12345a": "", "": ""}
    assert {t: one(T.printed_pmid(lit(t))) for t in ids} == ids
    heads = {"Events drug": ("events", "drug"), "Drug - Events": ("events", "Drug"), "total": ("total", ""), "n Drug": ("n", "Drug"), "n": None, "Events x Total": ("events", "x Total"), "Mean": None, "": None}
    assert {h: (x := one(tables.measure_of(lit(h)))) and tuple(x) for h in heads} == heads
    summaries = {"Total": True, " total  events ": True, "Totals": False, "Test for overall effect": True, "Testing": False, "Heterogeneity: Tau": True, "Subtotal (95% CI)": True, "Berg total": False, "": False}
    assert {t: one(forest.is_summary(lit(t))) for t in summaries} == summaries
