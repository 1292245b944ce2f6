"""Claim files, knowledge files and the run journal."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.functions.numeric import coarser, components, is_missing, plain_commas, with_cells
from auditlake.functions.text import clean_pdf, contains_words, flat, folded, kept_doi, letter, normal, normal_pmid, occurrences, printed_dois, printed_pmid, shared_share, supports
from auditlake.operators.compare import compare_values
from auditlake.operators.matching import pair_or_refuse, unique_or_refuse
from auditlake.sources.tables import read_claims, read_knowledge, read_studies
from auditlake.streaming.journal import LINE, latest, read_journal, stage_windows, write_once


def test_claims_of_a_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿review_data_id,study_id,group,timepoint,field_type,value,unit\n1,s1,,,mean,\"1,234\",mm\n2,,g,t,mean,5,\n,s2,g,t,sd,\"a\n\"\"b\"\"\",\n", encoding="utf-8")
    got = [tuple(r) for r in read_claims(spark, str(tmp_path / "c.csv")).orderBy("study_id").collect()]
    assert got == [("1", "s1", "-", "single", "mean", "1,234", "mm"), (None, "s2", "g", "t", "sd", 'a\n"b"', None)]


def test_studies_and_knowledge(spark, tmp_path):
    (tmp_path / "s.csv").write_text("study_id,review_citation,reported_N,doi\na,A 2001,120,10.1/x\nb,B 2002,about 50,\n")
    assert [r.reported_n for r in read_studies(spark, str(tmp_path / "s.csv")).orderBy("study_id").collect()] == [120, None]
    (tmp_path / "k.json").write_text(json.dumps({"age": {"synonyms": ["years old"], "plausible_range": [0, 120]}, "n": {}}))
    got = {r.field_type: r.synonyms for r in read_knowledge(spark, str(tmp_path / "k.json")).collect()}
    assert got == {"age": ["years old"], "n": None}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [("7,310", "7310"), ("2,005,117,940", "2005117940"), ("31,870,226,904 kg", "31870226904 kg"), ("45,1278", "451278"), ("8,4", "8.4"), ("0,250", "0.250"), ("77,05", "77.05"), ("9876,543", "9876543"), ("x, y", "x, y"), ("3,141 and 2,7", "3141 and 2.7")],
)
def test_commas(spark, text, want):
    assert one(spark, plain_commas, text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("8.14 ± 2.05", ("spread", 8.14, 2.05)), ("61 (44.0-70.5), iqr", ("reach", 61.0, 13.25)), ("-7 (-11--2)", ("reach", -7.0, 4.5)), ("1.31 (90 % CI 1.02 to 1.69)", ("interval", 1.31, None)),
        ("1.31 [90% confidence interval (1.02, 1.69]", ("interval", 1.31, None)), ("rate < 0.04", ("bound", 0.04, None)), ("rate<0.04", ("plain", 0.04, None)), ("blank", ("none", None, None)),
        ("18/72 (25%)", ("events", 18.0, None)), ("9.9 +- 3", ("spread", 9.9, 3.0)), ("3 / 4 / 5", ("plain", 3.0, None)), ("12.5 %", ("percentage", 12.5, None)), (None, ("none", None, None)),
    ],
)
def test_cells(spark, text, want):
    got = with_cells(spark.createDataFrame([(text,)], "v string"), x=F.col("v")).first().x
    assert (got.form, got.primary, got.spread and round(got.spread, 6)) == want


def test_intervals_and_parts(spark):
    rows = spark.createDataFrame([("1.31 (90% CI 1.69 to 1.02)",), ("18/72 (25%)",), ("≥ 3",), ("4 ± 1",)], "v string")
    got = [(r.x, r.parts) for r in with_cells(rows, x=F.col("v")).withColumn("parts", components(F.col("x"))).collect()]
    assert (got[0][0].ci_lower, got[0][0].ci_upper, got[0][0].ci_level) == (1.02, 1.69, 90.0)
    assert (got[1][0].events, got[1][0].total, got[1][0].pct) == (18, 72, 25.0)
    assert got[2][0].operator == ">="
    assert [p for _, p in got] == [["ci", "ci_level"], ["events", "pct"], ["operator"], ["sd"]]


@pytest.mark.parametrize("a,b,want", [("4.25 ± 1.18", "4.2 ± 1.2", True), ("4.25", "4.3", False), ("4.31", "4.3", True), ("4.3", "4.31", False), ("4.31", "4.31", False), ("x", "4", False), ("4.31 ± 0.5", "4.3 ± 0.9", False)])
def test_coarser_numbers(spark, a, b, want):
    rows = with_cells(spark.createDataFrame([(a, b)], "a string, b string"), x=F.col("a"), y=F.col("b"))
    assert rows.select(coarser(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("c")).first().c is want


def test_small_expressions(spark):
    assert one(spark, is_missing, " Not Reported ")
    letters = [r.x for r in spark.range(0, 20000).select(letter(F.col("id")).alias("x")).collect()]
    assert letters[:2] + letters[25:28] + [letters[i] for i in (701, 702, 18277, 18278)] == ["A", "B", "Z", "AA", "AB", "ZZ", "AAA", "ZZZ", "AAAA"] and len(set(letters)) == 20000
    share = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(shared_share(F.col("a"), F.col("b")).alias("x")).first().x
    assert share(["red"], ["red", "over", "green"]) == 0.5 and share(["x"], []) == 0
    quote = "the gap was 7.2 days (90% range as stated, 5.1 to 12.8)"
    assert one(spark, lambda c: supports(F.lit(quote), c), "7.2 (90% range 5.1-12.8)") is False  # a hyphen before a digit is a sign
    assert one(spark, lambda c: supports(F.lit(quote), c), "90 5.1 12.8")
    assert one(spark, lambda c: supports(c, F.lit("5 9")), "between 5\n and 9 of Größe")


def test_names_and_identifiers(spark):
    assert one(spark, folded, "Çağlar Ørsted-Łukasz ﬁne Straße") == "Caglar Orsted-Lukasz fine Strasse"
    assert one(spark, normal, "Äpfel con-\n   tain ½ fluß²") == "apfel contain 1 2 flu 2"
    assert one(spark, flat, "A  B\tcon-\n tain") == "a b con-tain"
    assert one(spark, clean_pdf, "4\x01 1\u2009kg\x03\tx") == "4± 1 kg\tx"
    assert one(spark, printed_dois, "as in <https://doi.org/10.5072/Q-1.>, doi:10.50721/z(7)]; 10.1/no 10.5072/Q-1/ .") == ["10.5072/q-1", "10.50721/z(7", "10.5072/q-1"]
    kept = lambda a, b, c: spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(kept_doi(F.col("a"), F.col("b"), F.col("c")).alias("x")).first().x
    assert [kept("10.5072/AA", "see 10.5072/ aa", ""), kept("10.5072/zz", "only 10.5072/b.", ""), kept("10.5072/zz", "10.5072/b 10.5072/c", ""), kept(None, None, None)] == ["10.5072/aa", "10.5072/b", "", ""]
    assert [one(spark, printed_pmid, "A study. PMID: 1234567."), one(spark, normal_pmid, "https://pubmed.ncbi.nlm.nih.gov/987654"), one(spark, normal_pmid, "1234")] == ["1234567", "987654", ""]
    assert one(spark, lambda c: occurrences(c, F.lit("a.b")), "a.b xa.b axb") == [0, 5]
    assert one(spark, lambda c: contains_words(c, F.lit("dm")), "admission of dm") and not one(spark, lambda c: contains_words(c, F.lit("dm")), "admission")


def test_an_agreeing_interval_settles_a_pair(spark):
    """Point estimates aren't compared where intervals agree."""
    rows = spark.createDataFrame([("0.62 (95% CI 0.48 to 0.81)", "0.70 (95% CI 0.48 to 0.81)"), ("0.62 (95% CI 0.48 to 0.81)", "0.62"), ("10 ± 2", "10 ± 2.5"), ("< 0.05", "0.03"), ("< 0.05", "0.06"), (None, "3"), ("x", "3")], "a string, b string").withColumn("u", F.lit(""))
    got = [(r.label, r.mode, r.review_required) for r in compare_values(rows, "a", "b", "u", "u").collect()]
    assert got == [("match", "structured", False), ("match", "structured", True), ("mismatch", "numeric", False), ("not_comparable", "structured", False), ("mismatch", "structured", False), ("not_comparable", "numeric", False), ("not_comparable", "numeric", False)]


def test_pairs_and_refusals(spark):
    side = "id string, key string, cell long, pos long, value double"
    review = spark.createDataFrame([("a", "k1", 1, 1, 1.0), ("b", "k1", 2, 2, 2.0), ("b", "k2", 3, 3, 3.0), ("c", "k3", 4, 4, 4.0), (None, "k4", 5, 5, 5.0), (None, "k5", 6, 6, 6.0), (None, "k6", 7, 7, 7.0), (None, "k6", 8, 8, 8.0), ("m", "k7", 9, 9, 9.0)], side)
    source = spark.createDataFrame([("a", "k1", 1, 1, 1.5), ("c", "k9", 4, 4, 4.5), (None, "k4", None, 5, 5.5), (None, "k6", 8, 7, 8.4), (None, "k6", 8, 8, 8.5), (None, "k7", 9, 9, 9.5), (None, "kx", 1, 1, 0.5), ("z", "k1", 1, 1, 0.1)], side)
    got = sorted((r.side, r.reason, r.key, r.review_value, r.source_value) for r in pair_or_refuse(review, source).na.fill(-1.0).collect())
    assert got == sorted([
        ("pair", "paired", "k1", 1.0, 1.5), ("review", "duplicate_claim_id", "k1", 2.0, -1.0), ("review", "duplicate_claim_id", "k2", 3.0, -1.0),
        ("review", "claim_identity_key_conflict", "k3", 4.0, -1.0), ("source", "claim_identity_key_conflict", "k9", -1.0, 4.5), ("pair", "paired", "k4", 5.0, 5.5),
        ("review", "no_source_evidence", "k5", 6.0, -1.0), ("review", "ambiguous_match_key", "k6", 7.0, -1.0), ("pair", "paired", "k6", 8.0, 8.5), ("source", "unclaimed_source", "k6", -1.0, 8.4),
        ("review", "claim_identity_missing", "k7", 9.0, -1.0), ("source", "claim_identity_missing", "k7", -1.0, 9.5), ("source", "unclaimed_source", "kx", -1.0, 0.5), ("source", "claim_identity_missing", "k1", -1.0, 0.1),
    ])


def test_ties_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.1), (2, "a", 0.2), (2, "a", 0.2)], "q int, x string, s double")
    assert {tuple(r) for r in unique_or_refuse(rows, ["q"], "s", "x").collect()} == {(1, 0.5, 2, None, "tie"), (2, 0.2, 1, "a", None)}


def test_stream_equals_batch(spark, tmp_path):
    at = tmp_path / "journal"
    at.mkdir()
    steps = [{"run_id": f"r{i % 3}", "index": i, "ts": f"2024-01-01T{i % 24:02d}:{i % 60:02d}:00Z", "stage": "read" if i % 2 else "judge", "title": f"t{i}", "warnings": i % 4} for i in range(60)]
    for part in range(3):
        (at / f"{part}.json").write_text("\n".join(map(json.dumps, steps[part * 20 : part * 20 + 20])))
    stream = read_journal(spark, str(at), 1)
    write_once(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    write_once(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()  # nothing is written twice
    batch = spark.read.schema(LINE).json(str(at))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
    assert {(r.run_id, r['index']) for r in latest(batch).collect()} == {("r0", 57), ("r1", 58), ("r2", 59)}
    query = stage_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("windows").collect()) == sorted(stage_windows(batch).collect())
