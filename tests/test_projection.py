"""Claims answered from the readings of a batch, case by case."""

from auditlake.operators import projection

REVIEW = [("s", "red", "Red dose"), ("s", "blue", "Blue dose")]
#: batch, pos, shape, arm, left, right, basis, analysis_set, timepoint, value, usable
ENTRIES = [
    (1, 0, "arm", "Red group", None, None, "randomised", None, "", "10", True), (1, 1, "arm", "Red group", None, None, "treated", None, "", "9", True), (1, 2, "arm", "Blue group", None, None, "randomised", None, "", "8", True), (1, 3, "arm", "Blue group", None, None, "randomised", None, "", "8", True), (1, 4, "arm", "Blue group", None, None, None, None, "", "7", False),
    (2, 0, "arm", "Red group", None, None, None, None, "median follow-up", "5", True), (2, 1, "arm", "Red group", None, None, None, None, "end of study", "6", True), (2, 2, "arm", "Blue group", None, None, None, None, "baseline", "1", True), (2, 3, "arm", "Blue group", None, None, None, None, "baseline", "2", True),
    (3, 0, "comparison", None, "red dose", "blue dose", None, None, "", "0.7", True), (4, 0, "comparison", None, "Blue", "Red", None, None, "", "1.4", True), (5, 0, "comparison", None, "Red", "Blue", None, None, "", "0.5", True), (5, 1, "comparison", None, "the Red arm", "Blue group", None, None, "", "0.6", True),
    (6, 0, "study", None, None, None, "randomised", None, "", "1,018", True), (6, 1, "study", None, None, None, "treated", None, "", "990", True), (7, 0, "arm", "Red group", None, None, None, None, "", "1", False),
]
#: id, batch, shape, cohort_key, left, right, basis, required, timepoint, (status, value)
CASES = [
    ("scoped", 1, "arm", "red", None, None, "treated", ["basis"], "", ("ok", "9")), ("not scoped", 1, "arm", "red", None, None, None, [], "", ("contradictory", None)), ("agree", 1, "arm", "blue", None, None, None, [], "", ("ok", "8")), ("other people", 1, "arm", "blue", None, None, "treated", ["basis"], "", ("scope_unresolved", None)),
    ("no cohort", 1, "arm", None, None, None, None, [], "", ("unsupported", None)), ("no such arm", 1, "arm", "green", None, None, None, [], "", ("not_reported", None)), ("in time", 2, "arm", "red", None, None, None, [], "end of the study", ("ok", "6")), ("no such time", 2, "arm", "red", None, None, None, [], "day one", ("timepoint_unresolved", None)),
    ("one time", 2, "arm", "blue", None, None, None, [], "week", ("contradictory", None)), ("pair", 3, "comparison", None, "red", "blue", None, [], "", ("ok", "0.7")), ("turned pair", 4, "comparison", None, "red", "blue", None, [], "", ("unsupported", None)), ("two pairs", 5, "comparison", None, "red", "blue", None, [], "", ("ambiguous", None)),
    ("no pair", 1, "comparison", None, "red", "blue", None, [], "", ("not_reported", None)), ("no sides", 3, "comparison", None, "pink", "grey", None, [], "", ("unsupported", None)), ("printed", 6, "study", None, None, None, "randomised", ["basis"], "", ("ok", "1,018")), ("printed and added", 6, "study", None, None, None, "treated", ["basis"], "", ("contradictory", None)),
    ("two totals", 6, "study", None, None, None, None, [], "", ("contradictory", None)), ("others' total", 6, "study", None, None, None, "enrolled", ["basis"], "", ("scope_unresolved", None)), ("added", 7, "study", None, None, None, None, [], "", ("derived", "44")), ("unusable", 7, "arm", "red", None, None, None, [], "", ("not_reported", None)),
    ("failed", 8, "arm", "red", None, None, None, [], "", ("batch_failed", None)), ("silent", 9, "arm", "red", None, None, None, [], "", ("not_reported", None)), ("nothing", 9, "study", None, None, None, None, [], "", ("not_reported", None)), ("another set", 6, "study", None, None, None, "randomised", ["analysis_set"], "", ("scope_unresolved", None)),
]
SUMS = [("printed", 1018, True, True), ("printed and added", 991, True, True), ("two totals", 5, True, True), ("others' total", 5, False, True), ("added", 44, True, False)]


def test_claims(spark):
    review = spark.createDataFrame(REVIEW, "study string, arm string, label string")
    entries = spark.createDataFrame([(*e[:10], f"quote {e[1]}", e[10]) for e in ENTRIES], "batch int, pos int, shape string, arm_label string, left_label string, right_label string, basis string, analysis_set string, timepoint string, value string, quote string, usable boolean")
    requests = spark.createDataFrame([(c[0], c[1], "s", *c[2:7], None, c[7], c[8]) for c in CASES], "id string, batch int, study string, shape string, cohort_key string, left string, right string, basis string, analysis_set string, required array<string>, timepoint string")
    batches = spark.createDataFrame([(8, "timed out")], "batch int, error string")
    sums = spark.createDataFrame(SUMS, "id string, total long, exact boolean, timed boolean")
    rows = projection.project(requests, review, entries, batches, sums).collect()
    assert len(rows) == len(CASES)
    assert {r.id: (r.status, r.value) for r in rows} == {c[0]: c[-1] for c in CASES}
    assert all((r.reason is None) == (r.status in ("ok", "derived")) and (r.quote is None) == (r.status != "ok") for r in rows)
    none = projection.project(requests.limit(0), review, entries, batches, sums)
    assert none.collect() == []
