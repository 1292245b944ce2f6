"""Joins by levels of keys, origins of cells and cohorts mapped one by one."""

from pyspark.sql import functions as F

from auditlake.operators import precedence


def test_the_first_level_answers(spark):
    asked = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "b", "x"), (4, "", "y"), (5, "c", None), (6, "a", "y")], "id int, claim string, place string")
    known = spark.createDataFrame([("a", "p", 10), ("b", "x", 20), ("b", "x", 21), (None, "x", 20), (None, "y", 30), (None, "y", 30)], "claim string, place string, v int")
    keys = [(F.col("claim"), F.col("claim")), (F.col("place"), F.col("place"))]
    got = {r.id: (r.level, r.v, r.status) for r in precedence.by_precedence(asked, known, "id", "v", keys).collect()}
    assert got == {1: (0, 10, "found"), 2: (1, None, "ambiguous"), 3: (0, None, "ambiguous"), 4: (1, 30, "found"), 5: (None, None, "unmatched"), 6: (0, 10, "found")}
    none = precedence.by_precedence(asked, known.limit(0), "id", "v", keys)
    assert {r.status for r in none.collect()} == {"unmatched"}


def test_origins_of_cells(spark):
    labels = spark.createDataFrame([("t", "Outcome / Events", None, "read", 0), ("t", "events", 3, "computed", 1), ("t", "Total", None, "read", 2), ("t", "total", None, "derived", 3), ("t", "", None, "reported", 4), ("u", None, None, "given", 0)], "table_id string, column_path string, row int, value_source string, pos int")
    cells = spark.createDataFrame([(1, "t", "Outcome / Events", 3), (2, "t", "outcome /  EVENTS", 1), (3, "t", "Arm / Total", 1), (4, "t", "Mean", 1), (5, "u", "Mean", None), (6, "v", "Mean", 1)], "cell int, table_id string, path string, row int")
    got = {r.cell: (r.value_source, r.level, r.conflict) for r in precedence.origins(cells, labels).collect()}
    assert got == {1: ("computed", "row", False), 2: ("read", "column", False), 3: ("read", "column", True), 4: ("reported", "table", False), 5: ("given", "table", False), 6: (None, None, False)}


def greedy(review, source):
    """As it is said, in plain Python, over words."""
    words = lambda x: {w[:-1] if w.endswith("s") and len(w) > 3 else w for w in x.lower().split()}
    score = lambda a, b: 2 * len(words(a) & words(b)) / (len(words(a)) + len(words(b))) if words(a) and words(b) else 0
    found = sorted(((max((score(v, la) for v in vs), default=0), k, la) for k, vs in review.items() for la in source), reverse=True)
    found = [f for f in found if f[0]]
    out, used = {}, set()
    for s, k, la in found:
        if k not in out and la not in used and sum(f[:2] == (s, k) for f in found) == 1:
            out[k] = la
            used.add(la)
    keys, labels = [k for k in review if k not in out], [la for la in source if la not in used]
    if len(review) == len(source) and len(keys) == len(labels) == 1:
        out[keys[0]] = labels[0]
    return out


def test_cohorts_one_by_one(spark):
    cases = [
        ({"a": ["red drug"], "b": ["blue drugs", "blue"]}, ["Red drug", "drug Blue"]), ({"a": ["red"], "b": ["green"]}, ["red one", "other"]), ({"a": ["red"], "b": ["red"]}, ["red"]), ({"a": ["red blue"]}, ["red", "blue"]),
        ({"a": ["red"], "b": ["blue"], "c": []}, ["red x", "blue y", "zzz"]), ({"a": ["x"]}, ["y"]), ({"a": ["x"], "b": ["y"]}, ["z", "w"]),
    ]
    review = spark.createDataFrame([(i, k, vs) for i, (r, _) in enumerate(cases) for k, vs in r.items()], "study int, key string, variants array<string>")
    source = spark.createDataFrame([(i, la) for i, (_, s) in enumerate(cases) for la in s], "study int, label string")
    got = {}
    for r in precedence.cohort_mapping(review, source).collect():
        got.setdefault(r.study, {})[r.key] = r.label
    assert got == {i: m for i, (r, s) in enumerate(cases) if (m := greedy(r, s))}


def test_groups_are_counted_in_the_grammar_of_counting(spark):
    from auditlake.operators import census

    says = {
        ("three groups", 3): True, ("randomised to 3 treatment arms.", 3): True, ("one of three groups", 3): True, ("Two (2) regimens", 2): True, ("3 mg treatment arms", 3): False, ("group 3", 3): False, ("3 treatment cycles", 3): False,
        ("three groups", 2): False, ("5-year treatment", 5): False, ("thirteen groups", 13): False, ("13 groups", 13): True, ("", 1): False, ("0 groups", 0): False,
    }
    rows = spark.createDataFrame([(q, n) for q, n in says], "q string, n int")
    assert {(r.q, r.n): r.found for r in rows.select("q", "n", census.states_groups(F.col("q"), F.col("n")).alias("found")).collect()} == says
    numbers = {"3": 3, " 12 ": 12, "3.0": 3, "3.5": None, "0": None, "-3": None, "three": None, "": None, "03": None, "true": None}
    rows = spark.createDataFrame([(t,) for t in numbers], "t string")
    assert {r.t: r.n for r in rows.select("t", census.positive_integer(F.col("t")).alias("n")).collect()} == numbers
    cases = [
        ("three groups: red, blue and green", 3, ["the red arm", "Blue", "green"], ["Green group", "blue", "red"], None), ("two groups, red and blue", 2, [], ["red", "blue"], None), ("two groups", 3, [], ["a1", "b1", "c1"], "the passage doesn't count the groups"),
        ("two groups", 2, [], ["red"], "other number of counts"), ("red", None, ["red", "blue"], ["red", "blue"], "the passage doesn't name a group"), ("red and blue", None, ["red", "blue"], ["red"], "other groups are counted"), ("", 2, None, ["red"], "no passage"), (None, None, None, None, None),
    ]
    cases[0] = ("three groups: the red arm, blue and green", *cases[0][1:])
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, quote string, declared int, labels array<string>, counted array<string>")
    assert {r.i: r.census for r in census.census(rows).collect()} == {i: c[4] for i, c in enumerate(cases)}
