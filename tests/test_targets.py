"""Arms and comparisons resolved, against a search through all permutations."""

from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import targets


def every_way(w, partial):
    """Totals of all ways to give rows different columns, the heaviest first."""
    n, m = len(w), len(w[0])
    out = []
    for way in product(range(-1 if partial else 0, m), repeat=n):
        used = [c for c in way if c >= 0]
        if len(used) == len(set(used)) and all(w[i][c] is not None for i, c in enumerate(way) if c >= 0):
            out.append((sum(w[i][c] for i, c in enumerate(way) if c >= 0), list(way)))
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("partial", [True, False])
def test_best_two_ways(spark, partial):
    rng = np.random.default_rng(4)
    cases = []
    for n, m in [(1, 1), (2, 2), (3, 2), (2, 4), (4, 4), (3, 5), (5, 3)]:
        for _ in range(3):
            cases.append([[None if rng.random() < 0.2 else float(rng.integers(0, 40)) for _ in range(m)] for _ in range(n)])
    rows = spark.createDataFrame([(i, w, len(w[0])) for i, w in enumerate(cases)], "i int, w array<array<double>>, m int")
    got = {r.i: r.found for r in rows.select("i", targets.best_two(F.col("w"), F.col("m"), partial).alias("found")).collect()}
    for i, w in enumerate(cases):
        want = every_way(w, partial)
        assert [x.total for x in got[i]] == [t for t, _ in want[:2]], w
        assert all([x.total, x.cols] in [list(y) for y in want] for x in got[i])


def nearest_reading(text, claims):
    """The verdict by permutations, on labels of plain words."""
    spans, taken = {}, text
    for label in sorted((c[0] for c in claims), key=lambda x: -len(x.split())):
        import re

        spans[label] = [(m.start(), m.end()) for m in re.finditer(rf"(?<![a-z0-9-]){re.escape(label)}(?![a-z0-9-])", taken)]
        for a, b in spans[label]:
            taken = taken[:a] + "\x00" * (b - a) + taken[b:]
    places = {v: [m.start() for m in re.finditer(rf"(?<![0-9.]){re.escape(v)}(?![0-9])", text)] for _, v in claims}
    claims = [(la, v) for la, v in claims if spans[la] and places[v]]
    if len(claims) < 2:
        return "ok"
    gap = lambda la, v: min(0 if a <= p <= b else min(abs(p - a), abs(p - b)) for a, b in spans[la] for p in places[v])
    costs = [sum(gap(la, v) for (la, _), v in zip(claims, order)) for order in permutations([v for _, v in claims])]
    best, second = sorted(costs)[:2]
    return "other" if costs[0] > best else "close" if second - best < 4 else "ok"


LOCAL = [
    ("mortality was 12 in the red arm, 15 in the blue arm", [("red", "12"), ("blue", "15")]),
    ("mortality was 12 in the red arm, 15 in the blue arm", [("red", "15"), ("blue", "12")]),
    ("red plus blue 31, blue 22, red 14", [("red plus blue", "31"), ("blue", "22"), ("red", "14")]),
    ("red plus blue 31, blue 22, red 14", [("red plus blue", "22"), ("blue", "31"), ("red", "14")]),
    ("blue-red 9 and red 8", [("red", "8"), ("blue", "9")]),
    ("12 red 15 blue", [("red", "12"), ("blue", "15")]),
    ("red 1.5 green 2.5 blue 3.5 black 4.5 white 5.5", [("red", "1.5"), ("green", "2.5"), ("blue", "3.5"), ("black", "4.5"), ("white", "5.5")]),
    ("nothing is said of either", [("red", "12"), ("blue", "15")]),
    ("red 12", [("red", "12"), ("blue", "15")]),
    ("red blue 1 2", [("red", "1"), ("blue", "2")]),
    ("112 red 12.5 blue 15", [("red", "12"), ("blue", "15")]),
]


def test_values_by_their_labels(spark):
    rows = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(LOCAL)], "i int, t string, c array<struct<label:string,value:string>>")
    got = {r.i: r.locality for r in targets.by_their_labels(rows, "t", "c").collect()}
    assert got == {i: nearest_reading(t, c) for i, (t, c) in enumerate(LOCAL)}
    assert set(got.values()) == {"ok", "other", "close"}


REVIEW = [(1, "a", "Red plus placebo"), (1, "b", "Red plus Blue"), (1, "c", "Blue"), (2, "a", "Green"), (2, "b", " "), (3, "a", "x one"), (3, "b", "x two")]
ARMS = [
    (1, 0, "Red-placebo group", "12", "n", "12 with red placebo"), (1, 1, "Red + Blue group", "15", "n", ""), (1, 2, "Blue group", None, "n", ""), (2, 0, "yellow", "3", "", ""), (3, 0, "x", "4", "", ""), (3, 1, "x", "5", "", ""),
]


def test_arms_are_resolved(spark):
    review = spark.createDataFrame(REVIEW, "study int, arm string, label string")
    arms = spark.createDataFrame(ARMS, "study int, pos int, label string, value string, unit string, quote string")
    asked = [("ok", 1, "a", ""), ("swapped", 1, "a", "the red + blue group had 12, and red placebo 15"), ("no value", 1, "c", ""), ("no label", 2, "b", ""), ("unlike", 2, "a", ""), ("tied", 3, "a", ""), ("no arms", 4, "a", "")]
    requests = spark.createDataFrame(asked, "id string, study int, target string, quote string")
    got = {r.id: (r.status, r.paper_label, r.value, r.rivals) for r in targets.resolve_arms(requests, review, arms).collect()}
    assert got == {
        "ok": ("ok", "Red-placebo group", "12", ["15"]), "swapped": ("inconsistent", "Red-placebo group", None, None), "no value": ("not_reported", "Blue group", None, None), "no label": ("unsupported", None, None, None),
        "unlike": ("ambiguous", None, None, None), "tied": ("ambiguous", None, None, None), "no arms": ("not_reported", None, None, None),
    }


def test_comparisons_are_resolved(spark):
    review = spark.createDataFrame([(1, "red_placebo", "Red plus placebo"), (1, "red_blue", "Red plus Blue"), (1, "blue", "Blue"), (3, "a", "x one"), (3, "b", "x two"), (5, "x", "Drug X"), (5, "y", "Drug Y"), (6, "x", "Only")], "study int, arm string, label string")
    held = [(1, 0, "Red placebo", "Blue", "0.7"), (1, 1, "Blue", "Red and Blue", "1.4"), (5, 0, "drug y", "drug x", "2"), (1, 2, "Red Blue", "Red placebo", None)]
    comparisons = spark.createDataFrame(held, "study int, pos int, left_label string, right_label string, value string")
    asked = [("ok", 1, "red_placebo", "blue"), ("joint", 1, "red placebo", "blue"), ("turned", 5, "X", "Y"), ("no value", 1, "red_blue", "red_placebo"), ("one arm", 6, "x", "y"), ("unknown", 1, "pink", "grey"), ("none", 3, "a", "b")]
    requests = spark.createDataFrame(asked, "id string, study int, left string, right string")
    got = {r.id: (r.status, r.paper_label, r.value, r.rivals) for r in targets.resolve_comparisons(requests, review, comparisons).collect()}
    assert got == {
        "ok": ("ok", "Red placebo vs Blue", "0.7", ["1.4"]), "joint": ("ok", "Red placebo vs Blue", "0.7", ["1.4"]), "turned": ("direction_inverted", None, None, None), "no value": ("not_reported", None, None, None),
        "one arm": ("not_reported", None, None, None), "unknown": ("unsupported", None, None, None), "none": ("not_reported", None, None, None),
    }
    sides = {r.id: (r.left_label, r.right_label, r.why) for r in targets.resolve_sides(requests, review).collect()}
    assert sides["joint"] == ("Red plus placebo", "Blue", None) and sides["one arm"][2] == "too few arms" and sides["unknown"][2] == "no likeness"
