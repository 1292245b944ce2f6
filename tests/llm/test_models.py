"""Learned operators by held-out accuracy, and searches against brute force."""

import brute
import numpy as np
import pytest

from auditlake.llm import ann_graph, decontam, langid, toxicity


@pytest.fixture(scope="module")
def larger(spark, sf):
    at = sf.replace("sf0.001", "sf0.1")
    return {n: spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels", "embeddings")}


def test_toxicity_of_rows_set_aside(larger):
    got = {r.doc_id: r for r in toxicity.score_documents(larger["documents"], larger["labels"]).collect()}
    assert len(got) == larger["documents"].count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (brute.remainder(d, 4) == 2) for d, r in got.items())
    aside = [(got[r.doc_id], r.toxic) for r in larger["labels"].collect() if got[r.doc_id].held_out and r.toxic is not None]
    hit = sum(r.predicted and y for r, y in aside)
    assert hit / sum(y for _, y in aside) >= 0.9
    assert hit / sum(r.predicted for r, _ in aside) >= 0.9


def test_toxicity_of_odd_rows(odd, spark, larger):
    labels = spark.createDataFrame([(4, None), (None, 1), (5, 0), (6, 1), (6, 1), (99, 7), (-3, 1), (9, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(odd, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in brute.odd_texts() if d is not None)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(odd.limit(0), labels).collect() == []
    model = toxicity.fit(odd, labels)
    assert toxicity.apply(odd, model).count() == odd.count()


def test_ties_and_long_texts(spark, larger):
    """Equal texts score alike, however long, and a score of the threshold is predicted."""
    docs, labels = larger["documents"], larger["labels"]
    model = toxicity.fit(docs, labels)
    some = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate([*some, *some, " ".join(some * 60), "", None])]
    got = {r.doc_id: r for r in toxicity.apply(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i].score == got[i + 40].score for i in range(40)) and got[81].score == got[82].score
    tie = got[3].score
    assert all(r.predicted == (r.score >= tie) for r in toxicity.apply(spark.createDataFrame(rows, "doc_id long, text string"), model, threshold=tie).collect())


def test_lexicon_holds_every_term_over_its_bars(spark):
    """No cap on terms: all that occur in enough toxic texts and tell them from others."""
    rows = [(i, " ".join(f"bad{i % 7}x{j}" for j in range(600)) + " plain" if i % 2 else "plain words here", i % 2) for i in range(140)]
    sample = spark.createDataFrame([*rows, (900, "rare rare rare", 1)], "doc_id long, text string, toxic int")
    words, stems = toxicity.learn_lexicon(sample)
    assert set(words) == {f"bad{k}x{j}" for k in range(7) for j in range(600)}
    assert "plain" not in words and "rare" not in words and set(stems) == {f"bad{k}x" for k in range(7)}


def test_trees_follow_their_nodes():
    """Scores are the base and the value of the leaf that each tree's questions lead to; a split is the best that an exhaustive search finds."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(400, 5)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2) ^ (rng.random(400) < 0.05)).astype(float)
    model = toxicity.Trees(trees=12, depth=3, least=10).fit(x, y)
    raw = model.raw(x)
    for row, got in zip(x, raw):
        total = model.base
        for tree in model.nodes:
            at = 0
            while tree[at][0] >= 0:
                feature, bound, left, right, _ = tree[at]
                at = left if np.searchsorted(model.edges[feature], row[feature], side="left") <= bound else right
            total += model.rate * tree[at][4]
        assert abs(total - got) < 1e-9
    assert np.mean((raw > 0) == (y > 0.5)) > 0.85
    b, p = model.binned(x), y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
    best = max((gain(b[:, j] <= k) + gain(b[:, j] > k), -j, -k) for j in range(5) for k in range(b[:, j].max()) if 10 <= (b[:, j] <= k).sum() <= len(y) - 10)
    feature, bound = model.nodes[0][0][:2]
    assert abs(gain(b[:, feature] <= bound) + gain(b[:, feature] > bound) - best[0]) < 1e-9


def test_isotonic_is_the_best_fit():
    """The pooled means are, at each score, the largest over lower ends of the smallest over upper ends of the means between."""
    rng = np.random.default_rng(1)
    score = np.round(rng.random(120), 2)
    y = (rng.random(120) < score).astype(float)
    xs, ys = toxicity.isotonic(score, y)
    values = np.unique(score)
    mean = lambda a, b: y[(score >= a) & (score <= b)].mean()
    want = np.array([max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v) for v in values])
    pools = {v: [s for s, w in zip(values, want) if w == v] for v in want}
    smoothed = [(want[i] * (n := sum(np.isin(score, pools[want[i]]))) + y.mean()) / (n + 1) for i in range(len(values))]
    assert np.allclose(np.interp(values, xs, ys), np.maximum.accumulate(smoothed))


@pytest.mark.parametrize("switch", [0.0, 1.5, 6.0])
def test_viterbi_against_all_labellings(switch):
    from itertools import product

    rng = np.random.default_rng(2)
    size = np.array([4, 0, 1, 6, 2])
    score = rng.normal(size=(size.sum(), 3))
    got, at = langid.viterbi(score, size, switch), 0
    value = lambda part, path: sum(part[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
    for n in size:
        part, path = score[at : at + n], got[at : at + n].tolist()
        assert n == 0 or abs(value(part, path) - max(value(part, p) for p in product(range(3), repeat=int(n)))) < 1e-9
        at += n


def test_letters_are_unicodes(spark):
    """Digits, marks and symbols of a script are no letters; letters of scripts that few fonts have are."""
    rows = [(i, f"wort{i} und satz", "aa") for i in range(1, 40)]
    none = ["٣٤٥", "१२३", "・・", "䷀", "\u0301\u0302", "12 --"]
    some = ["ⵜⵉⴼ", "ⲁⲃⲅ", "ꓐ", "wort", "𐌰𐌱"]
    rows += [(1000 + i, t, None) for i, t in enumerate(none + some)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[1000 + i] for i in range(len(none))] == ["und"] * len(none)
    assert "und" not in [got[1000 + len(none) + i] for i in range(len(some))]


def test_more_languages_than_a_byte_counts(spark):
    rows = [(5 * i + k, f"w{i:03d}x " * 9, f"l{i}") for i in range(300) for k in range(1, 5)]
    rows += [(10_000 + i, f"w{i:03d}x " * 4, None) for i in range(0, 300, 37)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    hit = [got[10_000 + i] == f"l{i}" for i in range(0, 300, 37)]
    assert np.mean(hit) >= 0.8


def test_script_outvotes_length(spark):
    """A long word is labelled by the languages of its script only."""
    rows = [(i, "longandlonger wordsofall kinds", "aa") for i in range(1, 60, 2)] + [(i, "а б в г слово ж", "bb") for i in range(2, 60, 2)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    word = "ж" + "longandlonger" * 40
    [span] = langid.spans(spark.createDataFrame([(1, word)], "doc_id long, text string"), model).collect()
    assert span.lang == "bb"


def test_isotonic_steps():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and x[0] == 1 and 0 < y[0] < y[-1] < 1


def test_language_of_rows_set_aside(larger):
    docs = larger["documents"]
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("lang is not null and text is not null").select("doc_id", "lang").collect()}
    aside = [got[d].lang_pred == lang for d, lang in truth.items() if got[d].held_out]
    assert np.mean(aside) >= 0.97
    assert all(r.held_out == (brute.remainder(d, 5) == 0) for d, r in got.items())


def test_language_of_odd_rows(odd, spark):
    learned = brute.clashing(spark, brute.odd_texts()).withColumn("lang", __import__("pyspark").sql.functions.expr("if(doc_id % 2 = 0, 'aa', 'bb')"))
    got = {r.doc_id: r for r in langid.identify(learned).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 3, 17))
    assert all(got[d].lang_pred in ("aa", "bb") for d in (4, 5, 13))
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}  # no labelled row
    assert langid.identify(odd.limit(0)).collect() == []


def test_spans_of_mixed_text(spark):
    rng = np.random.default_rng(0)
    words = {"aa": [f"{a}{b}ing" for a in "bcdf" for b in "aeiou"], "bb": [f"{a}{b}ung" for a in "rstz" for b in "äöüy"], "ру": [f"{a}{b}ла" for a in "бвгд" for b in "аеиу"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(list(words) * 20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = f"{text('aa', 12)} {text('bb', 9)} {text('ру', 5)} 12 {text('aa', 6)}"
    got = langid.spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).orderBy("start").collect()
    assert [r.lang for r in got] == ["aa", "bb", "ру", "aa"]
    assert [(r.start, r.end) for r in got][:2] == [(0, 12), (12, 21)] and got[-1].end == 33


def exact(vectors, asked, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in asked:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_neighbours_against_brute_force(larger):
    vectors = larger["embeddings"]
    got = ann_graph.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, shard=700).collect()
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    usable = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    want = exact(usable, [i for i, _ in usable if i % 20 == 0], 20)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    x = dict(usable)
    for q, found in by.items():
        assert [r.rank for r in found] == list(range(1, len(want[q]) + 1))
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(found, found[1:]))
        assert all(abs(r.score - float(np.dot(np.array(x[r.vec_id], float), np.array(x[q], float)))) < 1e-9 for r in found)
    recall = np.mean([len({r.vec_id for r in by[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.95


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 4)).astype(np.float32)
    rows = [(i, base[i % 30].tolist(), "x") for i in range(90)]
    rows += [(100, None, "x"), (120, [0.0] * 4, "x"), (140, [float("nan"), 1.0, 1.0, 1.0], "x"), (160, [None, 1.0, 1.0, 1.0], "x"), (180, [float("inf"), 1.0, 1.0, 1.0], "x"), (None, [1.0] * 4, "x"), (200, [], "x"), (0, rows[0][1], "x"), (220, [-0.0, 0.0, 0.0, 0.0], "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = ann_graph.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=7, shard=10).collect()
    want = exact([r[:2] for r in rows[:90]], [0, 20, 40, 60, 80], 7)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {q: [i for i, _ in w] for q, w in want.items()}
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rank string")
    assert ann_graph.nearest(few, few.where("vec_id = 0"), k=20).count() == 2
    assert ann_graph.nearest(few.limit(0), few, k=20).collect() == []


def test_outlying_norms_blur_no_other(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 16))
    base[[7, 11]] *= 1e4
    base[[13, 17]] *= 1e19
    rows = [(i, v) for i, v in enumerate(base.astype(np.float32).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = exact(rows, range(0, 1500, 20), 20)
    by = {}
    for r in ann_graph.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, shard=500).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(by[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


@pytest.mark.parametrize("kind", ["clusters", "jittered copies", "no structure"])
def test_recall_at_the_registered_setting(spark, kind):
    rng = np.random.default_rng(9)
    n, d = 4500, 64
    base = rng.normal(size=(n, d))
    if kind == "clusters":
        base = base[rng.integers(0, 60, n)] + 0.4 * base
    if kind == "jittered copies":
        base = base[rng.integers(0, 300, n)] + 0.01 * base
    rows = [(i, v) for i, v in enumerate(base.astype(np.float32).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = exact(rows, range(0, n, 20), 20)
    by = {}
    for r in ann_graph.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20).collect():
        by.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(by) == set(want) and all(len(f) == 20 for f in by.values())
    # an answer as near as the last of the true ones counts
    assert np.mean([sum(s >= want[q][-1][1] - 1e-9 for s in by[q].values()) / 20 for q in want]) >= 0.9


def items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_leaks_with_planted_errors(spark, sf, rows):
    bench = [(r.item_id, r.text) for r in items(spark, sf).collect()]
    rng = np.random.default_rng(4)
    planted = []
    for n, (i, text) in enumerate(bench[:24]):
        chars = list(text)
        for _ in range(round(len(chars) / 16 * (n % 4) / 2)):  # none to beyond the budget
            at = int(rng.integers(0, len(chars)))
            chars[at : at + 1] = [[], ["q"], [chars[at], "z"]][int(rng.integers(0, 3))]
        planted.append((10_000 + n, f"{rows[n][1] or ''} {''.join(chars)} {(rows[n + 1][1] or '')[:300]}"[-2500:]))
    some = planted + [(d, t) for d, t in rows[:12]] + [(50_000, None), (50_001, ""), (None, bench[0][1]), (10_000, planted[0][1]), (50_002, bench[5][1].upper().replace(" ", " - "))]
    tests = [(i, t) for i, t in bench] + [(900, None), (901, " .. "), (None, "x"), (902, "tiny"), (50, bench[0][1])]
    some += [(50_003, "a tiny one"), (50_004, "a tinys one")]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.contamination(brute.clashing(spark, some), spark.createDataFrame(tests, "item_id long, text string")).collect()}
    assert got == brute.leaks(some, tests)
    assert any(d for *_, d in got)


def test_short_items_occur_exactly(spark):
    tests = [(1, "Tigers and bees"), (2, "lions and bees"), (3, "tigers and beets")]
    some = [(1, "of tigers and beests"), (2, "of tigers, and bees."), (3, "tigers and bees"), (4, "lions and bee"), (5, "the lions and bees"), (6, "xlions and bees"), (7, "lions und bees")]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.contamination(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")).collect()}
    assert got == brute.leaks(some, tests)
    assert {(d, i) for d, i, _ in got if i < 3} == {(2, 1), (3, 1), (5, 2)}


def test_decontamination_keeps_clean_rows(spark, docs, sf, odd):
    hit = {r.doc_id for r in decontam.contamination(docs, items(spark, sf)).collect()}
    kept = {r.doc_id for r in decontam.decontaminate(docs, items(spark, sf)).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - hit and hit
    assert decontam.decontaminate(odd, items(spark, sf)).count() == odd.count()
    assert decontam.contamination(docs.limit(0), items(spark, sf)).collect() == []
    assert decontam.contamination(docs, items(spark, sf).limit(0)).collect() == []


@pytest.mark.parametrize("pattern,text,want", [("abc", "xxabcxx", 0), ("abc", "xxabxx", 1), ("abc", "", 3), ("a" * 100, "a" * 97, 3), ("kitten", "the sitting", 2)])
def test_bit_parallel_distance(pattern, text, want):
    assert decontam.myers(pattern, text, 9) == want == brute.edit_distance_inside(pattern, text)


def test_one_text_for_each_doc_id(spark):
    """A bound on doc_ids is one on the rows that a model learns from, however often one repeats."""
    from pyspark.sql import functions as F

    from auditlake.llm import common

    rows = spark.createDataFrame([(1, f"text {i % 50}", i % 2) for i in range(500)] + [(2, "b", 1), (3, None, 0)], "doc_id long, text string, toxic int")
    got = common.one_text_each(rows).collect()
    first = rows.where("doc_id = 1").orderBy(F.xxhash64("text"), "toxic").first()
    assert sorted((r.doc_id, r.text or "", r.toxic) for r in got) == sorted([(1, first.text, first.toxic), (2, "b", 1), (3, "", 0)])
    single = rows.where("doc_id > 1")
    assert common.one_text_each(single) is single
