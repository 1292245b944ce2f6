"""The corpus pipeline against a plain composition of its stages."""

from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from test_models import exact
from test_tokens import WORDS, stored, verify_packing
from tokenizers import Tokenizer

import corpus_pipeline
from auditlake.llm import near_copies, queries, toxicity


def plain(spark, docs, sf):
    """doc_id and text of what comes to be packed."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in toxicity.apply(docs, model).where("score < 0.3").collect()]
    group = brute.near_groups(rows)
    rows = [(d, t) for d, t in rows if group[d] == d]
    cut = {d: (n, kept.decode()) for d, _, n, _, kept in brute.spans(rows)}
    rows = [(d, cut[d][1] if cut[d][0] else t) for d, t in rows]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in brute.leaks([(d, t) for d, t in rows if len(t or "") < 20_000], items)}
    return [(d, t) for d, t in rows if d not in leaked]


def test_run_against_plain_stages(spark, docs, sf):
    library = Tokenizer.from_file(WORDS)
    want = plain(spark, docs, sf)
    got = corpus_pipeline.run(spark, sf).collect()
    verify_packing(got, want, lambda t: library.encode(t or "", add_special_tokens=False).ids, 4096)


def test_stages_keep_the_columns(spark, docs, sf, tmp_path):
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns, name
    assert [t for _, t in now.dtypes] == [t for _, t in docs.dtypes]


def test_stages_keep_what_other_columns_hold(spark, docs, sf):
    """Columns of names that the stages might use themselves, upper case among them, come back as they were."""
    from pyspark.sql import functions as F

    names = ["Key", "score", "predicted", "toxic", "toxicity", "more", "tag", "kept_text", "pid", "item_id", "distance", "set", "data", "hash", "group", "at", "n", "id", "first_id", "component"]
    wide = docs.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns, name
        rows = got.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), name


def test_stages_on_odd_rows(spark, docs, sf):
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in brute.odd_texts()], docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, odd, sf)
        assert got.columns == docs.columns
        assert got.where("doc_id is null").count() == 2, name
    assert corpus_pipeline.STAGES[0][1](spark, odd, sf).count() == odd.count()
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == [], name


def test_near_copies_of_few_changed_words(spark, docs):
    rng = np.random.default_rng(11)
    line = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    rows, common = [], line(40)
    for k in range(40):
        words = line(rng.integers(60, 300)) + (common if k % 2 else [])
        for copy in range(3):
            rows.append((10 * k + copy, " ".join(words)))
            words = list(words)
            for at in rng.integers(0, len(words), 1 + k % 3):
                words[at] = f"new{k}_{copy}_{at}"
    group = brute.near_groups(rows)
    made = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, made, "").collect()}
    assert got == {d for d, g in group.items() if d == g}
    assert len(got) < 60


def test_near_copies_in_large_groups(spark, docs):
    """Copies of one text, each with words of its own; chains in which only neighbours are similar; unlike texts that share a passage."""
    rng = np.random.default_rng(5)
    line = lambda n: [f"w{i}" for i in rng.integers(0, 9000, n)]
    rows, first, passage = [], line(200), line(30)
    for copy in range(120):
        words = list(first)
        for at in rng.integers(0, 200, copy % 5):
            words[at] = f"copy{copy}_{at}"
        rows.append((1000 + copy, " ".join(words)))
    for chain in range(3):
        words = line(150)
        for step in range(45):
            words = words[3:] + line(3)
            rows.append((2000 + 100 * chain + step, " ".join(words)))
    rows += [(3000 + k, " ".join(line(20) + passage + line(20))) for k in range(60)]
    group = brute.near_groups(rows)
    found = near_copies.near_copies(spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.first_id for r in found} == group
    assert len(set(group.values())) < 80


def test_near_copies_are_found_by_fingerprints_first(spark, docs, monkeypatch):
    """What fingerprints link and the sets confirm is grouped before any prefix is compared; what only prefixes find is there as well."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        words = [f"w{i}" for i in rng.integers(0, 9000, 60 if k % 2 else 900)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:-1] + ["other"])), (10 * k + 2, " ".join(words[:30] + ["other"] + words[31:]))]
    sets = {d: near_copies.shingle_set(t, 5) for d, t in rows}
    ids = {d: near_copies.set_id(h) for d, h in sets.items()}
    bit = lambda d: np.array([sum(int(h) >> i & 1 for h in sets[d]) * 2 > len(sets[d]) for i in range(64)])
    prints = {d: bit(d) for d in sets}
    assert all(near_copies.set_print(sets[d]) % (1 << 64) == sum(int(b) << i for i, b in enumerate(prints[d])) for d in sets)
    near = {frozenset((ids[a], ids[b])) for a in sets for b in sets if a < b and (prints[a] != prints[b]).sum() <= 3}
    grouped, join = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda links: (grouped.append({frozenset((r.a, r.b)) for r in links.collect()}), join(links))[1])
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert grouped[0] and grouped[0] <= near and grouped[0] < grouped[-1]
    parent = {i: i for i in ids.values()}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in map(sorted, grouped[0]):
        parent[root(a)] = root(b)
    assert all(root(a) == root(b) for a, b in map(sorted, near))
    assert {r.doc_id: r.first_id for r in found} == brute.near_groups(rows)


def test_pairs_of_fingerprints_span_their_links(spark):
    """Equal ones, a chain by three bits each, a lone one, and two that differ in a high bit."""
    prints = [(1, 5), (2, 5), (3, 5 ^ 0b111), (4, 5 ^ 0b111111), (5, ~5), (6, -1 << 40), (7, (-1 << 40) ^ 1 << 50)]
    group = {i: {i} for i, _ in prints}
    for r in near_copies.by_prints(spark.createDataFrame(prints, "set long, fp long"), 4).collect():
        for x in group[r.a] | group[r.b]:
            group[x] = group[r.a] | group[r.b] | group[x]
    assert [min(group[i]) for i, _ in prints] == [1, 1, 1, 1, 5, 6, 6]


def test_pairs_between_groups():
    rng = np.random.default_rng(7)
    e = np.zeros(1500, near_copies.ENTRY)
    e["h"], e["set"], e["size"] = rng.choice([1, 2, 3, 3, 3], 1500) * 10 + (rng.integers(0, 40, 1500) == 0), np.arange(1500), rng.integers(50, 90, 1500)
    e["at"] = rng.integers(0, e["size"] // 5)
    group = rng.choice([0, 0, 0, 1, 2, 3], 1500)
    order = np.lexsort((group, e["h"]))
    e, group = e[order], group[order]
    got = [tuple(sorted(p)) for i, j in near_copies.pairs_between(e, group) for p in zip(i.tolist(), j.tolist())]
    i, j = np.triu_indices(1500, 1)
    good = (e["h"][i] == e["h"][j]) & (group[i] != group[j]) & near_copies.may_be_similar(e, i, j)
    assert sorted(got) == sorted(zip(i[good].tolist(), j[good].tolist()))


def test_near_copies_under_one_doc_id(spark, docs):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (None, a)]
    made = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], docs.schema)
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_copies(spark, made, "").collect())
    assert got == [(0, a), (1, a), (2, b)]


def test_queries_are_named_and_whole(spark, sf):
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_against_sql(spark, sf, name):
    db = duckdb.connect()
    for held in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {held} AS SELECT * FROM read_parquet('{sf}/{held}.parquet')")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = Counter(map(tuple, queries.QUERIES[name](spark, sf).select(*columns).collect()))
    assert got == Counter(want.fetchall())


def test_registered_queries_against_plain_ones(spark, sf, docs, rows):
    """Each query as it is registered, over the whole of its small table."""
    library = Tokenizer.from_file(WORDS)
    ids_of = lambda t: library.encode(t or "", add_special_tokens=False).ids
    run = lambda name: queries.QUERIES[name](spark, sf)
    told = lambda name, *columns: Counter(map(tuple, run(name).select(*columns).collect()))
    assert told("op1_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.substrings(rows))
    assert told("op4_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(x[:4] for x in brute.spans(rows))
    assert told("op9_simhash", "doc_id", "fingerprint", "component_id") == Counter(brute.components(rows))
    assert told("op3_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter((d, len((t or "").encode()), n, n > 2048) for d, t in rows for n in [len(ids_of(t))])
    assert told("op6_token_store", "doc_id", "start", "n_tokens", "ids_crc32") == Counter(stored(rows, ids_of))
    verify_packing(run("op7_packing").collect(), rows, ids_of, 4096)
    scored, spoken = run("op2_toxicity").collect(), run("op5_language_id").collect()
    assert sorted(r.doc_id for r in scored) == sorted(r.doc_id for r in spoken) == sorted(d for d, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (brute.remainder(r.doc_id, 4) == 2) for r in scored)
    langs = {r.lang for r in docs.where("lang is not null").select("lang").distinct().collect()}
    assert all(0 <= r.score <= 1 and r.lang_pred in langs | {"und"} and r.held_out == (brute.remainder(r.doc_id, 5) == 0) for r in spoken)
    short = [(d, t) for d, t in rows if len(t or "") < 4000]
    some = {d for d, _ in short}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id, r.distance) for r in run("op10_decontamination").collect() if r.doc_id in some} == brute.leaks(short, items)
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    vectors = [(i, v) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    want = exact(vectors, [i for i, _ in vectors if i % 20 == 0], 20)
    by = {}
    for r in run("op8_nearest").collect():
        by.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(by) == set(want)
    assert np.mean([sum(s >= want[q][-1][1] - 1e-9 for s in by[q].values()) / len(want[q]) for q in want]) >= 0.9
