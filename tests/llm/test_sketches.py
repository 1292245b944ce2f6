"""Scaled sketches against shingles as Python sees them, and their estimates against exact ones."""

import hashlib
from collections import Counter

import brute
import numpy as np
import pytest

from auditlake.llm import sketches
from auditlake.llm.sketches import SHINGLE, Scale

MASK = (1 << 64) - 1


def plain_hash(piece):
    """A shingle's hash, in Python's integers."""
    words = [int.from_bytes(piece[i : i + 8], "little") for i in range(0, SHINGLE, 8)]
    h = sum(w * int(f) for w, f in zip(words, sketches.FACTORS)) & MASK
    for shift, factor in zip((30, 27), sketches.MIXING):
        h = (h ^ (h >> shift)) * int(factor) & MASK
    return h ^ (h >> 31)


def plain_sketch(text, scale):
    data = text.encode()
    if len(data) < SHINGLE:
        return sketches.hashes(data).tolist()
    every = sorted({plain_hash(data[i : i + SHINGLE]) for i in range(len(data) - SHINGLE + 1)})
    under = [h for h in every if h <= scale.top]
    return under if len(under) >= scale.least else every[: scale.least]


def plain_likeness(a, b, scale):
    if a == b:
        return 1.0, 1.0
    reach = min(MASK if len(x) < scale.least else max(scale.top, x[-1]) for x in (a, b))
    a, b = ({h for h in x if h <= reach} for x in (a, b))
    return len(a & b) / len(a | b), len(a & b) / len(a) if a else None


def plain(rows, scale):
    """Rows of fingerprints(), each doc_id's texts in the order of their tags."""
    held = sorted((d, tag, t or "") for d, t, tag in rows)
    for (d, _, t), (_, _, following) in zip(held, held[1:] + held[:1]):
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, edited, other = (plain_sketch(x, scale) for x in (t, new, following))
        shown = ["".join(f"{h:016x}" for h in x) for x in (own, edited)]
        near, near_next = plain_likeness(own, edited, scale), plain_likeness(own, other, scale)
        yield d, len(t), hashlib.sha256(new.encode()).hexdigest(), *shown, near[0], near_next[0], near[1], near_next[1]


def by_hash(spark, df):
    """doc_id, text and the hash that orders the texts of a doc_id."""
    from pyspark.sql import functions as F

    found = df.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return [tuple(r) for r in found.select("*", F.xxhash64("text")).collect()]


@pytest.mark.parametrize("scale", [Scale(), Scale(8, 4), Scale(2, 1)])
def test_odd_rows(spark, odd, scale):
    got = Counter(map(tuple, sketches.fingerprints(odd, scale).collect()))
    assert got == Counter(plain(by_hash(spark, odd), scale))


@pytest.mark.parametrize("cores", [1, 3, 40])
def test_query_on_its_table(spark, sf, rows, cores):
    from auditlake.llm.queries import op12_sketches

    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", cores)
    try:
        got = Counter(map(tuple, op12_sketches(spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == Counter(plain([(d, t, 0) for d, t in rows], Scale()))


@pytest.mark.parametrize("texts", [[], [(1, "one text alone " * 9)], [(1, None)], [(2, None), (1, "")], [(5, "same") for _ in range(30)], [(7, "x" * 70), (7, "y" * 70), (7, "x" * 70), (None, "z")]])
def test_few_rows(spark, texts):
    made = brute.clashing(spark, texts)
    assert Counter(map(tuple, sketches.fingerprints(made).collect())) == Counter(plain(by_hash(spark, made), Scale()))


def test_estimates_are_near():
    """Of unequal texts, one of which holds a known part of the other."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(n))
    off = []
    for part in (0.0, 0.3, 0.5, 0.9):
        own = word(3000)
        a = own + word(3000 * part and int(3000 * (1 - part) / part) or 3000)
        b = (own if part else "") + word(60_000)
        exact_a, exact_b = ({x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)} for x in (a, b))
        near, within = Scale().compared(*(Scale().sketch(x.encode()) for x in (a, b)))
        off += [near - len(exact_a & exact_b) / len(exact_a | exact_b), within - len(exact_a & exact_b) / len(exact_a)]
    assert max(map(abs, off)) < 0.06


def test_short_texts_are_exact():
    a, b = b"no more than a handful of shingles here", b"no more than a handful of shingles here, and this"
    exact_a, exact_b = ({x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)} for x in (a, b))
    assert Scale().compared(Scale().sketch(a), Scale().sketch(b)) == (len(exact_a & exact_b) / len(exact_a | exact_b), 1.0)


def test_merged_sketches_are_those_of_unions(spark, docs):
    """A group's merged sketch holds what its texts' shingles keep together, and how much of a text it holds."""
    scale = Scale(64, 32)
    few = spark.createDataFrame([(-1, "a short one that is alone here 123456", None, "alone", None), (-2, None, None, None, None), (-3, "for nobody, of no source at all, ever", None, None, None)], docs.schema)
    all_docs = docs.unionByName(few)
    kept = sketches.sketches(all_docs, scale, "source")
    whole = sketches.merged(kept, "source", scale)
    got, every = {}, {}
    for r in whole.collect():
        got.setdefault(r.source, set()).add(r.hash % (1 << 64))
    for r in all_docs.collect():
        every.setdefault(r.source, set()).update(sketches.hashes((r.text or "").encode()).tolist())
    for source, h in every.items():
        under = {x for x in h if x <= scale.top}
        assert got[source] == (under if len(under) >= scale.least else set(sorted(h)[: scale.least])), source
    parts = sketches.held_by(kept, whole, "source", scale).collect()
    assert len(parts) == all_docs.count() and all(r.part in (1.0, None) and (r.part is None) == (r.n_under == 0) for r in parts)
    other = sketches.held_by(kept.where("doc_id >= 0").drop("source").selectExpr("*", "'alone' as source"), whole, "source", scale).collect()
    assert all(not r.part for r in other)
