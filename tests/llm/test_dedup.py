"""Substring and near-duplicate operators against plain restatements."""

from collections import Counter

import brute
import numpy as np
import pytest
import zstandard

from auditlake.llm import rlz_dedup, segments, simhash, suffix_dedup


def found(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


SUBSTRING = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
SPAN = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substrings_of_the_table(docs, rows):
    assert found(suffix_dedup.dedup_substrings(docs), *SUBSTRING) == Counter(brute.substrings(rows))


def test_substrings_of_odd_texts(odd):
    assert found(suffix_dedup.dedup_substrings(odd), *SUBSTRING) == Counter(brute.substrings(brute.tagged(odd)))


def test_crowded_anchors(spark):
    """More different segments of an anchor than are held at once are resolved by the second exchange."""
    rng = np.random.default_rng(8)
    phrase = " ".join(f"common{i}" for i in range(24))
    own = lambda: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 12))
    rows = [(i, f"{own()} {phrase} {own()}") for i in range(segments.TOGETHER + 400)]
    crowded = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    assert found(suffix_dedup.dedup_substrings(crowded), *SUBSTRING) == Counter(brute.substrings(rows))
    assert found(rlz_dedup.dedup_spans(crowded), *SPAN) == Counter(x[:4] for x in brute.spans(rows))


def test_no_task_holds_a_crowded_anchor():
    """Segments of a crowded anchor are handed on where they arise or as they are read."""
    crowd = 1500
    single = segments.Windows(segments.Marks(4), suffix_dedup.slices(100), 100, 4)
    given = most = 0
    for i in range(3 * segments.TOGETHER):
        single.add(b"%0150d" % i, 0, 51, i, 0, 0)
        given += sum(1 for _ in single.out())
        most = max(most, len(single.held))
    single.close()
    assert most <= segments.TOGETHER and given + sum(1 for _ in single.out()) == 3 * segments.TOGETHER

    rng = np.random.default_rng(8)
    phrase = " ".join(f"common{i}" for i in range(24))
    own = lambda: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 12))
    texts = [f"{own()} {phrase} {own()}".encode() for _ in range(crowd)]
    packer, opener = suffix_dedup.zstandard.ZstdCompressor(), suffix_dedup.zstandard.ZstdDecompressor()
    run = suffix_dedup.Run(4, 100)
    run.add(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.arange(crowd), np.zeros(crowd, int))
    sent = Counter(x[1][:16] for _, _, kind, data in run.out(packer) if kind == segments.RUN for x in suffix_dedup.decode(opener.decompress(data)))
    assert max(sent.values()) < 512
    run = rlz_dedup.Run(4, 20)
    run.add([t.split() for t in texts], list(range(crowd)), [0] * crowd)
    sent = Counter()
    for _, _, kind, data in run.out(packer):
        if kind == segments.RUN:
            data = opener.decompress(data)
            sent.update(np.frombuffer(data, "<u8", int(np.frombuffer(data, "<i8", 1)[0]), 8).tolist())
    assert max(sent.values()) < 512


def test_substrings_keep_what_is_left(odd):
    got = {(r.doc_id, r.kept_text) for r in suffix_dedup.dedup_substrings(odd, keep_text=True).collect() if r.doc_id in (2, 4, 18)}
    assert got == {(2, ""), (4, "short text"), (18, "short text")}


def test_spans_of_the_table(docs, rows):
    assert found(rlz_dedup.dedup_spans(docs), *SPAN) == Counter(x[:4] for x in brute.spans(rows))


def test_spans_of_odd_texts(odd):
    want = Counter(x[:4] for x in brute.spans(brute.tagged(odd)))
    assert found(rlz_dedup.dedup_spans(odd), *SPAN) == want
    assert found(rlz_dedup.dedup_spans(odd, more=["lang", "tag"]), *SPAN) == want


def test_factors_over_reference_blocks():
    """Factors run on as far as a block does, and windows over a boundary between factors are found."""
    blocks = rlz_dedup.Blocks(3)
    assert blocks.parse(b"a b c d e f") == []
    assert blocks.parse(b"x a b c d y") == [(1, 5)]
    assert blocks.parse(b"b c d y z") == [(0, 3), (1, 4)]


def test_merge_knows_shared_prefixes():
    runs = [sorted([b"anchor-aa", b"anchor-ab", b"b"]), sorted([b"anchor-aa", b"anchor-b"]), []]

    def coded(run):
        before = b""
        for i, key in enumerate(run):
            same = 0
            while same < min(len(before), len(key)) and before[same] == key[same]:
                same += 1
            yield same, key, i, 0, 0
            before = key

    merged = list(suffix_dedup.merge([coded(r) for r in runs]))
    keys = [k for _, k, *_ in merged]
    assert keys == sorted(k for r in runs for k in r)
    assert [s for s, *_ in merged] == [0, 9, 8, 7, 0]


@pytest.mark.parametrize("width", [1, 5, 33])
def test_anchor_is_the_last_least(width, monkeypatch):
    monkeypatch.setattr(segments, "SPAN", 1 << 7)
    h = np.random.default_rng(1).integers(0, 6, 500).astype(np.uint64) << np.uint64(40)
    want = [max(range(i, i + width), key=lambda j: (-int(h[j]), j)) for i in range(len(h) - width + 1)]
    assert segments.anchors(h, width).tolist() == want


def test_components_of_the_table(docs, rows):
    assert found(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == Counter(brute.components(rows))


def test_components_of_odd_texts(odd):
    assert found(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == Counter(brute.components(brute.odd_texts()))


def test_components_of_chains(spark):
    """Long paths and stars come to their smallest node."""
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(500, 400), (400, 450)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, 400: 400, 450: 400, 500: 400}


def test_no_link_is_lost_between_close_fingerprints(spark):
    """The forests span the classes that all close pairs make, and join nothing else."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = {b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base for k in (0, 1, 2, 3, 3, 4, 5)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    rows = [(i, f) for i, f in enumerate(signed)]
    links = {tuple(r) for r in simhash.links(spark.createDataFrame(rows, "id long, fp long"), 3, 4).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 3}
    def classes(pairs):
        up = {i: i for i, _ in rows}

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in pairs:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return [root(i) for i, _ in rows]

    assert classes(links) == classes(want)


@pytest.mark.parametrize("run", [suffix_dedup.dedup_substrings, rlz_dedup.dedup_spans, simhash.near_duplicates])
def test_empty_tables(docs, run):
    assert run(docs.limit(0)).collect() == []


def test_a_run_of_segments_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    words = np.array([b"w%d" % i for i in range(50_000)], object)
    run, packer = rlz_dedup.Run(64, 20), zstandard.ZstdCompressor(level=3)
    per = max(1, rlz_dedup.PASS_BYTES // 6)
    rlz_dedup.powers(1 << 20)
    tracemalloc.start()
    for i in range(12 << 20 >> 9):
        run.add([words[rng.integers(0, len(words), per)].tolist()], [i], [0])
        run.size += rlz_dedup.PASS_BYTES
        if run.size >= rlz_dedup.RUN_BYTES:
            break
    assert sum(len(x[3]) for x in run.out(packer)) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_a_run_holds_places_of_its_segments():
    """Held as places in their texts, the segments of a run take a few times its bytes until they are given out, and marks take 32 bytes each."""
    import tracemalloc

    rng = np.random.default_rng(5)
    words = np.array([b"w%d" % i for i in range(50_000)], object)
    run, packer = rlz_dedup.Run(64, 20), zstandard.ZstdCompressor(level=3)
    passes = rlz_dedup.RUN_BYTES // rlz_dedup.PASS_BYTES
    rlz_dedup.powers(1 << 20)
    tracemalloc.start()
    for i in range(passes):
        run.add([words[rng.integers(0, len(words), rlz_dedup.PASS_BYTES // 7)].tolist()], [i], [0])
    held = tracemalloc.get_traced_memory()[0]
    assert sum(len(x[3]) for x in run.out(packer)) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 3 * rlz_dedup.RUN_BYTES and peak < 6 * rlz_dedup.RUN_BYTES, (held, peak)

    marks = segments.Marks(4, most=1 << 20)
    tracemalloc.start()
    for i in range(100_000):
        marks.add(i << 40, i << 41, i << 10, (i << 10) + 20)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100_000 * 40
    got = np.concatenate([np.frombuffer(x[3], segments.MARK) for x in marks.out(last=True)])
    assert len(got) == 100_000 and not marks.rows


def test_words_are_hashed_alike_in_stretches(monkeypatch):
    data = np.frombuffer(b" ".join(b"x" * (i % 37 + 1) + b"%d" % (i % 11) for i in range(500)), np.uint8)
    whole = rlz_dedup.word_hashes(data)
    monkeypatch.setattr(rlz_dedup, "STRETCH", 20)
    parts = rlz_dedup.word_hashes(data)
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == 500


def test_long_texts_that_travel_small(spark):
    """What is left of texts that shrink much on their way is given out in portions, each with its own further columns."""
    rng = np.random.default_rng(3)
    text = lambda i: " ".join([f"own{i}"] + ["again"] * int(rng.integers(100, 400)) + [f"end{i}"])
    rows = [(i, text(i)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, f"c{i}") for i, t in rows], "doc_id long, text string, note string").repartition(3)
    was, segments.GIVEN_BYTES = segments.GIVEN_BYTES, 1000
    try:
        got = rlz_dedup.dedup_spans(docs, more=["note"]).select(*SPAN, "more.note").collect()
    finally:
        segments.GIVEN_BYTES = was
    assert all(r.note == f"c{r.doc_id}" for r in got)
    assert Counter(tuple(r)[:4] for r in got) == Counter(x[:4] for x in brute.spans(rows))
