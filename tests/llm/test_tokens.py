"""Token counts, the chunk store and packing against the tokenizer library."""

import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditlake.llm import common, packing, token_counts, token_store
from auditlake.llm.tokens import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of():
    library = Tokenizer.from_file(WORDS)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


TRICKY = ["", " ", "a", "don't DON'T 'S", "naïve Café é", "x y z", "<|endoftext|> a<|startoftext|>", "12 3.4 ½", "İstanbul ıı", "ﬁ ﬂ", "日本語 text", "a\x00b\x1fc\x7f", "🙂🙃", "--- ...!?", "ǅ ß ẞ", "﻿bom", "it's we'll i'd", "a_b__c", "x" * 3000, "Ωmega Åring", "\x85next", "a‍b"]


def test_ids_are_the_librarys(ids_of, rows):
    encode = Encoder(WORDS).ids
    for text in [*TRICKY, *(t or "" for _, t in rows)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text), text[:80]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    encode = Encoder(public_tokenizers.path(name)).ids
    if name.endswith(".json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        want = lambda t: library.encode(t, add_special_tokens=False).ids
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode
    for text in TRICKY:
        assert np.frombuffer(encode(text), "<u4").tolist() == want(text)


def counted(rows, ids_of):
    return Counter((d, len((t or "").encode()), n, n > 2048) for d, t in rows if d is not None for n in [len(ids_of(t))])


def test_counts(docs, rows, odd, ids_of):
    assert Counter(map(tuple, token_counts.count_tokens(docs, WORDS).collect())) == counted(rows, ids_of)
    assert Counter(map(tuple, token_counts.count_tokens(odd, WORDS).collect())) == counted(brute.odd_texts(), ids_of)


def test_cache_encodes_only_what_it_lacks(docs, tmp_path, spark):
    cache = str(tmp_path / "cache")
    half = docs.where("doc_id % 2 = 0")
    token_counts.count_tokens(half, WORDS, cache).count()
    held = spark.read.parquet(cache).count()
    assert held == half.selectExpr("coalesce(text, '')").distinct().count()
    whole = token_counts.count_tokens(docs, WORDS, cache)
    assert whole.count() == docs.count()
    assert spark.read.parquet(cache).count() == docs.selectExpr("coalesce(text, '')").distinct().count()
    token_counts.count_tokens(docs, WORDS, cache).count()
    assert spark.read.parquet(cache).groupBy("digest").count().where("count > 1").count() == 0
    # another tokenizer's counts are apart
    other = token_counts.count_tokens(half, public_tokenizers.path("byte_bpe_50k.json"), cache)
    assert other.count() == half.count() and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def stored(rows, ids_of):
    start = 0
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ids = np.array([*ids_of(t), 1], "<u4")
        yield d, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_store_gives_back_what_went_in(docs, rows, ids_of):
    assert Counter(map(tuple, token_store.stored_ids(docs, WORDS).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == Counter(stored(rows, ids_of))


def test_store_of_odd_texts(spark, ids_of, tmp_path):
    # rows that repeat a doc_id stand in the order of their texts' tags, so only their starts aren't compared
    rows = brute.odd_texts()
    got = token_store.stored_ids(brute.clashing(spark, rows), WORDS).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, n, c) for d, _, n, c in stored(rows, ids_of))
    ordered = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ordered, ordered[1:]))
    single = [r for r in rows if r[0] not in (11, 12)]
    path = str(tmp_path / "store")
    token_store.write_store(brute.clashing(spark, single), WORDS, path)
    ids = {r.doc_id: r.ids for r in token_store.read_ids(spark, path).collect()}
    assert ids == {d: [*ids_of(t), 1] for d, t in single if d is not None}
    assert spark.read.parquet(f"{path}/objects").where("kind = 'chunk'").groupBy("digest").count().where("count > 1").count() == 0
    manifest = spark.read.parquet(f"{path}/manifest")
    whole = manifest.where("file = -1").first()
    assert (whole.ids, whole.recipes) == (sum(map(len, ids.values())), len(ids))
    assert set(manifest.where("file >= 0").agg({"ids": "sum", "recipes": "sum"}).first()) == {whole.ids, whole.recipes}


def test_damaged_store_is_refused(docs, spark, tmp_path):
    """A lost, swapped or repeated recipe, an altered chunk and a changed manifest each fail the read."""
    path = str(tmp_path / "store")
    token_store.write_store(docs.limit(30), WORDS, path)
    held = {n: spark.read.parquet(f"{path}/{n}") for n in ("objects", "recipes", "manifest")}
    gone = held["recipes"].agg({"doc_id": "max"}).first()[0]
    one = held["recipes"].where(f"doc_id = {gone}")
    damages = {
        "chunk": ("objects", held["objects"].selectExpr("doc_id", "tag", "n_tokens", "digest", "case when kind = 'chunk' then concat(data, unhex('0000')) else data end as data", "kind")),
        "no_chunk": ("objects", held["objects"].where("kind = 'recipe'").select("doc_id", "tag", "n_tokens", "digest", "data", "kind")),
        "lost": ("recipes", held["recipes"].where(f"doc_id <> {gone}")),
        "repeated": ("recipes", held["recipes"].unionByName(one)),
        "swapped": ("recipes", held["recipes"].selectExpr("if(doc_id = 0, 1, if(doc_id = 1, 0, doc_id)) as doc_id", *held["recipes"].columns[1:])),
        "starts": ("recipes", held["recipes"].selectExpr("doc_id", "tag", "n_tokens", "root", "chunks", "file", "start + 1 as start", "place")),
        "lost_file": ("recipes", held["recipes"].where("file <> 1")),
        "manifest": ("manifest", held["manifest"].selectExpr("file", "recipes", "if(file = 0, ids + 1, ids) as ids", "root")),
        "lost_entry": ("manifest", held["manifest"].where("file <> 0")),
    }
    assert token_store.read_digests(spark, path).count() == 30
    for name, (table, damaged) in damages.items():
        at = str(tmp_path / name)
        for other, whole in held.items():
            rows = damaged if other == table else whole
            rows = rows.write if other != "objects" else rows.write.partitionBy("kind")
            rows.parquet(f"{at}/{other}")
        with pytest.raises(Exception, match="match"):
            token_store.read_digests(spark, at).collect()


def test_crc_of_joined_parts():
    parts = [b"", b"abc", b"0" * 1000, b"xyz"]
    assert token_store.crc_joined([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def verify_packing(got, rows, ids_of, capacity):
    want = Counter()
    for d, t in rows:
        if d is not None:
            ids = np.array([*ids_of(t), 1], "<u4")
            for i, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                want[(d, i, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    from bisect import bisect_left, insort

    room, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(room, x)
        left = (room.pop(i) if i < len(room) else capacity) - x
        n += i >= len(room) + (left + x != capacity)
        insort(room, left)
    return len(room)


@pytest.mark.parametrize("capacity", [4096, 300, 64])
def test_packing(docs, rows, ids_of, capacity):
    got = packing.pack(docs, WORDS, capacity=capacity).collect()
    n = verify_packing(got, rows, ids_of, capacity)
    least = -(-sum(r.length for r in got) // capacity)
    assert least <= n <= max(best_fit([r.length for r in got], capacity) * 1.01, least + 1)


def test_packing_of_odd_texts(odd, ids_of):
    verify_packing(packing.pack(odd, WORDS).collect(), brute.odd_texts(), ids_of, 4096)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert token_counts.count_tokens(none, WORDS).collect() == []
    assert token_store.stored_ids(none, WORDS).collect() == []
    assert packing.pack(none, WORDS).collect() == []


def test_chunks_depend_on_their_stream_alone():
    rng = np.random.default_rng(6)
    streams = [rng.integers(2, 50_000, n).astype("<u4") for n in (1, 3, 70, 20_000, 64, 5000)] + [np.full(9000, 7, "<u4")]
    ids = np.concatenate(streams)
    allowed, at = token_store.allowed_cuts(ids), 0
    for stream in streams:
        own = token_store.cuts(0, len(stream), token_store.allowed_cuts(stream).tolist())
        inside = allowed[(allowed > at) & (allowed <= at + len(stream))].tolist()
        assert [x - at for x in token_store.cuts(at, at + len(stream), inside)] == own
        sizes = np.diff([0, *own])
        assert sizes.sum() == len(stream) and sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()
        at += len(stream)


def test_counts_of_many_texts_of_one_doc_id(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    texts = [f"text {i} " + "again and " * (i % 9) for i in range(900)] + ["one"] * 5
    cache = str(tmp_path / "cache")
    got = Counter(tuple(r) for r in token_counts.count_tokens(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string"), WORDS, cache).select("n_bytes", "n_tokens").collect())
    assert got == Counter((len(t), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert spark.read.parquet(cache).count() == 901


def test_a_heavy_text_is_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 0.2)
    rows = spark.range(50_000).selectExpr("if(id % 3 = 0, 0, id % 100) as key", "id")
    entries = rows.groupBy("key").count().selectExpr("key", "count as n_rows", "key * 2 as said")
    got = common.look_up(rows, entries, "key", 50_000)
    assert "n_rows" not in got.columns
    assert got.selectExpr("count(*)", "count_if(said = key * 2)", "count(distinct id)").first() == (50_000,) * 3
