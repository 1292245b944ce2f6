"""Alignment of two tokenizers against one worked out byte by byte."""

import hashlib
from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditlake.llm import alignment
from auditlake.llm.alignment import Aligner

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def groups():
    """The groups of a text: lists of A ids and of B ids."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    written = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    written |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in written.values())}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if name.startswith("<0x") and len(name) == 6 else name.replace("▁", " ").encode()

    def find(text):
        if not text:
            return []
        raw = (" " + text).encode()
        left = [(i, bytes(written[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, piece(i)) for i in b.encode(text)]
        if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            return []
        ends = []
        for side in (left, right):
            at, mine = 0, set()
            for _, x in side:
                at += len(x)
                mine.add(at)
            ends.append(mine)
        out = []
        borders = sorted(ends[0] & ends[1])
        for side in (left, right):
            at, k, held = 0, 0, [[] for _ in borders]
            for i, x in side:
                at += len(x)
                held[k].append(i)
                k += at == borders[k]
            out.append(held)
        return list(zip(*out))

    return find


def plain(rows, groups):
    found = [(d, groups(t)) for d, t in rows if d is not None]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    count = Counter(p for n in links for p in n)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for (d, g), n in zip(found, links):
        digest = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g).encode()).hexdigest() if g else ""
        yield d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values()), sum(k for p, k in n.items() if count[p] == best[p[0]]), sum(k * count[p] for p, k in n.items()), digest


TRICKY = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb\n", "\n", "\na \n b", "a \n", "tab\tand \x0b more", "a<|endoftext|>b <s> </s><unk>", "naïve Straße 日本語 🙂🙃", "x▁y", "▁", "a b c", "\x00\x1c\x1d d", "ﬁ ①Ａ", "don't  'S we'll", "12 3.4½", "é", "\r\n\r\n a", "<0x0A>", "x" * 3000, "a\x85b", "=" * 40 + "\n" + "-" * 70, "end.\nNew  line"]


def shown(aligner, text):
    runs = aligner.texts([text])[0]
    return [tuple([int(x) for x in s.split(",")] for s in g.split("|")) for r in runs for g in r.groups.split(";")] if runs else []


def test_tricky_texts(groups, rows):
    aligner = Aligner(*PATHS)
    assert aligner.by_runs
    for text in [*TRICKY, *(t for _, t in rows[:60]), *(t for _, t in brute.odd_texts() if t)]:
        assert shown(aligner, text) == [(a, b) for a, b in groups(text)], text[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\tabcThe.,'▁é日 \r1_-"), max_size=40))
def test_any_text(groups, text):
    aligner = alignment.aligner(*PATHS)
    assert shown(aligner, text) == [(a, b) for a, b in groups(text)]


def test_few_runs_are_remembered(groups, monkeypatch, rows):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    aligner = Aligner(*PATHS)
    for _, text in rows[:40]:
        assert shown(aligner, text) == [(a, b) for a, b in groups(text)]
    assert len(aligner.before) < 5000


@pytest.mark.parametrize("told", [1 << 20, 1])
def test_odd_rows(spark, odd, groups, monkeypatch, told):
    monkeypatch.setattr(alignment, "TOLD", told)
    more = brute.clashing(spark, [*brute.odd_texts(), *((500 + i, t) for i, t in enumerate(TRICKY))])
    got, counts = alignment.align(more, *PATHS)
    rows = [(r.doc_id, r.text) for r in more.collect()]
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == Counter(plain(rows, groups))
    want = Counter(p for d, t in rows if d is not None for p in {(x, y) for a, b in groups(t) for x in a for y in b})
    assert {(r.a_id, r.b_id): r.n_docs for r in counts.collect()} == want


@pytest.mark.parametrize("texts", [[], [(1, None)], [(None, "a b")], [(3, "x▁y"), (3, "one"), (3, "one")]])
def test_few_rows(spark, groups, texts):
    got, _ = alignment.align(brute.clashing(spark, texts), *PATHS)
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == Counter(plain(texts, groups))


def test_query_on_its_table(spark, sf, rows, groups):
    from auditlake.llm.queries import op13_alignment

    assert Counter(map(tuple, op13_alignment(spark, sf).select(*COLUMNS).collect())) == Counter(plain(rows, groups))
