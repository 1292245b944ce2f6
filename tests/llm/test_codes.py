"""Vector codes against a brute-force version in Python's integers."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from auditlake.llm import vector_codes

ROWS = [
    (5, [0.5, -0.25, 1.0, 2.0], 1, "x"), (3, [0.1, 0.2, -0.3, 0.4], None, "x"), (3, [0.1, 0.2, -0.3, 0.4], None, "y"), (2, None, 1, "x"), (1, [], 1, "x"), (None, [1.0, 1.0, 1.0, 1.0], 2, "x"),
    (0, [1.0, None, 1.0, 1.0], 2, "x"), (4, [math.nan, 0.0, 0.0, 0.0], 2, "x"), (6, [math.inf, 0.0, 0.0, 0.0], 2, "x"), (7, [0.0, 0.0, 0.0, 0.0], None, "x"), (8, [0.5, -0.25, 1.0, 2.0], 1, "x"),
    (9, [1.0, 2.0], 1, "x"), (10, [1.0, 2.0, 3.0], 1, "x"), (-1, [-0.001, -0.002, 5.0, 5.001], 3, "x"), *((100 + i, [i / 7, -i / 11, (i * i) % 13 / 5, -1.5], i % 3, "z") for i in range(200)),
]


def plain(rows, parts, entries, rounds):
    """Rows as compress() returns them, and the digest of the codebooks."""
    kept = [(i, tuple(math.floor(256 * x) for x in v), la) for i, v, la in rows if i is not None and v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[:2])
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts if kept else 1
    cut = [[v[p * w : p * w + w] for _, v, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for x in cut[p]:
                mine[best(x, books[p])[1]].append(x)
            books[p] = [tuple(sum(x) // len(x) for x in zip(*mine[e])) if e in mine else c for e, c in enumerate(books[p])]
    found = [[best(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    errors = [sum(f[0] for f in fs) for fs in found]
    of = Counter()
    for (_, _, la), e in zip(kept, errors):
        of[la] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, la, "".join(f"{f[1]:02x}" for f in fs), e, of[la], digest) for (i, _, la), fs, e in zip(kept, found, errors))


def coded(spark, rows, *how):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")
    return Counter((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.codes_with_digest(made, *how).collect())


@pytest.mark.parametrize("how", [(2, 64, 2), (4, 5, 3), (1, 300, 1)])
def test_codes_are_exact(spark, how):
    assert coded(spark, ROWS, *how) == plain([r[:3] for r in ROWS], *how)


@pytest.mark.parametrize("times", [1e6, 3e9])
def test_large_components_stay_exact(spark, times):
    rows = [(i, v and [x if x is None else x * times for x in v], la, c) for i, v, la, c in ROWS]
    want = plain([r[:3] for r in rows], 2, 8, 2)
    assert coded(spark, rows, 2, 8, 2) == Counter({(*k[:3], min(k[3], vector_codes.LONGEST), min(k[4], vector_codes.LONGEST), k[5]): n for k, n in want.items()})


def test_blocks_of_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ROWS", 7)
    assert coded(spark, ROWS, 2, 16, 2) == plain([r[:3] for r in ROWS], 2, 16, 2)


@pytest.mark.parametrize("rows", [[], ROWS[3:9], ROWS[9:10]])
def test_few_or_no_vectors(spark, rows):
    assert coded(spark, rows, 2, 64, 2) == plain([r[:3] for r in rows], 2, 64, 2)


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "TOLD", 1)
    assert coded(spark, ROWS, 2, 64, 2) == plain([r[:3] for r in ROWS], 2, 64, 2)


def test_query_on_its_table(spark, sf):
    from auditlake.llm.queries import op11_vector_codes

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = Counter((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in op11_vector_codes(spark, sf).collect())
    assert got == plain(rows, 16, 64, 2)
