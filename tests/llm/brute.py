"""Plain restatements of what the operators return, for small tables."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import xxhash

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, tag string, more string, pid int, score double, predicted int, digest binary, n_bytes long, start string, kind string, data string, held_out string, item_id long, fp long, id long, piece int, length int, part int"


def clashing(spark, rows, numbered=True):
    """Rows (doc_id, text) under a schema with columns of the names that operators use themselves."""
    more = (None, "x", None, "a tag", None, 7, 0.5, None, b"d", -1, "s", None, "data", None, 3, None, 1, 0, 0, None)
    return spark.createDataFrame([(d, t, *more) for d, t in rows], CLASHING)


def words_of(text):
    return (text or "").encode().split()


def odd_texts():
    """Nulls, empty and blank texts, copies, repeated rows, periodic texts, long ones, and rows without an id."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}{'abcdefg'[i % 7]}" for i in range(900)]
    pick = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 900, n))
    passage, other = pick(60), pick(45)
    long = pick(30_000)
    return [
        (1, None), (2, ""), (3, " \t\n  "), (4, "short text"), (5, long), (6, long), (7, "ab " * 300), (8, "ab " * 300),
        (9, f"{pick(30)} {passage} {pick(20)} {other}"), (10, f"{other} {pick(5)} {passage}"), (11, f"{passage}"), (11, f"{passage}"),
        (12, f"{passage} {pick(100)}"), (12, f"{passage} {pick(80)} {other}"), (-3, f"{pick(25)} {other} {pick(25)}"), (None, passage), (None, None),
        (13, "naïve Straße 🙂 ünïcode — „quotes“ " + pick(40)), (14, f"{passage[:150]} {passage[150:]}"), (15, "x" * 5000), (16, "x" * 777),
        (17, None), (18, "short text"), (19, "one"), (1 << 40, f"{pick(10)} {passage} {pick(10)}"), (20, "Naïve\tone\x0btwo\x0cthree\r\nfour"),
    ]


def tagged(df):
    """(doc_id, text, tag of the text) of each row: places are ordered by doc_id, tag, place."""
    from auditlake.llm.common import tagged_texts

    return [(r.doc_id, r.text, r.tag) for r in tagged_texts(df.select("doc_id", "text")).collect()]


def repeated(tokens_of, window, rows):
    """Tokens of each row and which of them a window covers that also starts earlier. rows: doc_id, text, and tags where a doc_id repeats."""
    first: dict = {}
    held = [(d, t[0] if t else 0, tokens_of(text)) for d, text, *t in rows if d is not None]
    for d, t, tokens in held:
        for i in range(len(tokens) - window + 1):
            key = tokens[i : i + window] if isinstance(tokens, bytes) else tuple(tokens[i : i + window])
            first[key] = min((d, t, i), first.get(key, (d, t, i)))
    for d, t, tokens in held:
        gone = np.zeros(len(tokens) + 1, bool)
        for i in range(len(tokens) - window + 1):
            key = tokens[i : i + window] if isinstance(tokens, bytes) else tuple(tokens[i : i + window])
            if first[key] < (d, t, i):
                gone[i : i + window] = True
        yield d, tokens, gone


def substrings(rows, window=100):
    for d, data, gone in repeated(lambda t: (t or "").encode(), window, rows):
        kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
        yield d, len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), sha256(kept).hexdigest()


def spans(rows, window=20):
    for d, words, gone in repeated(words_of, window, rows):
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        yield d, len(words), int(gone.sum()), sha256(kept).hexdigest(), kept


def fingerprint(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, most=3):
    """doc_id, fingerprint and smallest doc_id reachable."""
    rows = [(d, fingerprint(t)) for d, t in rows if d is not None]
    fps = np.array(sorted({f for _, f in rows}), np.uint64)
    group = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most
    while True:
        new = np.array([group[row].min() for row in near])
        if (new == group).all():
            break
        group = new
    of = dict(zip(fps.tolist(), group.tolist()))
    least: dict = {}
    for d, f in rows:
        least[of[f]] = min(d, least.get(of[f], d))
    return [(d, f"{f:016x}", least[of[f]]) for d, f in rows]


def near_groups(rows, k=5, least=0.8):
    """The smallest doc_id of each document's group: those whose sets of shingles of ASCII-lower-cased words are similar enough are linked."""
    sets = {}
    for d, t in rows:
        words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()
    group = {d: d for d in sets}
    held = sorted(sets)
    for n, a in enumerate(held):
        for b in held[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and group[a] != group[b] and len(x & y) >= least * len(x | y):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return group


def edit_distance_inside(item, text):
    """Least edit distance of the item to any substring of the text."""
    a, t = np.frombuffer(item.encode("latin-1"), np.uint8), np.frombuffer(text.encode("latin-1"), np.uint8)
    row = np.zeros(len(t) + 1, np.int64)
    step = np.arange(len(t) + 1)
    for c in a:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (t != c))
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def folded(text):
    raw = bytearray((text or "").encode())
    for i, b in enumerate(raw):
        c = chr(b)
        raw[i] = ord(c.lower()) if "A" <= c <= "Z" else b if b > 127 or c.isalnum() else 32
    return b" ".join(bytes(raw).split()).decode("latin-1")


def leaks(rows, items, errors_per=16):
    out = set()
    for i, item in items:
        item = folded(item)
        if i is None or not item:
            continue
        for d, text in rows:
            if d is None:
                continue
            if len(item) < errors_per:
                if f" {item} " in f" {folded(text)} ":
                    out.add((d, i, 0))
            elif (n := edit_distance_inside(item, f" {folded(text)} ")) <= len(item) // errors_per:
                out.add((d, i, n))
    return out


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus
