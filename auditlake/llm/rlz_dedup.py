"""Duplicate spans of words, by relative Lempel-Ziv parsing.

Texts are cut into segments of words around content-sampled anchors (see segments.py). Segments meet
by their anchor; the earlier ones are the reference blocks of that anchor, with an index of their
windows. Each segment is factored greedily against the blocks: from a word whose window is indexed
the factor runs on as far as it equals the block. A factor of at least a window is a duplicate span.
Parsing resumes with the first window that crosses the factor's end, so windows over a boundary
between factors are looked up as well and none is missed. The segment then joins the blocks.

Equal segments are collapsed where they arise and where they meet: one block stands for all copies.
Anchors with more different segments than a task should hold aren't parsed: their windows are looked
up one by one in an index that is dealt by the windows' digests, which finds the same spans.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import batched, cut, partitions, short_batches, tagged_texts
from auditlake.llm.segments import HOT, LATE, MARK, MARKS, PACKED, PACKED_DDL, RUN, TOGETHER, Marks, crowds, joined, late_row, mark_rows, mix, removed_spans, segments

#: Words in an anchor.
ANCHOR = 4
#: Bytes of text in a run and in one numpy pass, and pieces of a run for each receiving task.
RUN_BYTES, PASS_BYTES, PIECES = 6 << 20, 1 << 19, 8
#: Bytes of words that are hashed at once, and marks of repeats that are joined at once.
STRETCH, REPEATS = 1 << 17, 100_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power 0 .. n-1 and its inverses, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(int(BASE), -1, 1 << 64)
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, np.uint64(b))))) for b in (int(BASE), inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of single-spaced bytes. Sums run over a stretch of words at a time, so that what is held beside the words is bounded, but for a longer word."""
    gap = data == 32
    edge = np.flatnonzero(np.concatenate(([True], gap[:-1])) & ~gap)
    end = np.flatnonzero(np.concatenate((gap[1:], [True])) & ~gap) + 1
    h = np.zeros(len(edge), np.uint64)
    i = 0
    while i < len(edge):
        at = edge[i]
        j = max(i + 1, int(np.searchsorted(end, at + STRETCH, "right")))
        part = data[at : end[j - 1]]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        h[i:j] = (sums[end[i:j] - at] - sums[edge[i:j] - at]) * down[edge[i:j] - at]
        i = j
    return edge, end, mix(h)


def anchor_hashes(h: np.ndarray) -> np.ndarray:
    n = len(h) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, ANCHOR):
        out = mix(out) + h[i : i + n]
    return mix(out)


#: A segment of a run: its anchor's hash and how far into it that is, document, tag, first token, tokens, and where its bytes are among the texts of the run.
SEGMENT = np.dtype([("key", "<u8"), ("left", "<i2"), ("doc", "<i8"), ("tag", "<i8"), ("place", "<i8"), ("span", "<i4"), ("text", "<i4"), ("start", "<i8"), ("end", "<i8")])


class Run:
    """The segments of some texts, as places in them. Equal ones are given out once, under the earliest; the others are marked."""

    def __init__(self, n: int, window: int):
        self.n, self.window, self.size = n, window, 0
        self.texts: list[bytes] = []
        self.held: list[np.ndarray] = []

    def add(self, words: list[list[bytes]], docs: list[int], tags: list[int]) -> None:
        counts = np.array([len(w) for w in words], np.int64)
        if not counts.sum():
            return
        raw = b" ".join(b" ".join(w) for w in words if w)
        start, end, h = word_hashes(np.frombuffer(raw, np.uint8))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        h = anchor_hashes(h)
        first, anchor, count, doc = segments(h, ANCHOR, self.window, bounds)
        if not len(first):
            return
        e = np.zeros(len(first), SEGMENT)
        e["key"], e["left"], e["doc"], e["tag"] = h[anchor], anchor - first, np.array(docs, np.int64)[doc], np.array(tags, np.int64)[doc]
        e["place"], e["span"], e["text"] = first - bounds[doc], count + self.window - 1, len(self.texts)
        e["start"], e["end"] = start[first], end[first + count + self.window - 2]
        self.texts.append(raw)
        self.held.append(e)

    def out(self, packer: zstandard.ZstdCompressor) -> Iterator[tuple]:
        if self.held:
            e, texts = np.concatenate(self.held), self.texts
            self.held, self.texts = [], []
            bucket = (e["key"] % np.uint64(self.n * PIECES)).astype(np.int64)
            # equal contents have one anchor at one place: their windows fix it, whatever stands around them
            order = np.lexsort((e["place"], e["tag"], e["doc"], e["left"], e["key"], bucket))
            e, bucket = e[order], bucket[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            again, of = array("q"), array("q")
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                earliest: dict[bytes, int] = {}
                where = zip(*(e[c][a:b].tolist() for c in ("text", "start", "end")))
                for i, (k, s, t) in enumerate(where, a):
                    if (first := earliest.setdefault(texts[k][s:t], i)) != i:
                        again.append(i)
                        of.append(first)
                yield from self.bucket(int(bucket[a]), e[[*earliest.values()]], [*earliest], packer)
            del texts
            yield from self.repeats(e, np.array(again, np.int64), np.array(of, np.int64))
        self.size = 0

    def bucket(self, bucket: int, e: np.ndarray, contents: list[bytes], packer: zstandard.ZstdCompressor) -> Iterator[tuple]:
        """Different segments of one bucket, ordered by key; those of crowded anchors go to the second exchange."""
        left = np.ones(len(e), bool)
        for a, b in reversed(crowds(e["key"].tolist())):
            yield bucket % self.n, 0, HOT, int(e["key"][a]).to_bytes(8, "little")
            for i in range(a, b):
                yield whole_late(contents[i], *(int(e[c][i]) for c in ("doc", "tag", "place")), self.window, self.n)
            left[a:b] = False
        if left.any():
            yield bucket % self.n, bucket // self.n, RUN, packer.compress(pack(e[left], [contents[i] for i in np.flatnonzero(left).tolist()]))

    def repeats(self, e: np.ndarray, again: np.ndarray, of: np.ndarray) -> Iterator[tuple]:
        """Marks of segments that repeat an earlier one; what stands at the same place, in a repeated row, is no repeat."""
        for at in range(0, len(again), REPEATS):
            x, y = e[again[at : at + REPEATS]], e[of[at : at + REPEATS]]
            x = x[(x["doc"] != y["doc"]) | (x["tag"] != y["tag"]) | (x["place"] != y["place"])]
            yield from mark_rows(joined(x["doc"], x["tag"], x["place"], x["place"] + x["span"]), self.n)


def pack(e: np.ndarray, contents: list[bytes]) -> bytes:
    parts = [np.array([len(e)], "<i8"), *(np.ascontiguousarray(e[c]) for c in ("key", "doc", "place")), (e["end"] - e["start"]).astype("<i4"), *(np.ascontiguousarray(e[c]) for c in ("tag", "left"))]
    return b"".join([*(p.tobytes() for p in parts), *contents])


def whole_late(content: bytes, doc: int, tag: int, place: int, window: int, n: int) -> tuple:
    """A segment as a row of the second exchange, with all its windows."""
    return late_row(n, doc, tag, place, content, 0, content.count(b" ") + 2 - window)


def columns(data: bytes) -> list[np.ndarray]:
    """Of packed rows: key, doc, place, size of the content, tag, and where the content starts."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at, out = 8, []
    for kind in ("<u8", "<i8", "<i8", "<i4", "<i8", "<i2"):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    size = out[3].astype(np.int64)
    return [*out[:5], at + np.cumsum(size) - size]


def by_anchor(blobs: list[bytes], hot: set[int]) -> Iterator[tuple[bool, Iterator[tuple]]]:
    """The segments (doc, place, tag, content) of each anchor that has several or is hot, read as they are asked for, and whether the anchor is crowded."""
    key, doc, place, size, tag, start = (np.concatenate(c) for c in zip(*map(columns, blobs)))
    blob = np.repeat(np.arange(len(blobs)), [int(np.frombuffer(b, "<i8", 1)[0]) for b in blobs])
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]], [True])))
    several = np.diff(edge) > 1
    if hot:
        several |= np.isin(key[order[edge[:-1]]], np.array([*hot], np.uint64))
    for a, b in zip(edge[:-1][several].tolist(), edge[1:][several].tolist()):
        crowded = b - a > TOGETHER or bool(hot) and int(key[order[a]]) in hot

        def rows(a: int = a, b: int = b) -> Iterator[tuple]:
            for at in range(a, b, 1024):
                i = order[at : min(b, at + 1024)]
                for k, d, p, m, t, s in zip(*(c[i].tolist() for c in (blob, doc, place, size, tag, start))):
                    yield d, p, t, blobs[k][s : s + m]

        yield crowded, rows()


class Blocks:
    """The reference blocks of one anchor and the index of their windows."""

    def __init__(self, window: int):
        self.window = window
        self.index: dict[bytes, tuple[list[bytes], int]] = {}

    def parse(self, content: bytes) -> list[tuple[int, int]]:
        """Factors of at least a window, in words; then the content becomes a block."""
        words = content.split(b" ")
        window, index = self.window, self.index
        at = [0, *accumulate(len(w) + 1 for w in words)]
        keys = [content[at[i] : at[i + window] - 1] for i in range(len(words) - window + 1)]
        found, i = [], 0
        while i < len(keys):
            hit = index.get(keys[i])
            if hit is None:
                index[keys[i]] = (words, i)
                i += 1
                continue
            block, o = hit
            if block is words:  # a repeat inside the segment itself
                found.append((i, i + window))
                i += 1
                continue
            n = window
            while i + n < len(words) and o + n < len(block) and words[i + n] == block[o + n]:
                n += 1
            found.append((i, i + n))
            i += n - window + 1
        return found


def word_slices(window: int):
    def pieces(raw: bytes, low: int, high: int) -> list[bytes]:
        at = [0, *accumulate(len(w) + 1 for w in raw.split(b" "))]
        return [raw[at[i] : at[i + window] - 1] for i in range(low, high)]

    return pieces


def factor_group(rows: Iterator[tuple], marks: Marks, window: int) -> None:
    """All segments of one anchor: repeats of a content are marked, different contents are parsed in the order of their earliest places."""
    earliest: dict[bytes, tuple] = {}
    for d, p, t, content in rows:
        was = earliest.setdefault(content, (d, t, p))
        if (d, t, p) < was:
            earliest[content] = (d, t, p)
            d, t, p = was
        if (d, t, p) != earliest[content]:
            marks.add(d, t, p, p + content.count(b" ") + 1)
    if len(earliest) < 2:
        return
    blocks = Blocks(window)
    for content, (d, t, p) in sorted(earliest.items(), key=lambda x: x[1]):
        for a, b in blocks.parse(content):
            marks.add(d, t, p + a, p + b)


#: Windows that a task remembers before they are dealt.
REMEMBERED = 200_000


def late_marks(late: DataFrame, pieces: Callable[[bytes, int, int], list[bytes]], window: int, n: int) -> DataFrame:
    """Marks for the windows of crowded anchors. A task marks all but the earliest of a window that it meets and deals that one by the window's digest, so that a common window is one row a task; what meets there is read in order, and no group is held."""
    ddl = "pid int, win binary, doc long, tag long, at long, data binary"
    schema = pa.schema([("pid", pa.int32()), ("win", pa.binary()), ("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(n)
        first: dict[bytes, tuple[int, int, int]] = {}

        def dealt() -> Iterator[tuple]:
            for win, where in first.items():
                yield int.from_bytes(win[:4], "little") % n, win, *where, None
            first.clear()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    doc, start, tag, low, high = np.frombuffer(data, "<i8", 5).tolist()
                    for i, piece in enumerate(pieces(data[40:], low, high), low):
                        win, here = blake2b(piece, digest_size=16).digest(), (doc, tag, start + i)
                        was = first.setdefault(win, here)
                        if was != here:
                            first[win], (d, t, at) = (was, here) if was < here else (here, was)
                            marks.add(d, t, at, at + window)
                    if len(first) >= REMEMBERED:
                        yield from dealt()
                for pid, _, _, packed in marks.out():
                    yield pid, None, None, None, None, packed
            yield from dealt()
            for pid, _, _, packed in marks.out(last=True):
                yield pid, None, None, None, None, packed

        yield from batched(rows(), schema, most_rows=20_000)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(n)

        def rows() -> Iterator[tuple]:
            was, least = None, None
            for batch in batches:
                for win, doc, tag, at, packed in zip(*(batch.column(c).to_pylist() for c in ("win", "doc", "tag", "at", "data"))):
                    if win is None:
                        yield from mark_rows(np.frombuffer(packed, MARK), n)
                    elif win != was:
                        was, least = win, (doc, tag, at)
                    elif least < (doc, tag, at):
                        marks.add(doc, tag, at, at + window)
                yield from marks.out()
            yield from marks.out(last=True)

        yield from batched(rows(), PACKED)

    dealt = late.select("data").mapInArrow(expand, ddl).repartitionById(n, "pid").sortWithinPartitions("win", "doc", "tag", "at")
    return dealt.mapInArrow(pick, PACKED_DDL)


def word_duplicates(rows: DataFrame, window: int = 20) -> DataFrame:
    """Packed marks of all windows of `window` words whose words also start earlier, in a smaller doc_id or at a smaller place of the same text. rows: doc_id, text, tag."""
    if window <= ANCHOR:
        raise ValueError(f"window must be over {ANCHOR} words")
    n = partitions(rows.sparkSession)

    def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            run, packer = Run(n, window), zstandard.ZstdCompressor(level=3)
            held: list[tuple] = []
            size = 0
            for batch in batches:
                for doc, tag, text in zip(*(batch.column(c) for c in ("doc_id", "tag", "text"))):
                    data = text.as_py().encode()
                    held.append((doc.as_py(), tag.as_py(), data.split()))
                    size += len(data)
                    run.size += len(data)
                    if size >= PASS_BYTES:
                        run.add([x[2] for x in held], [x[0] for x in held], [x[1] for x in held])
                        held.clear()
                        size = 0
                        if run.size >= RUN_BYTES:
                            yield from run.out(packer)
            run.add([x[2] for x in held], [x[0] for x in held], [x[1] for x in held])
            yield from run.out(packer)

        yield from batched(out(), PACKED)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(n)
        opener = zstandard.ZstdDecompressor()
        hot: set[int] = set()

        def groups(held: list[bytes]) -> Iterator[tuple]:
            if not held:
                return
            for crowded, rows in by_anchor([opener.decompress(data) for data in held], hot):
                if crowded:
                    for d, p, t, content in rows:
                        yield whole_late(content, d, t, p, window, n)
                else:
                    factor_group(rows, marks, window)
                    yield from marks.out()

        def out() -> Iterator[tuple]:
            sub, held = -1, []
            for batch in batches:
                for s, kind, data in zip(*(batch.column(c).to_pylist() for c in ("sub", "kind", "data"))):
                    if kind == HOT:
                        hot.add(int.from_bytes(data, "little"))
                        continue
                    if kind == LATE:
                        yield s, 0, LATE, data
                        continue
                    if kind == MARKS:
                        yield from mark_rows(np.frombuffer(data, MARK), n)
                        continue
                    if s != sub and held:
                        yield from groups(held)
                        held = []
                    sub = s
                    held.append(data)
            yield from groups(held)
            yield from marks.out(last=True)

        yield from batched(out(), PACKED)

    runs = rows.select("doc_id", "text", "tag").mapInArrow(cut_segments, PACKED_DDL)
    parsed = cut(runs.repartitionById(n, "pid").sortWithinPartitions("kind", "sub").mapInArrow(factor, PACKED_DDL))
    late = late_marks(parsed.where(parsed.kind == LATE), word_slices(window), window, n)
    return parsed.where(parsed.kind == MARKS).unionByName(late)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def dedup_spans(docs: DataFrame, window: int = 20, keep_text: bool = False, more: list[str] | None = None) -> DataFrame:
    """Remove the words covered by a window of `window` words whose words also start earlier.

    Words are runs of bytes other than ASCII white space. Nulls and texts without a word: 0 words.
    Rows without a doc_id take no part and aren't returned. Rows that repeat a doc_id are all
    returned; equal texts under one doc_id aren't earlier than each other, different ones come in the
    order of their tags. Further columns aren't used. An empty table gives an empty result. With keep_text, a column kept_text
    holds the kept words, joined by single spaces, and the text unchanged where none goes. Columns
    named in `more` go along, as the fields of a struct of that name.
    """
    short_batches(docs.sparkSession)
    rows = tagged_texts(docs, F.struct(*more).alias("more")) if more else tagged_texts(docs)
    n = partitions(docs.sparkSession)
    result = RESULT.append(pa.field("kept_text", pa.string())) if keep_text else RESULT

    def last(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
        words = text.split()
        kept, at = [], 0
        for a, b in zip(start.tolist(), end.tolist()):
            kept += words[at:a]
            at = b
        kept += words[at:]
        left = b" ".join(kept)
        out = (len(words), len(words) - len(kept), sha256(left).hexdigest())
        return (*out, (left if len(start) else text).decode("utf-8", "replace")) if keep_text else out

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return removed_spans(rows, word_duplicates(rows, window), n, last, ddl, result)
