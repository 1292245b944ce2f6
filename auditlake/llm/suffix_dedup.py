"""Duplicate substrings of bytes, by a distributed merge sort of suffixes.

Each task sorts the suffixes of its texts (a run), codes each suffix by the length of the prefix that
it shares with the one before it and the rest, and sends the run in pieces; a suffix's piece follows
from a hash of its first bytes, so that suffixes that share these bytes meet and frequent beginnings
don't crowd neighbouring ones. The tasks that receive the pieces merge them, at most FAN at a time,
with loser trees whose nodes keep the length of the prefix shared with the last suffix given out: of
two suffixes the one that shares more comes first, and bytes are looked at only past a shared prefix
of equal length, so that no known prefix is compared again.

A window of 100 bytes that occurs twice holds, at the same place, the same anchor of 16 bytes (see
segments.py), so only the suffixes that begin at anchors are sorted. A suffix reaches to the end of
the last window of its segment and is followed by what lies before the anchor, reversed. Neighbours
in the merged order then show which segments are equal, and how much a segment can share with any
other at most; of segments that may share a window, the windows are sorted where they are few. The
segments of a crowded anchor go through the same sort once more, with a suffix at every place instead
of at anchors only, dealt by a hash of the whole window: equal windows are neighbours there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from auditlake.llm.common import batched, cut, partitions, tagged_texts, utf8
from auditlake.llm.segments import HOT, LATE, MARK, MARKS, PACKED, PACKED_DDL, RUN, Marks, Windows, crowds, joined, late_row, mark_rows, mix, removed_spans, segments

ANCHOR = 16
#: Bytes of text in a run, in one numpy pass, and pieces of a run for each receiving task (read one after another).
RUN_BYTES, PASS_BYTES, PIECES = 12 << 20, 2 << 20, 8
#: Windows of crowded anchors in a run, and runs that are merged at a time.
RUN_WINDOWS, FAN = 200_000, 64


def byte_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    low = np.ndarray(n, "<u8", data, 0, (1,)).copy()
    high = np.ndarray(n, "<u8", data, 8, (1,)).copy()
    return mix(low * np.uint64(0xC2B2AE3D27D4EB4F) + mix(high))


def passes(data: np.ndarray, bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, to
        at = to


class Run:
    """The suffixes of some texts: equal ones held once, under the earliest; the others are marked at once."""

    def __init__(self, n: int, window: int):
        self.n, self.window, self.size = n, window, 0
        self.keys: dict[bytes, tuple] = {}
        self.again: list[tuple] = []

    def add(self, data: np.ndarray, bounds: np.ndarray, docs: np.ndarray, tags: np.ndarray) -> None:
        h = byte_hashes(data)
        start, anchor, count, doc = segments(h, ANCHOR, self.window, bounds)
        if not len(start):
            return
        raw = data.tobytes()
        ids, tag, place = docs[doc].tolist(), tags[doc].tolist(), (start - bounds[doc]).tolist()
        bucket = (h[anchor] % np.uint64(self.n * PIECES)).tolist()
        end = (start + count - 1 + self.window).tolist()
        keys, again = self.keys, self.again
        for s, q, e, d, t, p, b in zip(start.tolist(), anchor.tolist(), end, ids, tag, place, bucket):
            key = raw[q:e] + raw[s:q][::-1] + bytes((q - s,))
            was = keys.get(key)
            if was is None:
                keys[key] = (b, d, t, p)
            elif was[1:] <= (d, t, p):
                if was[1:] < (d, t, p):
                    again.append((d, t, p, p + e - s))
            else:
                keys[key] = (b, d, t, p)
                again.append((*was[1:], was[3] + e - s))

    def out(self, packer: zstandard.ZstdCompressor) -> Iterator[tuple]:
        if self.again:
            a = np.array(self.again, np.int64)
            yield from mark_rows(joined(a[:, 0], a[:, 1], a[:, 2], a[:, 3]), self.n)
        by: dict[int, list[bytes]] = {}
        for key, held in self.keys.items():
            by.setdefault(held[0], []).append(key)
        for bucket, keys in by.items():
            keys.sort()
            for a, b in reversed(crowds([k[:ANCHOR] for k in keys])):
                yield bucket % self.n, 0, HOT, keys[a][:ANCHOR]
                for key in keys[a:b]:
                    yield whole_late(key, *self.keys[key][1:], self.window, self.n)
                del keys[a:b]
            if keys:
                yield bucket % self.n, bucket // self.n, RUN, packer.compress(front_code(keys, self.keys))
        self.keys, self.again, self.size = {}, [], 0


def whole_late(key: bytes, doc: int, tag: int, place: int, window: int, n: int) -> tuple:
    """A suffix as a row of the second exchange, with all its windows."""
    left = key[-1]
    right = len(key) - 1 - left
    return late_row(n, doc, tag, place, key[right : right + left][::-1] + key[:right], 0, left + right - window + 1)


def front_code(keys: list[bytes], held: dict[bytes, tuple]) -> bytes:
    """Sorted keys in a coded run. held: of each key, a bucket and its document, tag and place."""
    size = np.array([len(k) for k in keys], np.int32)
    wide = np.frombuffer(b"".join(k.ljust(256, b"\0") for k in keys), np.uint8).reshape(len(keys), 256)
    shared = np.zeros(len(keys), np.int32)
    if len(keys) > 1:
        differ = wide[1:] != wide[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), 256)
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    return coded(shared, keys, *zip(*((x[1], x[3], x[2]) for x in map(held.__getitem__, keys))))


def coded(shared: np.ndarray, keys: list[bytes], doc: tuple, place: tuple, tag: tuple) -> bytes:
    """Counts, shared lengths, lengths of the rest, places and the rests of sorted keys."""
    more = np.array([len(k) for k in keys], np.int32) - shared
    rests = b"".join(k[c:] for k, c in zip(keys, shared.tolist()))
    return b"".join([np.array([len(keys)], "<i8").tobytes(), shared.astype(np.uint8).tobytes(), more.astype("<u2").tobytes(), *(np.array(x, "<i8").tobytes() for x in (doc, place, tag)), rests])


def decode(data: bytes) -> Iterator[tuple]:
    """(shared length, suffix, document, place, tag) in the run's order."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at = 8
    shared = np.frombuffer(data, np.uint8, n, at).tolist()
    at += n
    more = np.frombuffer(data, "<u2", n, at).tolist()
    at += 2 * n
    doc = np.frombuffer(data, "<i8", n, at).tolist()
    place = np.frombuffer(data, "<i8", n, at + 8 * n).tolist()
    tag = np.frombuffer(data, "<i8", n, at + 16 * n).tolist()
    at += 24 * n
    key = b""
    for c, m, d, p, t in zip(shared, more, doc, place, tag):
        key = key[:c] + data[at : at + m]
        at += m
        yield c, key, d, p, t


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """All entries in order, each with the length of the prefix that it shares with the one before it. A tree of losers: a node keeps the run that lost there and how much its head shares with the last winner of that node."""
    width = 1
    while width < len(runs):
        width *= 2
    head: list = [next(r, None) for r in runs] + [None] * (width - len(runs))
    shared = [0 if x is not None else -1 for x in head]
    loser = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's shared length is set against the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        k, m = head[a][1], head[b][1]
        n = min(len(k), len(m))
        differ = int.from_bytes(k[x:n], "big") ^ int.from_bytes(m[x:n], "big")
        c = n - (differ.bit_length() + 7) // 8
        if (k[c] < m[c]) if c < n else len(k) <= len(m):
            shared[b] = c
            return a, b
        shared[a] = c
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    best = build(1) if width > 1 else 0
    while shared[best] >= 0:
        now = head[best]
        yield shared[best], now[1], now[2], now[3], now[4]
        head[best] = following = next(runs[best], None)
        shared[best] = -1 if following is None else following[0]
        node = (best + width) >> 1
        while node:
            other = loser[node]
            x, y = shared[best], shared[other]
            if x < y:
                loser[node], best = best, other
            elif x == y and x >= 0:
                best, loser[node] = play(best, other)
            node >>= 1


def merged(runs: list[bytes]) -> Iterator[tuple]:
    """The entries of coded runs in order, by passes that merge FAN runs at a time."""
    while len(runs) > FAN:
        passed = []
        for at in range(0, len(runs), FAN):
            shared, *columns = zip(*merge([decode(r) for r in runs[at : at + FAN]]))
            passed.append(coded(np.array(shared, np.int32), *columns))
        runs = passed
    return merge([decode(r) for r in runs])


def slices(window: int):
    def pieces(raw: bytes, low: int, high: int) -> list[bytes]:
        return [raw[i : i + window] for i in range(low, high)]

    return pieces


def resolve(entries: Iterator[tuple], marks: Marks, single: Windows, window: int, hot: set[bytes]) -> Iterator[tuple]:
    """Read merged suffixes: mark repeats of equal segments, and take windows of the others to `single` where a neighbour in the order shares enough. Those of hot anchors are handed on. Gives packed rows as they fill up."""
    was: bytes | None = None
    doc = place = tag = before = 0

    def settle(after: int) -> None:
        """The segment `was` is complete; it shares `before` and `after` bytes with its neighbours, and no more with any other."""
        left, most = was[-1], max(before, after)
        if most >= window - left:
            right = len(was) - 1 - left
            count = left + right - window + 1
            # windows that reach further right than what is shared occur nowhere else
            high = count if most >= right else min(count, most - window + left + 1)
            single.add(was[right : right + left][::-1] + was[:right], 0, high, doc, tag, place)
        if after < ANCHOR:
            single.close()

    for shared, key, d, p, t in entries:
        if hot and key[:ANCHOR] in hot:
            # the next anchor shares less than an anchor with this one, as with the one before
            yield whole_late(key, d, t, p, window, single.n)
            continue
        if was is not None:
            if shared == len(was) == len(key):
                if (d, t, p) < (doc, tag, place):
                    d, p, t, doc, place, tag = doc, place, tag, d, p, t
                if (d, t, p) != (doc, tag, place):
                    marks.add(d, t, p, p + len(key) - 1)
                continue
            settle(shared)
            yield from marks.out()
            yield from single.out()
        was, before, doc, place, tag = key, shared, d, p, t
    if was is not None:
        settle(0)
    yield from single.out()


def suffix_duplicates(rows: DataFrame, window: int = 100) -> DataFrame:
    """Packed marks of all windows of `window` bytes that also start earlier, in a smaller doc_id or at a smaller place of the same text. rows: doc_id, text, tag."""
    if not ANCHOR < window <= 120:
        raise ValueError("window must be 17 to 120 bytes")
    n = partitions(rows.sparkSession)

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            run, packer = Run(n, window), zstandard.ZstdCompressor(level=3)
            for batch in batches:
                order = np.argsort(batch.column("doc_id").to_numpy(), kind="stable")
                batch = batch.take(pa.array(order))
                data, bounds = utf8(batch.column("text"))
                docs, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
                for a, b in passes(data, bounds, PASS_BYTES):
                    part = bounds[a : b + 1]
                    run.add(data[part[0] : part[-1]], part - part[0], docs[a:b], tags[a:b])
                    run.size += int(part[-1] - part[0])
                    if run.size >= RUN_BYTES:
                        yield from run.out(packer)
            yield from run.out(packer)

        yield from batched(out(), PACKED)

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(n)
        single = Windows(marks, slices(window), window, n)

        def out() -> Iterator[tuple]:
            sub, held, opener = -1, [], zstandard.ZstdDecompressor()
            hot: set[bytes] = set()
            for batch in batches:
                for s, kind, data in zip(*(batch.column(c).to_pylist() for c in ("sub", "kind", "data"))):
                    if kind == HOT:
                        hot.add(data)
                        continue
                    if kind == LATE:
                        yield s, 0, LATE, data
                        continue
                    if kind == MARKS:
                        yield -1, 0, MARKS, data  # its partition is set below
                        continue
                    if s != sub and held:
                        yield from resolve(merged([opener.decompress(x) for x in held]), marks, single, window, hot)
                        held = []
                    sub = s
                    held.append(data)
            if held:
                yield from resolve(merged([opener.decompress(x) for x in held]), marks, single, window, hot)
            yield from marks.out(last=True)
            yield from single.out()

        def placed() -> Iterator[tuple]:
            for pid, s, kind, data in out():
                if pid < 0:
                    yield from mark_rows(np.frombuffer(data, MARK), n)
                else:
                    yield pid, s, kind, data

        yield from batched(placed(), PACKED)

    runs = rows.select("doc_id", "text", "tag").mapInArrow(sort_runs, PACKED_DDL)
    found = cut(runs.repartitionById(n, "pid").sortWithinPartitions("kind", "sub").mapInArrow(merge_runs, PACKED_DDL))
    return found.where(found.kind == MARKS).unionByName(crowded_duplicates(found.where(found.kind == LATE), window, n))


def crowded_duplicates(late: DataFrame, window: int, n: int) -> DataFrame:
    """Marks for the windows of crowded anchors: the suffixes of one window's length at all their places are sorted in runs, in which equal ones are held once, and the runs are merged."""
    pieces = slices(window)

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, packer = Marks(n), zstandard.ZstdCompressor(level=3)
        held: dict[bytes, tuple] = {}

        def run() -> Iterator[tuple]:
            by: dict[int, list[bytes]] = {}
            for key, x in held.items():
                by.setdefault(x[0], []).append(key)
            for bucket, keys in by.items():
                keys.sort()
                yield bucket % n, bucket // n, RUN, packer.compress(front_code(keys, held))
            held.clear()

        def out() -> Iterator[tuple]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    doc, start, tag, low, high = np.frombuffer(data, "<i8", 5).tolist()
                    for i, key in enumerate(pieces(data[40:], low, high), low):
                        here, was = (doc, tag, start + i), held.get(key)
                        if was is None:
                            held[key] = (zlib.crc32(key) % (n * PIECES), *here)
                        elif was[1:] != here:
                            first, (d, t, at) = (was[1:], here) if was[1:] < here else (here, was[1:])
                            held[key] = (was[0], *first)
                            marks.add(d, t, at, at + window)
                    if len(held) >= RUN_WINDOWS:
                        yield from run()
                yield from marks.out()
            yield from run()
            yield from marks.out(last=True)

        yield from batched(out(), PACKED)

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, opener = Marks(n), zstandard.ZstdDecompressor()

        def repeats(runs: list[bytes]) -> Iterator[tuple]:
            first: tuple = ()
            for shared, key, d, p, t in merged([opener.decompress(x) for x in runs]):
                if shared < window:
                    first = (d, t, p)
                elif first != (d, t, p):
                    first, (d, t, p) = (first, (d, t, p)) if first < (d, t, p) else ((d, t, p), first)
                    marks.add(d, t, p, p + window)
                yield from marks.out()

        def out() -> Iterator[tuple]:
            sub, runs = -1, []
            for batch in batches:
                for s, kind, data in zip(*(batch.column(c).to_pylist() for c in ("sub", "kind", "data"))):
                    if kind == MARKS:
                        yield from mark_rows(np.frombuffer(data, MARK), n)
                        continue
                    if s != sub and runs:
                        yield from repeats(runs)
                        runs = []
                    sub = s
                    runs.append(data)
            if runs:
                yield from repeats(runs)
            yield from marks.out(last=True)

        yield from batched(out(), PACKED)

    runs = late.select("data").mapInArrow(sort_runs, PACKED_DDL)
    return runs.repartitionById(n, "pid").sortWithinPartitions("kind", "sub").mapInArrow(merge_runs, PACKED_DDL)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dedup_substrings(docs: DataFrame, window: int = 100, keep_text: bool = False) -> DataFrame:
    """Remove from each text the bytes covered by a string of `window` bytes that also starts earlier.

    Nulls and empty texts: 0 bytes, none removed. Rows without a doc_id take no part and aren't
    returned. Rows that repeat a doc_id are all returned; equal texts under one doc_id aren't earlier
    than each other, different ones come in the order of their tags. A window has 17 to 120 bytes (a
    suffix is at most 255 long); others are refused. Further columns, whatever their names, aren't
    used. An empty table gives an empty result. With keep_text, a column kept_text holds what is left (bytes
    that are no longer valid UTF-8 are replaced).
    """
    rows = tagged_texts(docs)
    n = partitions(docs.sparkSession)
    result = RESULT.append(pa.field("kept_text", pa.string())) if keep_text else RESULT

    def last(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
        kept, at = [], 0
        for a, b in zip(start.tolist(), end.tolist()):
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        left = b"".join(kept)
        out = (len(text), len(text) - len(left), len(start), sha256(left).hexdigest())
        return (*out, left.decode("utf-8", "replace")) if keep_text else out

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return removed_spans(rows, suffix_duplicates(rows, window), n, last, ddl, result)
