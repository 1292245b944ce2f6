"""Windows of a fixed number of tokens that occur earlier, found through content-sampled segments.

Every window of W tokens is assigned the token run of k inside it whose hash is smallest (its
anchor). Equal windows have equal anchors at equal places, so that it is enough to compare what
surrounds equal anchors. Rows of one doc_id with different texts stand in the order of their tags (64
bits of a hash of the text), so that places have one order: doc_id, tag, place. Consecutive windows with one anchor form a segment; a document of n tokens
has about 2n/(W-k+2) of them. A segment equal to an earlier one repeats in full. The others are
resolved window by window among the segments with their anchor.

Both substring operators share this sampling, the packed rows and the last step, which joins what
was found to the texts; how equal content is found is each operator's own.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import batched, to_batch

PACKED = pa.schema([("pid", pa.int32()), ("sub", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
PACKED_DDL = "pid int, sub int, kind int, data binary"
#: Kinds of packed rows. HOT comes before the runs and names an anchor that is crowded.
HOT, RUN, MARKS, LATE = -1, 0, 1, 2
#: A mark: document, tag of its text, first and past-the-last token.
MARK = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("end", "<i8")])
#: Positions that one call looks at; longer inputs are taken in overlapping parts.
SPAN = 1 << 22
#: Bytes of texts after which what is left of them is given out.
GIVEN_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` entries of h, the place of the smallest (of equal ones the last)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(h) > SPAN:
        step = SPAN - width + 1
        return np.concatenate([anchors(h[at : at + SPAN], width) + at for at in range(0, n, step)])
    low = np.uint64(SPAN - 1)
    packed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    rows = -(-len(h) // width)
    full = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(h)] = packed
    blocks = full.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (low - (least & low)).astype(np.int64)


def segments(h: np.ndarray, k: int, window: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h: hashes of the k tokens from each place of all documents on end; bounds: their offsets. First window, anchor, number of windows and document of each segment."""
    at = anchors(h, window - k + 1)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    inside = np.arange(len(at)) + window <= bounds[doc + 1]
    starts = np.flatnonzero(inside & np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1])))
    if not len(starts):
        return none, none, none, none
    last = np.flatnonzero(inside & np.concatenate(((at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~inside[1:], [True])))
    return starts, at[starts], last - starts + 1, doc[starts]


def joined(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks with those that touch or overlap made one, ordered by document and start."""
    if not len(doc):
        return np.zeros(0, MARK)
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    group = np.cumsum(first) - 1
    # the reach of what came before in the same document, by a running maximum over ends that are shifted apart by document
    top = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * top) - group * top
    opens = first | np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(opens)
    out = np.zeros(len(at), MARK)
    out["doc"], out["tag"], out["start"] = doc[at], tag[at], start[at]
    out["end"] = np.maximum.reduceat(end, at)
    return out


def mark_rows(marks: np.ndarray, n: int) -> Iterator[tuple]:
    """Packed rows of marks by the partition that their documents go to."""
    if not len(marks):
        return
    pid = doc_place(marks["doc"] ^ marks["tag"], n)
    order = np.argsort(pid, kind="stable")
    marks, pid = marks[order], pid[order]
    edges = np.flatnonzero(np.concatenate(([True], pid[1:] != pid[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:]):
        for at in range(a, b, 200_000):
            yield int(pid[a]), 0, MARKS, marks[at : min(b, at + 200_000)].tobytes()


class Marks:
    """Collects marks and gives them out packed, in bounded portions."""

    def __init__(self, n: int, most: int = 200_000):
        self.n, self.most, self.rows = n, most, array("q")

    def add(self, doc: int, tag: int, start: int, end: int) -> None:
        self.rows.extend((doc, tag, start, end))

    def out(self, last: bool = False) -> Iterator[tuple]:
        if self.rows and (last or len(self.rows) >= 4 * self.most):
            a = np.array(self.rows, dtype=np.int64).reshape(-1, 4)
            self.rows = array("q")
            yield from mark_rows(joined(a[:, 0], a[:, 1], a[:, 2], a[:, 3]), self.n)


#: Segments that share an anchor and may share windows, held at once; those of an anchor with more are handed on as they are read, to a second exchange that deals single windows.
TOGETHER = 2048
#: Segments of one anchor in one run from which on (twice as many for certain) they don't go to the anchor's task at all.
CROWD = 128


def crowds(keys: list) -> list[tuple[int, int]]:
    """Ranges of equal entries in sorted keys, each of over CROWD and every one of at least twice that."""
    found, at = [], 0
    for i in range(0, len(keys) - CROWD, CROWD):
        if i >= at and keys[i] == keys[i + CROWD]:
            at = bisect_right(keys, keys[i])
            found.append((bisect_left(keys, keys[i]), at))
    return found


def late_row(n: int, doc: int, tag: int, start: int, raw: bytes, low: int, high: int) -> tuple:
    """A segment for the second exchange; the windows low to high are in question."""
    return (doc + start) % n, 0, LATE, np.array([doc, start, tag, low, high], dtype="<i8").tobytes() + raw


class Windows:
    """Resolves single windows among segments of one anchor: the earliest keeps a window, the others get marks."""

    def __init__(self, marks: Marks, pieces: Callable[[bytes, int, int], list[bytes]], window: int, n: int):
        self.marks, self.pieces, self.n, self.window = marks, pieces, n, window
        self.held, self.ready, self.crowded = [], [], False

    def add(self, raw: bytes, low: int, high: int, doc: int, tag: int, start: int) -> None:
        """raw: the tokens of a segment; low to high: the windows in question; start: of window 0 in the document."""
        (self.ready if self.crowded else self.held).append((doc, tag, start, raw, low, high))
        if len(self.held) > TOGETHER:
            self.ready += self.held
            self.held, self.crowded = [], True

    def close(self) -> None:
        """All segments of an anchor have been added."""
        held, self.held, self.crowded = self.held, [], False
        if len(held) < 2:
            return
        every = sorted((piece, doc, tag, start + i) for doc, tag, start, raw, low, high in held for i, piece in enumerate(self.pieces(raw, low, high), low))
        for before, now in zip(every, every[1:]):
            # what follows the first of equal windows is later, and the same place is not
            if now[0] == before[0] and now != before:
                self.marks.add(*now[1:], now[3] + self.window)

    def out(self) -> Iterator[tuple]:
        """Rows for the second exchange."""
        ready, self.ready = self.ready, []
        for x in ready:
            yield late_row(self.n, *x)


def removed_spans(rows: DataFrame, found: DataFrame, n: int, last: Callable, result_ddl: str, result: pa.Schema) -> DataFrame:
    """Bring the marks to their documents. rows: doc_id, text, tag, and maybe a struct `more` that goes along; last(text bytes, starts, ends) gives the result's columns after doc_id.

    Marks are packed, a few rows for each task; they come first in each partition, then its documents, whose texts travel compressed, follow one batch at a time."""
    carried = "more" in rows.columns
    more = f", more {rows.schema['more'].dataType.simpleString()}" if carried else ""

    def shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = pa.array([packer.compress(t.as_buffer()) for t in batch.column("text")], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), "data", data)

    docs = rows.select("doc_id", "tag", "text", *["more"] * carried).mapInArrow(shut, f"doc_id long, tag long, data binary{more}")
    docs = docs.select(doc_place(F.col("doc_id").bitwiseXOR(F.col("tag")), n).alias("pid"), F.lit(1).alias("late"), *docs.columns)
    marks = found.select("pid", F.lit(0).alias("late"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"), "data")
    placed = docs.unionByName(marks, allowMissingColumns=True)
    ddl = result_ddl + more

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        by: dict[tuple[int, int], tuple[int, int]] | None = None
        marks, opener = np.zeros(0, MARK), zstandard.ZstdDecompressor()
        for batch in batches:
            late = batch.column("late").to_numpy(zero_copy_only=False).astype(bool)
            held += [np.frombuffer(x.as_py(), MARK) for x in batch.column("data").filter(pa.array(~late))]
            if not late.any():
                continue
            if by is None:
                every = np.concatenate(held) if held else np.zeros(0, MARK)
                held = []
                marks = joined(every["doc"], every["tag"], every["start"], every["end"])
                new = (marks["doc"][1:] != marks["doc"][:-1]) | (marks["tag"][1:] != marks["tag"][:-1])
                edge = np.flatnonzero(np.concatenate(([True], new, [True]))) if len(marks) else np.zeros(1, int)
                by = {(int(marks["doc"][a]), int(marks["tag"][a])): (a, b) for a, b in zip(edge[:-1], edge[1:])}
            batch = batch.filter(pa.array(late))
            out, size, at = [], 0, 0
            for i, (doc, tag, data) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("data")), 1):
                a, b = by.get((doc, tag), (0, 0))
                text = opener.decompress(data.as_py())
                out.append((doc, *last(text, marks["start"][a:b], marks["end"][a:b])))
                size += len(text)
                # texts are several times as large as they travelled
                if size >= GIVEN_BYTES or i == batch.num_rows:
                    made = to_batch(out, result)
                    yield made.append_column("more", batch.column("more").slice(at, i - at)) if carried else made
                    out, size, at = [], 0, i

    return placed.repartitionById(n, F.col("pid")).sortWithinPartitions("late").mapInArrow(finish, ddl)


def doc_place(doc, n: int):
    """The partition among n of a document, by its doc_id and tag (one XOR the other): the same arithmetic for a Column and for numpy integers."""
    if isinstance(doc, np.ndarray):
        bits = doc.astype(np.int64).view(np.uint64)
        return (bits ^ (bits >> np.uint64(15)) ^ (bits >> np.uint64(31))).view(np.int64) % n
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 15)).bitwiseXOR(F.shiftrightunsigned(doc, 31)), F.lit(n)).cast("int")
