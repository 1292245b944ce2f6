"""Packing documents into sequences of a fixed number of tokens, by linear grouping and best fit.

Documents are encoded and cut once; what is planned is only how many pieces there are of each length,
at most as many numbers as a sequence has tokens, so that the plan's size does not grow with the
corpus. Large lengths are sorted into groups of equal cardinality and rounded up to the largest of
their group; configurations of these few sizes are chosen to fill a sequence best; the actual pieces
then take the places of the rounded ones, group by group in order of length; small pieces go, longest
first, where the least space is left, and open new sequences when none has room. A run of sequences
filled alike is one entry of the plan. Pieces find their place by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import batched, cut, partitions, tagged_texts
from auditlake.llm.tokens import encoder

PIECE = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, tag long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        close = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity

        def out() -> Iterator[tuple]:
            for batch in batches:
                for doc, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")):
                    data = ids_of(text.as_py()) + close
                    for i, at in enumerate(range(0, len(data), step)):
                        part = data[at : at + step]
                        yield doc, tag, i, at // 4, len(part) // 4, zlib.crc32(part)

        yield from batched(out(), PIECE)

    return tagged_texts(docs).mapInArrow(run, PIECE_DDL)


def fill(sizes: list[int], left: dict[int, int], space: int) -> list[tuple[int, int]]:
    """Which of few sizes, and how often each, fill `space` best. sizes: largest first; left: how many there are of each. Exact over the reachable sums, each kept with the fewest items."""
    # reach[s]: the last size used and its number to come to the sum s
    reach: list[dict[int, tuple[int, int]]] = []
    sums = {0: 0}
    for size in sizes:
        new: dict[int, tuple[int, int]] = {}
        most = min(left[size], space // size)
        for s in sums:
            for k in range(1, most + 1):
                t = s + k * size
                if t > space:
                    break
                if t not in sums and t not in new:
                    new[t] = (s, k)
        sums.update(dict.fromkeys(new, 0))
        reach.append(new)
        if space in sums:
            break
    at, out = max(sums), []
    for size, new in zip(reversed(sizes[: len(reach)]), reversed(reach)):
        if at in new:
            at, k = new[at]
            out.append((size, k))
    return out


def plan(counts: dict[int, int], capacity: int, large: int, groups: int) -> tuple[np.ndarray, int]:
    """counts: pieces of each length. Entries (length, first rank, number, first sequence, offset): pieces of a length with ranks from the first on lie at the offset of as many sequences. And the number of sequences."""
    counts = {k: v for k, v in counts.items() if v}
    taken: dict[int, int] = defaultdict(int)
    entries: list[tuple[int, int, int, int, int]] = []
    bins: list[list] = []  # space left, number, first sequence
    top = 0

    def place(length: int, number: int, first: int, offset: int) -> None:
        entries.append((length, taken[length], number, first, offset))
        taken[length] += number

    # groups of equal cardinality; a length that many pieces have may fill several groups, and then is not rounded
    order = sorted((k for k in counts if k > large), reverse=True)
    total = sum(counts[k] for k in order)
    per = max(1, -(-total // groups))
    members: list[list[list[int]]] = []  # of each group: [length, number], longest first
    room = 0
    for k in order:
        rest = counts[k]
        while rest:
            if not room:
                members.append([])
                room = per
            take = min(rest, room)
            members[-1].append([k, take])
            rest, room = rest - take, room - take
    by_size: dict[int, list[list[int]]] = {}
    for group in members:
        by_size.setdefault(group[0][0], []).extend(group)
    left = {size: sum(x[1] for x in group) for size, group in by_size.items()}
    while left:
        size = max(left)
        others = sorted((s for s in left if s <= capacity - size), reverse=True)
        rest = dict(left)
        rest[size] -= 1
        config = dict(fill([s for s in others if rest[s] > 0], rest, capacity - size))
        config[size] = config.get(size, 0) + 1
        times = min(left[s] // k for s, k in config.items())
        slots = [s for s, k in sorted(config.items(), reverse=True) for _ in range(k)]
        # the actual pieces: each slot takes the next ones of its group; a run ends where a slot's length changes
        queues = []
        for s in slots:
            need, got = times, []
            while need:
                head = by_size[s][0]
                n = min(need, head[1])
                got.append([head[0], n])
                head[1] -= n
                need -= n
                if not head[1]:
                    by_size[s].pop(0)
            queues.append(got)
        done = 0
        while done < times:
            n = min(q[0][1] for q in queues)
            offset = 0
            for q in queues:
                place(q[0][0], n, top, offset)
                offset += q[0][0]
                q[0][1] -= n
                if not q[0][1]:
                    q.pop(0)
            bins.append([capacity - offset, n, top])
            top += n
            done += n
        for s, k in config.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    # small pieces, longest first, into the least space that holds them
    bins.sort()
    for length in sorted((k for k in counts if k <= large), reverse=True):
        rest = counts[length]
        while rest:
            i = bisect_left(bins, [length])
            if i == len(bins):
                each = min(rest, capacity // length)
                n = rest // each
                for j in range(each):
                    place(length, n, top, j * length)
                insort(bins, [capacity - each * length, n, top])
                top += n
                rest -= n * each
                continue
            space, n, first = bins.pop(i)
            each = min(space // length, rest)
            use = min(n, rest // each)
            for j in range(each):
                place(length, use, first, capacity - space + j * length)
            rest -= use * each
            if space - each * length:
                insort(bins, [space - each * length, use, first])
            if n > use:
                insort(bins, [space, n - use, first + use])
    return np.array(sorted(entries), np.int64).reshape(-1, 5), top


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, large: int | None = None, groups: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    A null or empty text is its end id alone. Texts of over `capacity` ids are cut, others never are.
    large: lengths over it are grouped (an eighth of the capacity unless given). Rows without a
    doc_id take no part; rows that repeat one are all packed. Further columns aren't used. An empty
    table gives none.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    # cut first: the ranges are sampled, and what lies before would be done twice
    pieces = cut(pieces_of(docs, tokenizer, capacity, end_id))
    pieces = cut(pieces.repartitionByRange(n, F.desc("length"), "doc_id", "tag", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "tag", "piece").withColumn("part", F.spark_partition_id()))
    # at most one row for each length, and one more for each partition
    per = sorted((r.part, -r.length, r.n) for r in pieces.groupBy("part", "length").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for part, length, k in per:
        before[part, -length] = counts[-length]
        counts[-length] += k
    table, _ = plan(counts, capacity, capacity // 8 if large is None else large, groups)
    keys = table[:, 0] * (1 << 40) + table[:, 1] if len(table) else np.zeros(0, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            part = batch.column("part")[0].as_py()
            rank = np.empty(len(length), np.int64)
            edge = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1], [True])))
            for a, b in zip(edge[:-1], edge[1:]):
                k = int(length[a])
                at = seen.get(k, before[part, k])
                rank[a:b] = np.arange(at, at + b - a)
                seen[k] = at + b - a
            i = np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1
            sequence = table[i, 3] + rank - table[i, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(table[i, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
