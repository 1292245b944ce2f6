"""Vectors as codes of the nearest entries of trained codebooks, one for each of their consecutive parts.

Integer components are packed into blocks of columns. A round is an RDD treeAggregate over the blocks:
within a block the distances to all entries of a codebook build up one dimension at a time, np.add.at
puts sums and counts into int64 tensors, and a tree of reductions merges the tensors of all tasks. The
tensors and the codebooks have as many cells as dimensions times entries, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import TOLD, cut, look_up

#: Vectors in a block, so that the distances of a part to 64 entries stay within a core's cache.
ROWS = 2048
#: Integers of a component's 1/256ths.
SCALE = 256
#: Results are longs; an exact number beyond one is given as the largest.
LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, parts: int) -> DataFrame:
    """id, label and vec of the rows that take part: a vec_id, a vector of so many equal parts, no null or non-finite component in it. Infinite and undefined components are those that don't make 0 when multiplied by 0."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double") * 0))
    held = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    cut_so = held.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    return cut_so.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def integers(flat: np.ndarray, small_enough: bool) -> np.ndarray:
    """floor(256 * x). Python's integers where a long may not hold them."""
    if small_enough:
        return np.floor(flat * SCALE).astype(np.int64)
    return np.array([math.floor(x * SCALE) if abs(x) < 1 << 900 else int(x) * SCALE for x in flat.tolist()], dtype=object)


def distances(columns: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, entries x vectors, of a part's columns (dimension x vectors) to a codebook (entries x dimensions)."""
    total = np.zeros((len(entries), columns.shape[1]), columns.dtype)
    for column, centre in zip(columns, entries.T):
        off = column[None, :] - centre[:, None]
        off *= off
        total += off
    return total


def nearest(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each vector's part, the first of equals, and its squared distance."""
    far = distances(columns, entries)
    best = far.argmin(axis=0)
    return best, far[best, np.arange(far.shape[1])]


class Layout:
    """How vectors are cut and which numbers hold their distances and sums without overflow."""

    def __init__(self, dims: int, parts: int, most: int, rows: int):
        self.parts, self.width = parts, dims // parts
        # the largest distance of a part, of a whole vector, and sum of a component
        part, whole, summed = self.width * (2 * most) ** 2, dims * (2 * most) ** 2, most * max(rows, 1)
        self.exact = max(whole, summed) < 1 << 62
        self.held = np.dtype(object) if not self.exact else np.dtype(np.int16 if most < 1 << 15 else np.int64)
        self.work = np.dtype(object) if not self.exact else np.dtype(np.int32 if part < 1 << 31 else np.int64)
        self.total = np.dtype(object) if not self.exact else np.dtype(np.int64)

    def pack(self, columns: np.ndarray) -> bytes:
        if self.exact:
            return columns.astype(self.held).tobytes()
        return b",".join(b"%d" % x for x in columns.ravel().tolist())

    def unpack(self, data: bytes) -> np.ndarray:
        """parts x width x vectors."""
        flat = np.frombuffer(data, self.held) if self.exact else np.array([int(x) for x in data.split(b",")], dtype=object)
        return flat.reshape(self.parts, self.width, -1).astype(self.work)


def blocks(held: DataFrame, layout: Layout) -> DataFrame:
    """Rows of up to ROWS vectors: ids, labels and the integers column by column."""
    label = held.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                flat = some.column("vec").flatten().to_numpy(zero_copy_only=False)
                columns = integers(flat, layout.exact).reshape(some.num_rows, -1).T
                one = [pa.ListArray.from_arrays([0, some.num_rows], some.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*one, pa.array([layout.pack(columns)], pa.binary())], ["ids", "labels", "data"])

    return held.mapInArrow(pack, f"ids array<bigint>, labels array<{label}>, data binary")


def refined(data, books: np.ndarray, layout: Layout, depth: int = 3) -> np.ndarray:
    """The codebooks (parts x entries x width) after a round over the blocks."""
    shape = books.shape
    at_work = books.astype(layout.work)

    def add(tensors, row):
        sums, counts = tensors
        for part, columns in enumerate(layout.unpack(bytes(row[0]))):
            code, _ = nearest(columns, at_work[part])
            np.add.at(counts[part], code, 1)
            for d, column in enumerate(columns):
                np.add.at(sums[part, :, d], code, column.astype(layout.total))
        return tensors

    def merge(a, b):
        a[0][...] += b[0]
        a[1][...] += b[1]
        return a

    zero = np.zeros(shape, layout.total), np.zeros(shape[:2], np.int64)
    sums, counts = data.treeAggregate(zero, add, merge, depth)
    used = counts > 0
    new = books.copy()
    new[used] = sums[used] // counts[used][:, None]
    return new


def coded(rows: DataFrame, books: np.ndarray, layout: Layout) -> DataFrame:
    """vec_id, label, code and error of each vector of the blocks."""
    label = rows.schema["labels"].dataType.elementType.simpleString()
    digits = [f"{e:02x}" for e in range(books.shape[1])]
    at_work = books.astype(layout.work)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some = batch.slice(i, 1)
                found = [nearest(columns, at_work[part]) for part, columns in enumerate(layout.unpack(some.column("data")[0].as_py()))]
                error = sum(e.astype(layout.total) for _, e in found)
                text = ["".join(digits[x] for x in c) for c in np.array([c for c, _ in found]).T.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("ids").flatten(), some.column("labels").flatten(), pa.array(text), pa.array([min(int(e), LONGEST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"]
                )

    return rows.mapInArrow(code, f"vec_id bigint, label {label}, code string, error bigint")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Codes of the vectors of (vec_id, embedding, label), and the codebooks, parts x entries x width.

    Vectors that are null or hold null or non-finite components go, as do rows without a vec_id, empty
    vectors and those whose length can't be cut into `parts` equal parts. Components become
    floor(256 * x). Of what is left, the row first by vec_id, then by vector, sets how long vectors
    are; those of another length fit none of its codebooks and go as well. A part's codebook starts as that part of the first `entries` rows in that order, all of them if they are
    fewer; rows that repeat a vec_id are all rows. Each of the `rounds` replaces an entry by the floors
    of the means of the parts nearest to it (ties: the first entry); one that is nearest to none stays.

    The table has vec_id, label, code (two hexadecimal digits a part, or more where there are over 256
    entries), error (squared distance to what the code stands for) and label_error (errors summed over
    rows of an equal label, nulls together). Distances are exact: where components are so large that
    longs don't hold them, Python's integers do, slowly, and an error beyond a long is given as the
    largest long. An empty table gives an empty one. Further columns aren't used.
    """
    spark = vectors.sparkSession
    held = whole_vectors(vectors, parts)
    ahead = held.orderBy("id", "vec").limit(1).select(F.size("vec")).first()
    dims = ahead[0] if ahead else parts
    held = held.where(F.size("vec") == dims)
    n, most = held.agg(F.count("*"), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    layout = Layout(dims, parts, math.ceil(most or 0) * SCALE + SCALE, n)
    start = [x for r in held.orderBy("id", "vec").limit(entries).collect() for x in r.vec]
    books = integers(np.array(start, np.float64), layout.exact).reshape(-1, parts, dims // parts).transpose(1, 0, 2).astype(layout.total)
    if not n:
        empty = f"vec_id bigint, label {vectors.schema['label'].dataType.simpleString()}, code string, error bigint, label_error bigint"
        return spark.createDataFrame([], empty), books
    packed = cut(blocks(held, layout))
    data = packed.select("data").rdd
    for _ in range(rounds):
        books = refined(data, books, layout)
    codes = cut(coded(packed, books, layout))
    # a label as a key that is never null
    key = F.struct(F.col("label").isNull().alias("none"), F.col("label"))
    keyed = codes.withColumn("key", F.xxhash64(key))
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("all"), F.count("*").alias("n_rows"))
    sums = cut(sums.select(F.xxhash64(key).alias("key"), F.col("label").alias("of"), F.least("all", F.lit(LONGEST)).cast("long").alias("label_error"), "n_rows"))
    joined = keyed.join(F.broadcast(sums.drop("n_rows")), "key") if sums.count() <= TOLD else look_up(keyed, sums, "key", n)
    return joined.where(F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error"), books


def codes_with_digest(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """compress(), with the SHA-256 of all final entries' integers, by part, entry and position, joined by commas."""
    codes, books = compress(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    return codes.withColumn("codebooks_sha256", F.lit(digest))
