"""Fingerprints by a scaled threshold: all shingle hashes of a text that fall under a fixed fraction.

Every text keeps the same part of the space of hashes, so that sketches of a word and of a book are
compared within that part, unions of texts have the unions of their sketches, and how much of a text
another holds is estimated whatever their lengths. Shingles are runs of 32 bytes, one at each place; a
text with few hashes under the fraction keeps its smallest ones besides, up to a least number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import cut, partitions, small, texts

#: Bytes of a shingle.
SHINGLE = 32
#: Odd factors of a shingle's four words, and of the mixing of their sum.
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
MIXING = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Keys that are looked at for each stretch of the order of documents.
LOOKED = 16


@dataclass(frozen=True)
class Scale:
    """One hash in `scaled` is kept, and of a text with fewer the `least` smallest."""

    scaled: int = 64
    least: int = 32

    @property
    def top(self) -> int:
        """Kept are hashes up to this one."""
        return (1 << 64) // self.scaled - 1

    def sketch(self, data: bytes) -> np.ndarray:
        """The kept hashes of a text, ascending and distinct. No text but the empty one has none."""
        h = hashes(data)
        kept = np.unique(h[h <= np.uint64(self.top)])
        return kept if len(kept) >= self.least else np.unique(h)[: self.least]

    def reach(self, kept: np.ndarray) -> int:
        """The hash up to which the sketch holds all of its text."""
        if len(kept) < self.least:
            return (1 << 64) - 1
        return max(self.top, int(kept[-1]))

    def compared(self, a: np.ndarray, b: np.ndarray) -> tuple[float, float | None]:
        """Estimates of the Jaccard similarity of two texts' shingles, and of the part of a's that b has, of all hashes that both sketches reach. The latter is None where none of a's is among these; two empty texts are alike."""
        if a.tobytes() == b.tobytes():
            return 1.0, 1.0
        reach = np.uint64(min(self.reach(a), self.reach(b)))
        a, b = a[a <= reach], b[b <= reach]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both), both / len(a) if len(a) else None


def hashes(data: bytes) -> np.ndarray:
    """64 bits for each shingle of a text; a shorter text is one shingle."""
    n = len(data) - SHINGLE + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(data)] if data else [], np.uint64)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()
    h = words[:n] * FACTORS[0]
    for i in (1, 2, 3):
        h += words[8 * i : 8 * i + n] * FACTORS[i]
    for shift, factor in zip((30, 27), MIXING):
        h ^= h >> np.uint64(shift)
        h *= factor
    return h ^ (h >> np.uint64(31))


def shown(kept: np.ndarray) -> str:
    """16 hexadecimal digits for each hash."""
    return kept.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text, its last half replaced by as many characters of the following one, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def sketches(docs: DataFrame, scale: Scale = Scale(), *more: str | Column) -> DataFrame:
    """doc_id, the columns named in more, and kept, the hashes of each text as signed longs. A null text is an empty one, which keeps none; rows without a doc_id take no part, repeated rows are all returned. An empty table gives none."""
    held = texts(docs, *more)
    named = [c for c in held.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [scale.sketch(t.as_py().encode()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in named), pa.array(kept, pa.list_(pa.int64()))], [*named, "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "text")
    return held.mapInArrow(run, f"{schema}, kept array<bigint>")


def unsigned_top(hash: Column, top: int) -> Column:
    """Whether a hash kept as a signed long is at most top (under half of all)."""
    return hash.between(0, top)


def merged(kept: DataFrame, by: str, scale: Scale = Scale()) -> DataFrame:
    """Rows by, hash: the sketch of the union of each group's texts. Rows rather than an array, as a group's sketch grows with it; groups with fewer than scale.least hashes under the threshold keep the smallest of all that their texts kept, which are few."""
    each = kept.select(by, F.explode("kept").alias("hash")).distinct()
    under = unsigned_top(F.col("hash"), scale.top)
    few = each.groupBy(by).agg(F.count_if(under).alias("n_under"), F.count("*").alias("n_rows"))
    scarce = each.join(few.where((F.col("n_under") < scale.least) & (F.col("n_rows") > F.col("n_under"))).select(F.col(by).alias("scarce")), F.col(by).eqNullSafe(F.col("scarce")), "left_semi")
    # as unsigned numbers: those with the sign bit come last
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("hash") < 0, "hash"))
    rest = scarce.withColumn("place", place).where((F.col("place") <= scale.least) & ~under).select(by, "hash")
    return each.where(under).unionByName(rest)


def held_by(kept: DataFrame, whole: DataFrame, by: str, scale: Scale = Scale()) -> DataFrame:
    """doc_id, by, n_under and part: how much of each text's hashes under the threshold the merged sketch of the group named in its column `by` holds (null where it has none). whole: rows by, hash, of merged()."""
    row = kept.withColumn("row", F.monotonically_increasing_id())
    row = cut(row.withColumn("under", F.filter("kept", lambda h: unsigned_top(h, scale.top))).select("row", "doc_id", by, "under"))
    asked = row.select("row", by, F.explode("under").alias("hash"))
    found = asked.join(whole.select(F.col(by).alias("of"), "hash"), (F.col(by).eqNullSafe(F.col("of"))) & (asked["hash"] == whole["hash"]), "left_semi")
    found = found.groupBy("row").agg(F.count("*").alias("n"))
    n_under = F.size("under").cast("long")
    part = F.when(n_under > 0, F.coalesce("n", F.lit(0)) / n_under)
    return row.join(found, "row", "left").select("doc_id", by, n_under.alias("n_under"), part.alias("part"))


def stretches(rows: DataFrame, most: int) -> tuple[Column, int]:
    """Which of up to `most` stretches of the order by (doc_id, tag) a row is in, and how many there are. Their borders are taken from about LOOKED keys a stretch, chosen by hash."""
    keys = rows.select("doc_id", "tag")
    total = keys.count()
    some = keys.where(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(max(1, total // (LOOKED * most)))) == 0) if total > LOOKED * most else keys
    found = sorted({(r.doc_id, r.tag) for r in some.collect()})
    step = max(1, -(-len(found) // most))
    borders = found[step::step]
    ids, tags = F.lit([b[0] for b in borders] or [0]), F.lit([b[1] for b in borders] or [0])
    if not borders:
        return F.lit(0), 1

    def onward(at: Column, step: Column) -> Column:
        doc, tag = F.get(ids, at + step - 1), F.get(tags, at + step - 1)
        return F.when((doc < F.col("doc_id")) | ((doc == F.col("doc_id")) & (tag <= F.col("tag"))), at + step).otherwise(at)

    steps = [1 << b for b in reversed(range(len(borders).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), onward), len(borders) + 1


def fingerprints(docs: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the beginning of the next one.

    doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (kept hashes as 16
    hexadecimal digits each, ascending), near_edited and near_next (estimated Jaccard similarities of
    the text to its edited one and to the next one), within_edited and within_next (estimated parts of
    the text's shingles that those hold; null where sketches have no hash of it to compare).

    The next text is that of the next row by doc_id, then by a hash of the text where a doc_id is
    repeated; after the last comes the first, so a single text is its own next one. Null texts are
    empty; an empty text has an empty fingerprint and is alike to another empty text alone. Rows
    without a doc_id take no part; repeated rows follow each other and are all returned. Further
    columns aren't used. An empty table gives none.

    Texts are exchanged once: into stretches of the order, each with the first text of the next one.
    """
    spark = docs.sparkSession
    repeated = not texts(docs).groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        rows = texts(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
        rows = rows.groupBy("doc_id", F.col("hash").alias("tag")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    else:
        rows = texts(docs, F.lit(0).cast("long").alias("tag"), F.lit(1).cast("long").alias("copies"))
    n = partitions(spark)
    at, many = stretches(rows, n)
    rows = rows.withColumn("at", at)
    heads = sorted((r.at, r.head.doc_id, r.head.tag) for r in rows.groupBy("at").agg(F.min(F.struct("doc_id", "tag")).alias("head")).collect())
    follows = spark.createDataFrame([(d, t, heads[i - 1][0]) for i, (_, d, t) in enumerate(heads)], "doc_id long, tag long, before int")
    marked = rows.join(small(follows), ["doc_id", "tag"], "left")
    own, other = F.struct("at", F.lit(False).alias("after")), F.struct(F.col("before").alias("at"), F.lit(True).alias("after"))
    placed = marked.select("doc_id", "tag", "text", "copies", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("in"))
    placed = placed.select("in.*", "doc_id", "tag", "text", "copies").repartitionById(many, F.col("at")).sortWithinPartitions("at", "after", "doc_id", "tag")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "within_edited", "within_next", "times"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.int64()]

    def result(doc_id: int, text: str, kept: np.ndarray, following: str, following_kept: np.ndarray, times: int) -> tuple:
        new = edited(text, following).encode()
        new_kept = scale.sketch(new)
        (near, within), (near_next, within_next) = scale.compared(kept, new_kept), scale.compared(kept, following_kept)
        return doc_id, len(text), hashlib.sha256(new).hexdigest(), shown(kept), shown(new_kept), near, near_next, within, within_next, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        out: list[tuple] = []

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for batch in batches:
            for stretch, after, doc_id, text, copies in zip(*(batch.column(c).to_pylist() for c in ("at", "after", "doc_id", "text", "copies"))):
                if after and (last is None or last[0] != stretch):
                    continue  # further rows of the text that closed the stretch
                kept = scale.sketch(text.encode())
                if last is not None and last[0] == stretch:
                    out.append(result(*last[1:4], text, kept, 1))
                last = None if after else (stretch, doc_id, text, kept)
                if copies > 1 and not after:
                    out.append(result(doc_id, text, kept, text, kept, copies - 1))
                if len(out) >= 1000:
                    yield given()
        if out:
            yield given()

    found = placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, within_edited double, within_next double, times long")
    if repeated:
        found = found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.drop("times")
