"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, each set if it is set in over half of the hashes of the text's word
shingles. Fingerprints link where at most three bits differ. They are cut into two halves; of a
linked pair one half differs in at most one bit, so that the ball of radius one around each half (33
values) holds the partner's. Every distinct fingerprint is laid into the table of each half and
looks up the ball around its own; what meets there is verified on all 64 bits.

All rows of one table entry come to one task in order. What links there is joined in blocks of
distances between distinct fingerprints, and only a spanning forest of it is given on, never the
pairs. Connected components come from alternating rounds over the links of the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import batched, cut, few_tasks, look_up, partitions, texts

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int) -> int:
    """Bit by bit majority over XXH64 of the shingles of ASCII-lower-cased words; 0 without a word."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    view = memoryview(line)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        ones += bits(np.array([digest(view[s:e], SEED) for s, e in zip(at[a:b], (x - 1 for x in at[a + shingle : b + shingle]))], "<u8"))
    return majority(ones, n)


def bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def spanning(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins linked places in parent, where each has the root of its tree, the smallest of it, and gives those of the links that span what is joined."""
    kept = [np.zeros((2, 0), np.int64)]
    while len(a):
        ra, rb = parent[a], parent[b]
        split = ra != rb
        a, b, low, high = a[split], b[split], np.minimum(ra, rb)[split], np.maximum(ra, rb)[split]
        # a tree is hung by one link to the smallest root it meets
        order = np.lexsort((low, high))
        one = order[np.unique(high[order], return_index=True)[1]]
        kept.append(np.stack([np.minimum(a[one], b[one]), np.maximum(a[one], b[one])]))
        parent[high[one]] = low[one]
        while ((up := parent[parent]) != parent).any():
            parent[:] = up
    return tuple(np.concatenate(kept, axis=1))


#: Distances computed at once.
AREA = 1 << 20


def table_entry(fp: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what an entry joins, each of at most so many bits. own: the fingerprints laid into the table here; the others look it up. Pairs are ordered (smaller, larger) as places of fp."""
    laid = np.flatnonzero(own)
    if not len(laid) or len(fp) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parent, found = np.arange(len(fp)), []
    rows = max(1, AREA // len(laid))
    for at in range(0, len(fp), rows):
        near = np.bitwise_count(fp[at : at + rows, None] ^ fp[None, laid]) <= most
        a, b = np.nonzero(near)
        found.append(spanning(a + at, laid[b], parent))
    return tuple(np.concatenate([x[i] for x in found]) for i in (0, 1))


def links(distinct: DataFrame, most: int, n: int) -> DataFrame:
    """Spanning links (a, b) between the ids of distinct fingerprints. distinct: id, fp."""
    if most != 3 and not 0 <= most < 4:
        raise ValueError("two halves and balls of radius one serve at most 3 bits")
    half = F.shiftrightunsigned(F.col("fp"), 32)
    other = F.col("fp").bitwiseAND(0xFFFFFFFF)
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    tables = F.array(F.struct(F.lit(0).alias("side"), half.alias("value")), F.struct(F.lit(1).alias("side"), other.alias("value")))
    laid = distinct.select("id", "fp", F.explode(tables).alias("t")).select("id", "fp", "t.side", "t.value")
    looked = laid.select("id", "fp", "side", "value", F.explode(flips).alias("flip")).select("id", "fp", "side", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("own"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def close() -> pa.RecordBatch | None:
            if not held:
                return None
            ids, fp, own = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            a, b = table_entry(fp.view(np.uint64), own.astype(bool), most)
            if not len(a):
                return None
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        for batch in batches:
            side, value, ids, fp = (batch.column(c).to_numpy() for c in ("side", "value", "id", "fp"))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            edge = np.flatnonzero(np.concatenate(([True], (side[1:] != side[:-1]) | (value[1:] != value[:-1]), [True])))
            # entries that nobody shares, or that hold nothing laid, are passed over without work
            size = np.diff(edge)
            laid_in = np.add.reduceat(own.astype(np.int64), edge[:-1])
            last = len(size) - 1
            for i in np.flatnonzero(((size > 1) & (laid_in > 0)) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == last)).tolist():
                a, b = edge[i], edge[i + 1]
                now = (int(side[a]), int(value[a]))
                if now != key:
                    if (made := close()) is not None:
                        yield made
                    key = now
                held.append((ids[a:b], fp[a:b], own[a:b]))
        if (made := close()) is not None:
            yield made

    dealt = looked.repartition(n, "side", "value").sortWithinPartitions("side", "value")
    return dealt.mapInArrow(meet, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) for the nodes of edges (a, b). Each round gives every node and its neighbours the smallest id known among them, first towards larger and then towards smaller ones, so that paths shorten by a constant factor a round and no node keeps a long list. Few links are worked on by few tasks."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    size = None
    # a round has no more links than the one before it, and the nodes
    rows = 2 * now.count()
    few = lambda df: few_tasks(df, rows)
    now = few(now)
    for _ in range(most_rounds):
        # every larger neighbour of a node, and the node, to the smallest of the neighbourhood
        both = few(now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u"))))
        least = few(both.groupBy("v").agg(F.min("u").alias("m"))).withColumn("m", F.least("m", "v"))
        large = few(few(both.where("u > v").join(least, "v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct())
        # every smaller neighbour, and the node, to the smallest
        least = few(large.groupBy("v").agg(F.min("u").alias("m")))
        small = few(few(large.join(least, "v")).select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("u <> v").distinct())
        now = few(cut(small))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if size == (state.n, state.h) or state.n == 0:
            break
        size = (state.n, state.h)
    else:
        raise RuntimeError("components didn't settle")
    stars = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of each document.

    Null, empty and blank texts have fingerprint zero, which links like any other. Equal fingerprints
    are one node, whatever the number of their documents. Rows without a doc_id take no part; rows
    that repeat one are all returned. Further columns aren't used. An empty table gives none. A path of
    links that doesn't settle in 60 rounds, which shorten it by a constant factor each, raises an
    error; nothing is left out.
    """
    n = partitions(docs.sparkSession)
    marked = cut(fingerprints(docs, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_rows")))
    joined = components(links(distinct.select("id", "fp"), most, n))
    named = distinct.join(joined, distinct.id == joined.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n_rows")
    # fingerprint 0, of all texts without a word, may be that of a third of the rows
    return look_up(marked, named, "fp", marked.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
