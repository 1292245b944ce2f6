"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Distinct vectors are dealt into bands of norm, a factor of four wide, and within a band by a hash into
shards of bounded size, and each shard gets a graph of its own: greedy searches from its entry point propose neighbours for every vector, and relaxed distance
pruning keeps those that no kept neighbour is closer to, so that edges point in different directions.
Queries go in blocks to every shard, where a beam search walks the graph; the best of all shards are
merged, with exact inner products in double precision.

The largest inner product is a nearest neighbour once a coordinate is added that brings all vectors
to one norm; a query has 0 there. The lift is to the largest norm of a shard, in double precision on
vectors divided by the shard's largest component, so that a few outlying norms blur no other; the
search itself is ordered by the inner products alone. Equal vectors are one node of a graph and are told apart again
after the search.

How wide a beam must be depends on the vectors: clustered ones are found by a narrow beam, ones without
any structure hardly by a wide one. So each shard measures it: its own graph is searched for some of
its vectors, and the answers are held against a comparison with all vectors of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import cut, partitions

#: Edges of a node; width of the beam that builds and the least of the one that searches; relaxation of pruning; queries of a block.
EDGES, BUILD, BEAM, RELAXED, BLOCK = 32, 48, 64, 1.2, 1024
#: Vectors of a shard in the mean: twice as many shards as partitions are made, within these bounds. A shard and its graph travel as one row to each block of queries, which bounds its size (21 MB at the upper one and 64 components).
SHARD, SHARD_MOST = 8192, 1 << 15
#: A shard's beam is doubled until its searches for so many of its own vectors find this share of their k nearest; where even the widest beam doesn't, all its vectors are compared.
PROBES, FOUND, WIDEST = 64, 0.97, 512
#: Cells of the table of the nodes that searches have seen.
SEEN = 1 << 25


def distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own norm, of each query to its rows of x."""
    return norms[rows] - 2 * np.einsum("qkd,qd->qk", x[rows], q, optimize=False)


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes nearest to each query that a beam of `width` meets, their distances, and which have been expanded. All queries advance together, a node a step. graph: -1 where a node has no further edge."""
    n, m = len(x), len(q)
    width = min(width, n)
    ids = np.full((m, width), n, np.int64)
    dist = np.full((m, width), np.inf, x.dtype)
    done = np.zeros((m, width), bool)
    start = np.unique(entry)[:width]
    ids[:, : len(start)] = start
    dist[:, : len(start)] = distances(x, norms, q, np.broadcast_to(start, (m, len(start))))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    seen = np.zeros((m, n + 1), bool)
    seen[:, start] = True
    seen[:, n] = True
    live = np.arange(m)
    while len(live):
        open_ = ~done[live] & (ids[live] < n)
        some = open_.any(axis=1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        slot = open_.argmax(axis=1)
        node = ids[live, slot]
        done[live, slot] = True
        next_ = graph[node]
        next_ = np.where(next_ < 0, n, next_)
        fresh = ~seen[live[:, None], next_]
        seen[live[:, None], next_] = True
        next_ = np.where(fresh, next_, 0)
        d = np.where(fresh, distances(x, norms, q[live], next_), np.inf)
        all_ids = np.concatenate((ids[live], np.where(fresh, next_, n)), axis=1)
        all_dist = np.concatenate((dist[live], d), axis=1)
        all_done = np.concatenate((done[live], np.zeros(next_.shape, bool)), axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_dist, all_done))
    return ids, dist, done


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, cand: np.ndarray, edges: int, relaxed: float) -> np.ndarray:
    """Edges of each point from its candidates (-1: none): the nearest is kept, and candidates go that are nearer to it, by the relaxation, than to the point; then the next."""
    m, k = cand.shape
    order = np.argsort(cand, axis=1, kind="stable")
    cand = np.take_along_axis(cand, order, 1)
    bad = (cand < 0) | (cand == points[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    safe = np.where(bad, 0, cand)
    d = norms[points][:, None] + distances(x, norms, x[points], safe)
    d = np.where(bad, np.inf, np.maximum(d, 0))
    order = np.argsort(d, axis=1, kind="stable")
    safe, d = np.take_along_axis(safe, order, 1), np.take_along_axis(d, order, 1)
    out = np.full((m, edges), -1, np.int64)
    vec = x[safe]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.einsum("mkd,mjd->mkj", vec, vec, optimize=True)
    alive = np.isfinite(d)
    rows = np.arange(m)
    for e in range(edges):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, e] = safe[rows, first][some]
        alive &= ~(relaxed * between[rows, first] <= d) | ~some[:, None]
        alive[rows, first] = False
    return out


def build(x: np.ndarray, edges: int = EDGES, width: int = BUILD, relaxed: float = RELAXED, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Graph and entry points of a shard. Points are inserted in batches that double up to `batch`; reversed edges are added and pruned when a node has too many."""
    n = len(x)
    norms = np.einsum("nd,nd->n", x, x)
    graph = np.full((n, edges), -1, np.int64)
    if n == 1:
        return graph, np.zeros(1, np.int64)
    rng = np.random.default_rng(n)
    order = rng.permutation(n)
    centre = int((norms - 2 * (x @ x.mean(axis=0))).argmin())
    order = np.concatenate(([centre], order[order != centre]))
    entry = np.array([centre])
    at, size = 1, 1
    while at < n:
        points = order[at : at + size]
        ids, _, _ = beam_search(x, norms, graph, entry, x[points], width)
        cand = np.where(ids < n, ids, -1)
        peers = np.broadcast_to(points, (len(points), len(points)))[:, : min(len(points), 32)]
        kept = robust_prune(x, norms, points, np.concatenate((cand, peers), axis=1), edges, relaxed)
        graph[points] = kept
        source, slot = np.nonzero(kept >= 0)
        to, back = kept[source, slot], points[source]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        node = to[first]
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate((first, [len(to)]))))
        most = int(place.max()) + 1 if len(place) else 0
        new = np.full((len(node), most), -1, np.int64)
        new[np.repeat(np.arange(len(node)), np.diff(np.concatenate((first, [len(to)])))), place] = back
        have = graph[node]
        full = (have >= 0).sum(axis=1) + (new >= 0).sum(axis=1) > edges
        both = np.concatenate((have, new), axis=1)
        roomy = ~full
        if roomy.any():
            packed = -np.sort(-both[roomy], axis=1)[:, :edges]
            repeated = np.zeros(packed.shape, bool)
            repeated[:, 1:] = (packed[:, 1:] == packed[:, :-1]) & (packed[:, 1:] >= 0)
            graph[node[roomy]] = np.where(repeated, -1, packed)
        for a in range(0, int(full.sum()), 256):
            rows = np.flatnonzero(full)[a : a + 256]
            graph[node[rows]] = robust_prune(x, norms, node[rows], both[rows], edges, relaxed)
        at += len(points)
        size = min(batch, 2 * size)
    return graph, entry


def usable(vector: Column) -> Column:
    """A vector that isn't null or zero and whose components are all finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def band(vector: Column) -> Column:
    """Vectors of one band have norms within a factor of four; norm one is amid a band. No square overflows or vanishes."""
    top = F.array_max(F.transform(vector, F.abs))
    rest = F.aggregate(F.transform(vector, lambda c: c / top), F.lit(0.0), lambda a, b: a + b * b)
    return F.floor((F.log2(top) + F.log2(rest) / 2) / 2 + 0.5).cast("int")


def lifted(x: np.ndarray) -> np.ndarray:
    """The vectors over their largest component, with a coordinate that brings all to the largest norm among them."""
    x = x / np.abs(x).max()
    norms = (x * x).sum(axis=1)
    return np.concatenate((x, np.sqrt(norms.max() - norms)[:, None]), axis=1)


def searched(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """Nodes with large inner products with each query (n: none), by beam search; all nodes where the beam is as wide as the shard."""
    n = len(x)
    if width >= n:
        return np.broadcast_to(np.arange(n), (len(q), n))
    norms, rows = np.zeros(n), max(1, SEEN // n)
    return np.concatenate([beam_search(x, norms, graph, entry, q[a : a + rows], width)[0] for a in range(0, len(q), rows)])


def enough(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, k: int, width: int, found: float = FOUND) -> int:
    """The beam that finds that share of the k nearest of some of the shard's vectors; the shard's size if none does."""
    n = len(x)
    if n <= width:
        return n
    q = x[np.random.default_rng(n).choice(n, min(n, PROBES), replace=False)]
    score = q @ x.T
    bar = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    while width <= min(n, WIDEST):
        ids = searched(x, graph, entry, q, width)
        hit = np.take_along_axis(score, np.minimum(ids, n - 1), axis=1) >= bar[:, None]
        if (hit & (ids < n)).sum(axis=1).clip(max=k).mean() >= found * k:
            return width
        width *= 2
    return n


GRAPH_DDL = "shard int, n int, edges int, width int, entry binary, graph binary, x binary, vids binary"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int | None = None, beam: int = BEAM) -> DataFrame:
    """The k candidates with the largest inner products for each query: query_id, rank, vec_id, score.

    vectors and queries: vec_id, embedding; a candidate with a query's vec_id is never its answer.
    Ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors that are null, zero, hold
    a null or non-finite component, or whose length isn't the commonest take no part; nor do rows
    without a vec_id. Of rows that repeat a vec_id the smallest vector counts. Further columns aren't used.
    shard: vectors of a shard in the mean, chosen by their number unless given; beam: the least width
    of a beam. Every query is taken to every shard, so the work is queries times shards.
    """
    spark = vectors.sparkSession
    points = clean(vectors)
    asked = clean(queries)
    shape = points.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    answer = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], answer)
    d = shape.d
    # one more than k ids of equal vectors are enough: one may be the query's own
    distinct = cut(equal_vectors(points.where(F.size("v") == d), k + 1).withColumn("band", band(F.col("v"))))
    bands = distinct.groupBy("band").count().orderBy("band").collect()
    if shard is None:
        shard = min(SHARD_MOST, max(SHARD, sum(r["count"] for r in bands) // (2 * partitions(spark))))
    shards, first = 0, {}
    for r in bands:
        first[r.band] = (shards, -(-r["count"] // shard))
        shards += first[r.band][1]
    dealt = F.create_map(*(F.lit(x) for b, (at, _) in first.items() for x in (b, at)))[F.col("band")]
    among = F.create_map(*(F.lit(x) for b, (_, n) in first.items() for x in (b, n)))[F.col("band")]

    def graphs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for r in rows if r.num_rows]
        if not rows:
            return
        held = pa.Table.from_batches(rows)
        key = held.column("shard")[0].as_py()
        vids = held.column("vid").to_numpy()
        order = np.argsort(vids)
        vids = vids[order]
        x = np.array(held.column("v").to_pylist(), np.float64)[order]
        graph, entry = build(lifted(x))
        width = enough(x / np.abs(x).max(), graph, entry, k + 1, max(beam, k + 1))
        row = (key, len(x), graph.shape[1], width, entry.astype("<i8").tobytes(), graph.astype("<i4").tobytes(), x.astype("<f8").tobytes(), vids.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "n", "edges", "width", "entry", "graph", "x", "vids"])

    # a partition is a shard
    built = distinct.select("vid", "v", (dealt + F.pmod(F.xxhash64("v", F.lit(7)), among)).cast("int").alias("shard")).repartitionById(shards, "shard").mapInArrow(graphs, GRAPH_DDL)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            q = np.array(batch.column("v").to_pylist(), "<f8").reshape(-1, d)
            for a in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([ids[a : a + BLOCK].astype("<i8").tobytes()]), pa.array([q[a : a + BLOCK].tobytes()])], ["query_ids", "q"])

    packed = cut(asked.where(F.size("v") == d)).mapInArrow(blocks, "query_ids binary, q binary")
    spread = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["query_ids"], "<i8")
                q = np.frombuffer(row["q"], "<f8").reshape(len(ids), d)
                x = np.frombuffer(row["x"], "<f8").reshape(row["n"], d)
                vids = np.frombuffer(row["vids"], "<i8")
                graph = np.frombuffer(row["graph"], "<i4").reshape(row["n"], row["edges"]).astype(np.int64)
                asked = q / np.abs(q).max(axis=1, keepdims=True)
                if row["width"] >= row["n"]:
                    yield compared(ids, q, x, vids, k + 1)
                    continue
                found = searched(x / np.abs(x).max(), graph, np.frombuffer(row["entry"], "<i8"), asked, row["width"])
                safe = np.where(found < row["n"], found, 0)
                score = np.empty(safe.shape)
                for j in range(0, len(q), 64):
                    score[j : j + 64] = np.einsum("qkd,qd->qk", x[safe[j : j + 64]], q[j : j + 64])
                score = np.where(found < row["n"], score, -np.inf)
                order = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                best, s = np.take_along_axis(safe, order, 1), np.take_along_axis(score, order, 1)
                r, c = np.nonzero(np.take_along_axis(found, order, 1) < row["n"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(vids[best[r, c]]), pa.array(s[r, c])], ["query_id", "vid", "score"])

    proposed = spread.join(built, "shard").mapInArrow(search, "query_id long, vid long, score double")
    near = top(proposed, "query_id", "vid", k + 1)
    told = near.join(distinct.select("vid", "ids"), "vid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return top(told, "query_id", "vec_id", k)


def compared(ids: np.ndarray, q: np.ndarray, x: np.ndarray, vids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best vectors of a shard for each query, by all inner products, a few queries at a time."""
    out = []
    for a in range(0, len(q), max(1, SEEN // len(x))):
        part = slice(a, a + max(1, SEEN // len(x)))
        score = q[part] @ x.T
        # vids ascend, so that of equal scores the smaller id is kept
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        # the product's order of additions may differ from that of the answer
        exact = np.einsum("qkd,qd->qk", x[best], q[part])
        out.append((np.repeat(ids[part], best.shape[1]), vids[best].ravel(), exact.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vid", "score"])


def top(rows: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller item."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(query, F.col("rank").cast("int").alias("rank"), item, "score")


def clean(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    # -0.0 and 0.0 are one component
    rows = rows.where(usable(F.col("v"))).select("vec_id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def equal_vectors(points: DataFrame, k: int) -> DataFrame:
    """vid (the smallest vec_id), v and the k smallest vec_ids of each distinct vector. Every task keeps k ids of a vector before anything is shuffled, and again after."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for v, more in zip(batch.column("v").to_pylist(), ids):
                key = np.array(v, "<f8").tobytes()
                held[key] = sorted({*held.get(key, ()), *more})[:k]
            if len(held) > 100_000:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    def told(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.frombuffer(v, "<f8").tolist() for v in held], pa.list_(pa.float64())), pa.array(list(held.values()), pa.list_(pa.int64()))], ["v", "ids"])

    part = points.select("v", F.array("vec_id").alias("ids")).mapInArrow(least, "v array<double>, ids array<long>")
    whole = part.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))
    return whole.select(F.col("ids")[0].alias("vid"), "v", "ids")
