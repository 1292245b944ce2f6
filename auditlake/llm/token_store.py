"""Token ids in a content-addressed store.

Rolling hashes over the ids cut each document's stream where its content says so, so that shared
passages give shared chunks. A chunk is stored once under its digest; a document is a recipe, the
list of its chunks, with the root of a Merkle tree over their digests. Recipes are written in order of
doc_id, with the number of ids before each. The manifest holds a Merkle tree over them: the leaves
are recipes with their doc_id, start and length, in order; blocks of them have a root, a file has the
root over its blocks, and the store has one over its files. The reader recomputes all of these from
the recipes that it finds, and the digests of the chunks and the roots of the recipes from what they
hold, so that a lost, swapped, repeated or altered recipe, chunk or manifest fails the read.

Layout of a store: objects/kind=chunk (digest, ids), objects/kind=recipe (as encoded), recipes/
(ordered, with starts), manifest/ (file, recipes, ids, root; file -1 is the whole store).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import batched, cut, ensure_checkpoint_dir, partitions, tagged_texts
from auditlake.llm.segments import doc_place, mix
from auditlake.llm.tokens import encoder

#: Ids of the least and of the longest chunk, the expected distance between cuts past the least, and the ids that a rolling hash sees.
LEAST, MOST, EVERY, SEEN = 64, 4096, 512, 8
DIGEST = 16
OBJECT = pa.schema([("pid", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_tokens", pa.int64()), ("digest", pa.binary()), ("data", pa.binary())])
OBJECT_DDL = "pid int, kind string, doc_id long, tag long, n_tokens long, digest binary, data binary"
#: Bytes of ids that are looked through at once.
TOGETHER = 2 << 20
#: Digests that a task remembers to send a chunk once.
REMEMBERED = 200_000
#: Recipes of a block of the manifest's tree, and the file number of the root over all files.
LEAVES, WHOLE = 1024, -1


def digest_of(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves; an odd one at the end of a level moves up alone."""
    level = [digest_of(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [digest_of(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else digest_of(b"")


def allowed_cuts(ids: np.ndarray) -> np.ndarray:
    """Places behind an id where the hash of the last few allows a cut. Streams may stand on end: a cut is never within the least length of a start, so what a hash sees of the stream before doesn't count."""
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    rolled = np.zeros(len(ids), np.uint64)
    for i in range(min(SEEN, len(ids))):
        rolled[i:] += h[: len(ids) - i] * np.uint64(2 * i + 1)
    return np.flatnonzero(mix(rolled) % np.uint64(EVERY) == 0) + 1


def cuts(start: int, stop: int, allowed: list[int]) -> list[int]:
    """Ends of the chunks of the stream from start to stop: allowed places (all inside it), within the least and the longest length."""
    ends = []
    for end in [*allowed, stop]:
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end == stop or end - start >= LEAST:
            if end > start:
                ends.append(end)
            start = end
    return ends


def pack_ids(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four, after a byte that says which."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def crc_joined(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of byte strings on end, from their own crc32 and sizes."""
    total = 0
    for crc, size in zip(crcs, sizes):
        total = _shifted(total, size) ^ crc
    return total


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _matrices() -> list[list[int]]:
    """What 1, 2, 4 ... zero bytes do to a crc."""
    bit = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        bit = [_times(bit, x) for x in bit]
    out = [bit]
    while len(out) < 48:
        out.append([_times(out[-1], x) for x in out[-1]])
    return out


_ZEROS = _matrices()


def _shifted(crc: int, size: int) -> int:
    i = 0
    while size:
        if size & 1:
            crc = _times(_ZEROS[i], crc)
        size >>= 1
        i += 1
    return crc


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Encode all texts (null: empty) and write the store to a folder that all executors reach. Rows without a doc_id take no part; rows that repeat one are all stored, in the order of their texts' tags."""
    spark = docs.sparkSession
    n = partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen = encoder(tokenizer).ids, set()
        close = np.array([end_id], "<u4").tobytes()

        def chunked(rows: list[tuple], streams: list[bytes]) -> Iterator[tuple]:
            raw = b"".join(streams)
            ids = np.frombuffer(raw, "<u4")
            bounds = np.cumsum([0, *(len(x) // 4 for x in streams)])
            allowed = allowed_cuts(ids)
            inside = np.searchsorted(allowed, bounds, side="right").tolist()
            allowed, bounds = allowed.tolist(), bounds.tolist()
            narrow = pack_ids(ids) if ids.max() < 1 << 16 else None
            for k, (pid, doc, tag) in enumerate(rows):
                recipe, start = [], bounds[k]
                for end in cuts(start, bounds[k + 1], allowed[inside[k] : inside[k + 1]]):
                    data = pack_ids(ids[start:end]) if narrow is None else narrow[:1] + narrow[1 + 2 * start : 1 + 2 * end]
                    digest = digest_of(data)
                    recipe.append(digest)
                    start = end
                    if digest not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                        yield int.from_bytes(digest[:4], "little") % n, "chunk", None, None, None, digest, data
                yield pid, "recipe", doc, tag, bounds[k + 1] - bounds[k], merkle(recipe), b"".join(recipe)

        def out() -> Iterator[tuple]:
            rows, streams, size = [], [], 0
            for batch in batches:
                place = doc_place(batch.column("doc_id").to_numpy() ^ batch.column("tag").to_numpy(), n).tolist()
                for pid, doc, tag, text in zip(place, batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")):
                    rows.append((pid, doc, tag))
                    streams.append(ids_of(text.as_py()) + close)
                    size += len(streams[-1])
                    if size >= TOGETHER:
                        yield from chunked(rows, streams)
                        rows, streams, size = [], [], 0
            if rows:
                yield from chunked(rows, streams)

        yield from batched(out(), OBJECT)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = None
        for batch in batches:
            if not batch.num_rows:
                continue
            digest = batch.column("digest")
            new = pc.not_equal(digest, pa.concat_arrays([pa.array([was], pa.binary()), digest.slice(0, len(digest) - 1)]))
            yield batch.filter(pc.or_(pc.equal(batch.column("kind"), "recipe"), pc.fill_null(new, True)))
            # chunks come before recipes
            was = digest[-1].as_py()

    objects = tagged_texts(docs).select("doc_id", "tag", "text").mapInArrow(encode, OBJECT_DDL)
    objects = objects.repartitionById(n, "pid").sortWithinPartitions("kind", "digest").mapInArrow(once, OBJECT_DDL).drop("pid")
    objects.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")

    recipes = spark.read.schema(OBJECT_DDL).parquet(f"{path}/objects").where("kind = 'recipe'").select("doc_id", "tag", "n_tokens", F.col("digest").alias("root"), F.col("data").alias("chunks"))
    ordered = cut(recipes.repartitionByRange(n, "doc_id", "tag").sortWithinPartitions("doc_id", "tag").withColumn("file", F.spark_partition_id()))
    # one row for each file comes to the driver
    totals = sorted((r.file, r.n) for r in ordered.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = {}, 0
    for file, ids in totals:
        before[file] = at
        at += ids

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = None, 0
        for batch in batches:
            size = batch.column("n_tokens").to_numpy()
            if not len(size):
                continue
            at = before[batch.column("file")[0].as_py()] if at is None else at
            ends = at + np.cumsum(size)
            yield batch.append_column("start", pa.array(ends - size, pa.int64())).append_column("place", pa.array(np.arange(place, place + len(size)), pa.int64()))
            at, place = int(ends[-1]), place + len(size)

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The root of a file, which a task holds whole and in order."""
        file, recipes, ids, leaves, blocks = 0, 0, 0, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "tag", "start", "n_tokens", "root")]
            for row in zip(*columns):
                leaves.append(leaf(*row))
                if len(leaves) == LEAVES:
                    blocks.append(merkle(leaves))
                    leaves = []
            if batch.num_rows:
                file, recipes, ids = batch.column("file")[0].as_py(), recipes + batch.num_rows, ids + sum(columns[3])
        if recipes:
            row = (file, recipes, ids, merkle(blocks + ([merkle(leaves)] if leaves else [])))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["file", "recipes", "ids", "root"])

    ordered.mapInArrow(number, RECIPE_DDL).write.parquet(f"{path}/recipes")
    files = sorted(tuple(r) for r in ordered.mapInArrow(lambda batches: tree(number(batches)), MANIFEST_DDL).collect())
    spark.createDataFrame([*files, whole_root(files)], MANIFEST_DDL).coalesce(1).write.parquet(f"{path}/manifest")


RECIPE_DDL = "doc_id long, tag long, n_tokens long, root binary, chunks binary, file int, start long, place long"
MANIFEST_DDL = "file int, recipes long, ids long, root binary"


def leaf(doc_id: int, tag: int, start: int, n_tokens: int, root: bytes) -> bytes:
    return digest_of(np.array([doc_id, tag, start, n_tokens], "<i8").tobytes() + root)


def roots(recipes: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """File, recipes, ids and root of each file of recipes, ordered. A task reads one block of leaves at a time; a row for each file, of which there are as many as partitions, comes to the driver."""

    def block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = batch.column("leaves").to_pylist()
            whole = [[x["place"] for x in block] == list(range(b * LEAVES, b * LEAVES + len(block))) for b, block in zip(batch.column("block").to_pylist(), leaves)]
            root = [merkle([leaf(x["doc_id"], x["tag"], x["start"], x["n_tokens"], x["root"]) for x in block]) if ok else None for block, ok in zip(leaves, whole)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array([len(x) for x in leaves], pa.int64()), pa.array([sum(x["n_tokens"] for x in block) for block in leaves], pa.int64()), pa.array(root, pa.binary())], ["file", "block", "recipes", "ids", "root"])

    def file_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks").to_pylist()
            # a block that isn't whole, or is missing, leaves the file without a root
            root = [merkle([x["root"] for x in part]) if all(x["root"] and x["block"] == i for i, x in enumerate(part)) and all(x["recipes"] == LEAVES for x in part[:-1]) else None for part in blocks]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([sum(x["recipes"] for x in part) for part in blocks], pa.int64()), pa.array([sum(x["ids"] for x in part) for part in blocks], pa.int64()), pa.array(root, pa.binary())], ["file", "recipes", "ids", "root"])

    together = lambda key, *fields: F.sort_array(F.collect_list(F.struct(key, *fields)))
    block = recipes.groupBy("file", F.floor(F.col("place") / LEAVES).cast("long").alias("block")).agg(together("place", "doc_id", "tag", "start", "n_tokens", "root").alias("leaves"))
    blocks = block.mapInArrow(block_roots, "file int, block long, recipes long, ids long, root binary")
    file = blocks.groupBy("file").agg(together("block", "recipes", "ids", "root").alias("blocks"))
    return sorted(tuple(r) for r in file.mapInArrow(file_roots, MANIFEST_DDL).collect())


def whole_root(files: list[tuple[int, int, int, bytes]]) -> tuple[int, int, int, bytes]:
    held = [digest_of(np.array([file, recipes, ids], "<i8").tobytes() + (root or b"")) for file, recipes, ids, root in files]
    return WHOLE, sum(f[1] for f in files), sum(f[2] for f in files), merkle(held)


def verify(spark: SparkSession, path: str) -> None:
    """Compare the manifest with the tree over the recipes that are there; a difference is an error."""
    stated = sorted(tuple(r) for r in spark.read.schema(MANIFEST_DDL).parquet(f"{path}/manifest").collect())
    files = roots(spark.read.schema(RECIPE_DDL).parquet(f"{path}/recipes"))
    found = sorted([*files, whole_root(files)])
    if any(root is None for *_, root in files) or [(*x[:3], bytes(x[3])) for x in stated] != [(*x[:3], bytes(x[3])) for x in found]:
        raise ValueError("the recipes don't match the manifest")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files. The manifest's tree is verified first, and every chunk's digest and every recipe's root as they are read; what is missing or doesn't match is an error."""
    verify(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("data").to_pylist()):
                if digest_of(data) != digest:
                    raise ValueError(f"chunk {digest.hex()} doesn't match its digest")
                ids = unpack_ids(data).tobytes()
                crcs.append(zlib.crc32(ids))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["digest", "crc", "size"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for root, n, parts in zip(*(batch.column(c).to_pylist() for c in ("root", "n_tokens", "parts"))):
                if merkle([p["digest"] for p in parts]) != root or sum(p["size"] or 0 for p in parts) != 4 * n:
                    raise ValueError("a recipe doesn't match its root or length")
                crc.append(crc_joined([p["crc"] for p in parts], [p["size"] for p in parts]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = spark.read.schema(OBJECT_DDL).parquet(f"{path}/objects").where("kind = 'chunk'").select("digest", "data").mapInArrow(read, "digest binary, crc long, size long")
    recipes = spark.read.parquet(f"{path}/recipes")
    n = F.expr(f"cast(length(chunks) / {DIGEST} as int)")
    parts = recipes.select("doc_id", "tag", "start", "n_tokens", "root", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("chunks"), i * DIGEST + 1, F.lit(DIGEST)))).alias("i", "digest"))
    whole = parts.join(chunks, "digest", "left").groupBy("doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("i", "digest", "crc", "size"))).alias("parts"))
    return whole.mapInArrow(join_up, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of each document, put together from the chunks, once the manifest's tree is verified."""
    verify(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    n = F.expr(f"cast(length(chunks) / {DIGEST} as int)")
    parts = recipes.select("doc_id", "start", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("chunks"), i * DIGEST + 1, F.lit(DIGEST)))).alias("i", "digest"))
    chunks = spark.read.schema(OBJECT_DDL).parquet(f"{path}/objects").where("kind = 'chunk'").select("digest", "data")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack_ids(p["data"]) for p in parts]).astype(np.int64).tolist() for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    whole = parts.join(chunks, "digest").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("i", "data"))).alias("parts"))
    return whole.mapInArrow(build, "doc_id long, start long, ids array<long>")


def stored_ids(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the store (without a path: under the shared checkpoint folder) and read it back."""
    path = path or f"{ensure_checkpoint_dir(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"
    write_store(docs, tokenizer, path)
    return read_digests(docs.sparkSession, path)
