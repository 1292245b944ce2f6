"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with a budget of errors that is proportional to its length. Cut
into one piece more than the budget, an item that occurs within it has at least one piece that occurs
exactly. All pieces are found in one pass over a text by an automaton; around each hit the item is
verified by Myers' bit-parallel edit distance, with free ends in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import batched, texts

#: ASCII letters are lower-cased, ASCII characters that are neither letters nor digits separate words, other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32())])
HIT_DDL = "doc_id long, item_id long, distance int, budget int"
#: UTF-8 bytes of test items that one pass holds; more items are taken in further passes.
PASS_BYTES = 16 << 20


def fold(text: str) -> str:
    """Words joined by single spaces, a character for each UTF-8 byte."""
    return b" ".join(text.encode().translate(FOLD).split()).decode("latin-1")


def myers(pattern: str, text: str, budget: int) -> int:
    """Least edit distance of the pattern to any substring of the text, or budget + 1 if that is over the budget."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score, best = mask, 0, m, m
    for c in text:
        eq = places.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & mask
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best = score
            if not best:
                return 0
        ph <<= 1
        mh <<= 1
        up = (mh | ~(xv | ph)) & mask
        down = ph & xv & mask
    return min(best, budget + 1)


def budget(item: str, errors_per: int) -> int:
    """Errors allowed to an item; the spaces around a short one don't count."""
    return len(item.strip(" ")) // errors_per


def cut_item(item: str, errors_per: int) -> list[tuple[int, str]]:
    """Budget plus one pieces, with their places in the item."""
    pieces = budget(item, errors_per) + 1
    edge = [len(item) * i // pieces for i in range(pieces + 1)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:])]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], errors_per: int):
        import ahocorasick

        self.items = [(i, t, budget(t, errors_per)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, _) in enumerate(self.items):
            for at, piece in cut_item(text, errors_per):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, least distance, budget) of the items that occur. Spaces around the text stand for word ends."""
        best: dict[int, int] = {}
        looked: set[tuple[int, int]] = set()
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                _, item, budget = self.items[k]
                if best.get(k) == 0:
                    continue
                start = end - size + 1 - at
                near = (k, start // (budget + 1))
                if near in looked:
                    continue
                looked.add(near)
                # all starts of this stretch are covered at once
                low, top = near[1] * (budget + 1) - budget, (near[1] + 1) * (budget + 1) + len(item) + budget
                window = text[max(0, low) : top]
                distance = 0 if item in window else myers(item, window, budget)
                if distance <= budget:
                    best[k] = min(distance, best.get(k, distance))
        return [(self.items[k][0], d, self.items[k][2]) for k, d in sorted(best.items())]


def contamination(docs: DataFrame, benchmark: DataFrame, errors_per: int = 16) -> DataFrame:
    """Pairs of a document and a test item that occurs in it with at most one error for each `errors_per` bytes: doc_id, item_id, distance, budget.

    Both are folded first: ASCII case, punctuation and white space don't count. Items without a
    letter or digit, null ones and those without an item_id match nothing; items of under
    `errors_per` bytes must occur exactly, as whole words. Null and empty texts match nothing. Rows
    without a doc_id take no part. Repeated rows give their pairs once. Further columns aren't used.
    """
    rows = texts(docs).select("doc_id", "text")
    pairs = rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"), F.lit(0).alias("budget")).where("false")
    for held in item_passes(benchmark, errors_per):
        pairs = pairs.unionByName(one_pass(rows, held, errors_per))
    return pairs.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("budget").alias("budget"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, errors_per: int = 16) -> DataFrame:
    """docs, all columns as they are, without the rows in which a test item occurs; rows without a doc_id are judged as well."""
    for held in item_passes(benchmark, errors_per):

        def clean(batches: Iterator[pa.RecordBatch], held: list[tuple[int, str]] = held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held, errors_per)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(f" {fold(t.as_py() or '')} ") for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def item_passes(benchmark: DataFrame, errors_per: int) -> Iterator[list[tuple[int, str]]]:
    """The folded test items, in passes of bounded size: the benchmark is measured first, and each pass brings only its part to the driver."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) if passes > 1 else items
        # items of under errors_per bytes carry the spaces around them
        held = [(r.item_id, f" {t} " if len(t) < errors_per else t) for r in part.collect() if (t := fold(r.text))]
        if held:
            yield held


def one_pass(rows: DataFrame, held: list[tuple[int, str]], errors_per: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held, errors_per)

        def out() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                    for hit in matcher.matches(f" {fold(text.as_py())} "):
                        yield doc.as_py(), *hit

        yield from batched(out(), HIT)

    return rows.mapInArrow(run, HIT_DDL)
