"""Alignment of two tokenizers' tokens over the same bytes.

The tokens of B, in order, are a static index of intervals; each token of A is a query that a bisection
answers with the list of B tokens it overlaps. Where the lists of two neighbours have no token in
common, no token of either side spans the gap between them: it is the border of a group. Tokens of A
and B that share a group are linked, and links are counted over the corpus by documents.

A text is aligned in runs of one or more spaces or line ends and what follows them, where neither
tokenizer merges over their beginning; so a run has the same tokens wherever it stands, and a worker
aligns the runs it has not met lately, all at once. Other texts are aligned whole, in the same way.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import TOLD, cut, ensure_checkpoint_dir, look_up, texts

#: Runs that a worker remembers, and once more those of before.
REMEMBERED = 200_000
#: Texts whose new runs are aligned at once, by their characters.
TOGETHER = 1 << 20
RUN = re.compile(r"[ \n]+[^ \n]+|[ \n]+")
#: White space beside spaces and line ends; at such a place runs may not be independent.
OTHER_SPACE = re.compile(r"[^\S \n]")
SPACE = "▁"
#: Signs behind a word, which are aligned apart from it where neither tokenizer merges over the two.
SIGNS = ",.;:!?"
#: ASCII characters of which libraries may not agree whether they are white space.
CONTROL = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class ByteLevel:
    """The tokens of a tokenizer over bytes that are written as characters; special strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = True
        # a byte is written as itself where it prints, else as a character from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in prints]
        byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.data = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.data[i] = bytes(byte_of[c] for c in token)
        self.text = [str(i) for i in range(len(self.data))]
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.plain = self._plain(held["model"])
        words = held.get("pre_tokenizer") or {}
        self.by_runs = held.get("normalizer") is None and (words.get("type"), words.get("add_prefix_space"), words.get("use_regex")) == ("ByteLevel", False, True)

    def _plain(self, model: dict):
        """The same merges for ASCII texts from a library that is quicker at short ones, if a token's id says when it was merged; else None."""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model.get("merges", []))
        if model.get("type") != "BPE" or any(model["vocab"].get("".join(p)) != 256 + i for i, p in enumerate(pairs)):
            return None
        import tiktoken

        words = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
        ranks = {data: i for i, data in enumerate(self.data) if i < 256 + len(model["merges"])}
        return tiktoken.Encoding("merges", pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, held: list[str]) -> list[list[int]]:
        """Ids of texts as they are."""
        if self.plain is None:
            return [e.ids for e in self.lib.encode_batch_fast(held, add_special_tokens=False)]
        out = [self.plain(t) if t.isascii() and not CONTROL.search(t) else None for t in held]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.lib.encode_batch_fast([held[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


class Pieces:
    """The tokens of a tokenizer over characters, with single bytes for those it lacks, that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.data = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in names]
        self.text = [str(i) for i in range(len(names))]
        # nothing is merged over the beginning of a run if no piece has a space behind another character, or a line end at all
        plain = [p for i, p in enumerate(names) if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i))]
        self.by_runs = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain) and self.lib.encode("a\nb  c") == [*self.lib.encode("a"), *self.lib.encode("\nb  c")[1:]]
        merged = {d for p in plain for c, d in zip(p, p[1:]) if c.isalpha()}
        self.signs = [c for c in SIGNS if c not in merged]

    def encode(self, held: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space, which the library adds, or with a line end, where the space it adds is a token of its own."""
        found = self.lib.encode([t[1:] if t[0] == " " else t for t in held], num_threads=1)
        return [ids if t[0] == " " else ids[1:] for t, ids in zip(held, found)]


@dataclass(slots=True, eq=False)
class Aligned:
    """A run or text: numbers of A tokens, B tokens and groups; groups as text; id pairs of all links, as signed 64-bit numbers with A's id in the upper half."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes

    def followed(self, by: Aligned) -> Aligned:
        return Aligned(self.n_a + by.n_a, self.n_b + by.n_b, self.n_groups + by.n_groups, f"{self.groups};{by.groups}", self.links + by.links)


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A and how many B tokens each group has. Ends of tokens over the same bytes, ascending."""
    a_starts, b_starts = (np.concatenate(([0], e[:-1])) for e in (a_ends, b_ends))
    first = np.searchsorted(b_ends, a_starts, "right")
    last = np.searchsorted(b_starts, a_ends, "left")
    border = np.flatnonzero(np.concatenate((last[:-1] <= first[1:], [True])))
    return np.diff(border, prepend=-1), np.diff(last[border], prepend=0)


def linked(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id pair of every A and B token that share a group, group by group, and how many pairs a group has."""
    a_group = np.repeat(np.arange(len(n_a)), n_a)
    each = n_b[a_group]
    upper = np.repeat(a.astype(np.int64) << 32, each)
    first_b = np.cumsum(n_b) - n_b
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first_b[a_group], each)
    return upper | b[place], n_a * n_b


class Aligner:
    """Alignments of texts by two tokenizers, learned run by run."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.by_runs = self.a.by_runs and self.b.by_runs
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t.data], np.int64) for t in (self.a, self.b))
        self.runs: dict[str, Aligned | None] = {}
        self.before: dict[str, Aligned | None] = {}
        # a sign as it is behind a word: what stands behind the line end's own tokens
        self.signs = {c: sign for c in self.b.signs if (sign := self._sign(c)) is not None} if self.by_runs else {}

    def _sign(self, c: str) -> Aligned | None:
        line = self.align(["\n" + c])[0]
        if line is None or not line.groups.count(";"):
            return None
        end, sign = self.align(["\n"])[0], line.groups.split(";", 1)
        if end is None or end.groups != sign[0]:
            return None
        return Aligned(line.n_a - end.n_a, line.n_b - end.n_b, line.n_groups - end.n_groups, sign[1], line.links[len(end.links) :])

    def align(self, held: list[str]) -> list[Aligned | None]:
        """Of texts that begin with a space or line end; None where a side's tokens don't join to the text."""
        a_of, b_of = self.a.encode(held), self.b.encode(held)
        a, b = (np.array(list(chain.from_iterable(x)), np.int64) for x in (a_of, b_of))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        raw = [t.encode() for t in held]
        ends = np.cumsum([len(r) for r in raw])
        a_last, b_last = (np.cumsum([len(ids) for ids in x]) for x in (a_of, b_of))
        whole = b"".join(raw)
        bad = any(not len(x) or last[0] < 1 or not np.array_equal(x[last - 1], ends) for x, last in ((a_ends, a_last), (b_ends, b_last)))
        if bad or any(b"".join(map(t.data.__getitem__, ids.tolist())) != whole for t, ids in ((self.a, a), (self.b, b))):
            return [None] if len(held) == 1 else [x for t in self._halves(held) for x in self.align(t)]
        n_a, n_b = groups_of(a_ends, b_ends)
        pairs, n_links = linked(a, b, n_a, n_b)
        # a text ends where both sides do, so no group goes beyond it
        group = np.searchsorted(np.cumsum(n_a), a_last, "left") + 1
        link_at = np.concatenate(([0], np.cumsum(n_links)))[group] * 8
        links = pairs.tobytes()
        a_text, b_text = self.a.text, self.b.text
        sizes = list(zip(n_a.tolist(), n_b.tolist()))
        out: list[Aligned | None] = []
        x = begin = 0
        for a_ids, b_ids, y, end in zip(a_of, b_of, group.tolist(), link_at.tolist()):
            if y - x == 1:
                said = f"{','.join([a_text[i] for i in a_ids])}|{','.join([b_text[i] for i in b_ids])}"
            else:
                at = to = 0
                shown = []
                for p, q in sizes[x:y]:
                    shown.append(f"{','.join([a_text[i] for i in a_ids[at : at + p]])}|{','.join([b_text[i] for i in b_ids[to : to + q]])}")
                    at, to = at + p, to + q
                said = ";".join(shown)
            out.append(Aligned(len(a_ids), len(b_ids), y - x, said, links[begin:end]))
            x, begin = y, end
        return out

    @staticmethod
    def _halves(held: list[str]) -> tuple[list[str], list[str]]:
        """Texts among which one has no tokens are looked at in halves."""
        return held[: len(held) // 2], held[len(held) // 2 :]

    def learn(self, met: set[str]) -> None:
        """Align the runs that aren't remembered."""
        if len(self.runs) >= REMEMBERED:
            self.before, self.runs = self.runs, {}
        new, signed = set(), []
        for run in met.difference(self.runs):
            if run in self.before:
                self.runs[run] = self.before[run]
            elif run[-1] in self.signs and run[-2].isalpha():
                signed.append(run)
                word = run[:-1]
                if word in self.before:
                    self.runs[word] = self.before[word]
                elif word not in self.runs:
                    new.add(word)
            else:
                new.add(run)
        if new:
            self.runs.update(zip(new, self.align(list(new))))
        for run in signed:
            word = self.runs[run[:-1]]
            self.runs[run] = None if word is None else word.followed(self.signs[run[-1]])

    def texts(self, held: list[str]) -> list[list[Aligned] | None]:
        """The alignments of a text's runs, or of the text as one; None for a text without tokens."""
        whole = [" " + t for t in held]
        cut = [RUN.findall(t) if self.by_runs and not OTHER_SPACE.search(t) else None for t in whole]
        self.learn({run for runs in cut if runs for run in runs})
        out: list[list[Aligned] | None] = []
        for text, t, runs in zip(held, whole, cut):
            found = None
            if text and runs:
                found = list(map(self.runs.__getitem__, runs))
            if text and (found is None or None in found):
                found = self.align([t])
            out.append(None if found is None or None in found else found)
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker and pair of tokenizers."""
    return Aligner(a_path, b_path)


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, at: str) -> DataFrame:
    """Written to the folder and read again: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and linked, the distinct id pairs of the text with the number of their links."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "linked"]
    pair = pa.struct([pa.field("pair", pa.int64()), pa.field("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, held = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            i = 0
            while i < len(held):
                j, size = i, 0
                while j < len(held) and (j == i or size + len(held[j]) <= TOGETHER):
                    size += len(held[j])
                    j += 1
                out, keys, counts = [], [], []
                for doc_id, runs in zip(ids[i:j], find.texts(held[i:j])):
                    runs = runs or []
                    key, n = np.unique(np.frombuffer(b"".join([r.links for r in runs]), np.int64), return_counts=True)
                    keys.append(key)
                    counts.append(n)
                    digest = hashlib.sha256(";".join([r.groups for r in runs]).encode()).hexdigest() if runs else ""
                    out.append((row, doc_id, sum([r.n_a for r in runs]), sum([r.n_b for r in runs]), sum([r.n_groups for r in runs]), int(n.sum()), digest))
                    row += 1
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                links = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts).astype(np.int64))], fields=list(pair)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*out)), links], names)
                i = j

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, linked array<struct<pair: bigint, n: bigint>>"
    texts(docs).mapInArrow(run, schema).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_rows (in how many texts its ids are linked) and best (whether none of its A id's pairs has more)."""
    counts = aligned.select(F.explode("linked.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_rows"))
    return counts.withColumn("best", F.col("n_rows") == F.max("n_rows").over(Window.partitionBy(F.shiftright("pair", 32))))


def align(docs: DataFrame, a_path: str, b_path: str, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts aligned between a byte-level tokenizer (A, of space + text) and one of pieces (B, which adds the space), and the corpus-wide counts of linked ids.

    The first table has doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of tokens that share a
    group), n_best (those whose ids are linked in as many texts as any of the A id's pairs, ties
    included), count_sum (over links, in how many texts their ids are linked) and groups_sha256 (of
    the groups as `a1,a2|b1;a3|b2,b3`, lowercase hex). The second has a_id, b_id, n_docs, best.

    Texts that are null or empty, and those whose tokens don't join to their bytes on either side (as
    with a character that B writes its spaces with), have no tokens: zeros, and '' as the digest.
    Rows without a doc_id take no part and aren't counted; repeated rows and rows that repeat a doc_id
    are each a text and are all returned. Further columns aren't used. An empty table gives none.
    Texts are aligned whole, whatever their length. at: a folder that all executors reach for the
    texts' links; without one, one under the shared checkpoint folder.
    """
    spark = docs.sparkSession
    at = at or f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    aligned = aligned_texts(docs, a_path, b_path, at)
    counts = cut(pair_counts(aligned))
    links = aligned.select("row", F.explode("linked").alias("link")).select("row", F.col("link.pair").alias("pair"), F.col("link.n").alias("n"))
    told = counts.withColumn("count", F.col("n_rows"))
    if counts.count() <= TOLD:
        joined = links.join(F.broadcast(told), "pair")
    else:
        total = aligned.agg(F.sum(F.size("linked")).alias("n")).first().n
        joined = look_up(links, told, "pair", total)
    summed = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    rows = aligned.drop("linked").join(summed, "row", "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    pairs = counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), F.col("n_rows").alias("n_docs"), "best")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256"), pairs
