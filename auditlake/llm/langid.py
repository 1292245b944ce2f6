"""Language of texts and of spans in mixed-language texts.

Each word gets a score for every language from trigrams of its bytes, learned from labelled texts.
The script of a word's letters leaves only the languages written in it as candidates, however the
others score; a script that no learned language is written in rules none out. Viterbi's algorithm
labels the words of a text so that the scores, less a penalty for every switch between languages, are
largest; runs of a label are spans. A text's language is that of most of its letters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_ids, cut, held_out, one_text_each, texts, utf8

#: Texts that the scores are learned from (a parameter of the model), times that a trigram must occur in them, cost of a switch, and the share of a language's letters that makes a script its own.
SAMPLE, SEEN, SWITCH, OWN = 20_000, 2, 6.0, 0.01
#: What is taken from the score of a language that a word's script rules out: more than any text's words add up to.
FOREIGN = 1e9
#: Bytes of text that are scored at once.
PASS_BYTES = 4 << 20
SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "kana", "han", "hangul", "other"]
#: First code points of Unicode blocks (fixed values), each to the next, with the script of the letters in them.
BLOCKS = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"),
    (0x00B5, "latin"), (0x00B6, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"), (0x00D7, "none"), (0x00D8, "latin"),
    (0x00F7, "none"), (0x00F8, "latin"), (0x02B9, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x1F000, "none"), (0x20000, "han"),
]


@lru_cache(maxsize=1)
def scripts_of() -> np.ndarray:
    """Script by code point; 0 where Unicode's category isn't that of a letter. Letters of other blocks have the last script."""
    first, names = zip(*BLOCKS)
    code = np.array([SCRIPTS.index(n) for n in names], np.uint8)
    points = np.arange(sys.maxunicode + 1)
    script = code[np.searchsorted(np.array(first), points, side="right") - 1]
    letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    script[script == 0] = len(SCRIPTS) - 1
    return np.where(letter, script, 0).astype(np.uint8)


GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True


def letters_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of characters that are letters, and their scripts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    script = scripts_of()[points]
    kept = script > 0
    return lead[kept], script[kept]


class Words:
    """The words of texts on end: bounds in the bytes, document, letters and script of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        gap = GAP[data]
        start = np.zeros(len(data), bool)
        start[0:1] = True
        start[1:] = gap[:-1]
        inside = bounds[:-1][bounds[:-1] < len(data)]
        start[inside] = True
        self.start = np.flatnonzero(start & ~gap)
        stop = np.zeros(len(data), bool)
        stop[-1:] = True
        stop[:-1] = gap[1:]
        ends = bounds[1:] - 1
        stop[ends[ends >= 0]] = True
        self.end = np.flatnonzero(stop & ~gap) + 1
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        at, script = letters_of(data)
        word = np.searchsorted(self.start, at, side="right") - 1
        self.letters = np.bincount(word, minlength=len(self.start))[: len(self.start)]
        self.script = np.zeros(len(self.start), np.uint8)
        self.script[word[::-1]] = script[::-1]  # that of the first letter
        self.scripts = script, word


def trigrams(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte trigrams of each word between a mark before and a mark behind it, and the first of each word."""
    size = words.end - words.start
    low = data | np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    at = np.concatenate(([0], np.cumsum(size + 2)))
    line = np.zeros(at[-1], np.int64)
    place = np.repeat(at[:-1] + 1 - words.start, size) if len(size) else np.zeros(0, np.int64)
    inside = np.repeat(words.start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
    line[inside + place] = low[inside]
    code = (line[:-2] << 16) | (line[1:-1] << 8) | line[2:] if len(line) > 2 else np.zeros(0, np.int64)
    # a word of n bytes has n trigrams; those over two words are left out
    keep = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
    return code[keep], np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.int64)


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, score: np.ndarray, allowed: np.ndarray):
        self.langs, self.code, self.scores, self.allowed = langs, code, score, allowed
        self.index: np.ndarray | None = None

    def word_scores(self, data: np.ndarray, words: Words) -> np.ndarray:
        """A row for each word, a column for each language; words without letters score nothing."""
        if self.index is None:
            self.index = np.zeros(1 << 24, np.uint16 if len(self.code) < 1 << 16 else np.uint32)
            self.index[self.code] = np.arange(1, len(self.code) + 1)
        code, first = trigrams(data, words)
        if not len(first):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.scores[self.index[code]], first, axis=0)
        out -= np.where(self.allowed[words.script], 0, FOREIGN).astype(np.float32)
        out[words.letters == 0] = 0
        return out


def viterbi(score: np.ndarray, size: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word. score: words of all texts on end; size: words of each text. Texts advance together, a word a step."""
    label = np.zeros(len(score), np.int32)
    order = np.argsort(-size, kind="stable")
    length, first = size[order], (np.cumsum(size) - size)[order]
    live = int((length > 0).sum())
    if not live:
        return label
    first, length = first[:live], length[:live]
    now = score[first].astype(np.float64)
    came = np.zeros(score.shape, bool)
    best_at = np.zeros(len(score), np.int32)
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # texts of at least so many words
    last = np.empty((live, score.shape[1]))
    for t in range(1, int(length[0])):
        k = int(active[t])
        if k < len(now):
            last[k : len(now)] = now[k:]
            now = now[:k]
        rows = first[:k] + t
        top = now.argmax(axis=1)
        jump = now[np.arange(k), top][:, None] - switch
        moved = now < jump
        came[rows] = moved
        best_at[rows] = top
        now = np.where(moved, jump, now) + score[rows]
    last[: len(now)] = now
    state = last.argmax(axis=1).astype(np.int32)
    current = np.zeros(live, np.int32)
    for t in range(int(length[0]) - 1, -1, -1):
        k = int(active[t])
        ending = length[:k] == t + 1
        current[:k][ending] = state[:k][ending]
        rows = first[:k] + t
        label[rows] = current[:k]
        moved = came[rows, current[:k]]
        current[:k] = np.where(moved, best_at[rows], current[:k])
    return label


def learn(docs: DataFrame, most: int = SAMPLE) -> Model:
    """Trigram scores and scripts of each language, of which there may be any number, from at most `most` labelled doc_ids outside the held-out rows, one text for each. Every trigram that occurs at least SEEN times in the sample is kept; others score nothing."""
    labelled_docs = docs.where("lang is not null and doc_id is not null").where(~held_out(5, 0))
    ids = bounded_ids(labelled_docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), most)
    rows = texts(labelled_docs, F.col("lang").cast("string").alias("lang")).join(F.broadcast(ids), "doc_id")
    sample = one_text_each(rows.select("doc_id", "text", "lang")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            for lang in np.unique(langs):
                data, bounds = utf8(batch.column("text").filter(pa.array(langs == lang)))
                words = Words(data, bounds)
                code, n = np.unique(trigrams(data, words)[0], return_counts=True)
                script, k = np.unique(words.scripts[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(code) + len(script))), pa.array(np.concatenate((code, -1 - script.astype(np.int64)))), pa.array(np.concatenate((n, k)))], ["lang", "code", "n"])

    counted = cut(sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    top = counted.where("code >= 0").groupBy("code").agg(F.sum("n").alias("all")).where(F.col("all") >= SEEN).select("code")
    # the model: for each language a number for each trigram kept and each script, as columns; the sample bounds how many there are
    held = counted.join(top, "code", "left_semi").unionByName(counted.where("code < 0")).toArrow()
    codes, number = held.column("code").to_numpy(), held.column("n").to_numpy()
    column = np.searchsorted(np.array(langs, object), np.array(held.column("lang").to_pylist(), object)) if langs else np.zeros(0, np.int64)
    code = np.unique(codes[codes >= 0])
    n, scripts = np.zeros((len(code), len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    common = codes >= 0
    n[np.searchsorted(code, codes[common]), column[common]] = number[common]
    scripts[-1 - codes[~common], column[~common]] = number[~common]
    share = (n + 0.5) / (n.sum(axis=0) + 0.5 * max(1, len(code)))
    score = np.log(share) - np.log(share).mean(axis=1, keepdims=True) if len(langs) else share
    allowed = scripts >= OWN * np.maximum(1, scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # no language is written so: no evidence
    allowed[0] = True
    return Model(langs, code, np.concatenate((np.zeros((1, len(langs))), score)).astype(np.float32), allowed)


def labelled(data: np.ndarray, bounds: np.ndarray, model: Model, switch: float) -> tuple[Words, np.ndarray]:
    words = Words(data, bounds)
    size = np.bincount(words.doc, minlength=len(bounds) - 1)
    return words, viterbi(model.word_scores(data, words), size, switch)


def parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of a few megabytes each."""
    data, bounds = utf8(column)
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PASS_BYTES, side="right")) - 1)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def spans(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, start, end and lang of each span: words start to end-1 of the text have one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, _, data, bounds in parts(batch.column("text")):
                words, label = labelled(data, bounds, model, switch)
                if not len(label):
                    continue
                new = np.concatenate(([True], (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])))
                at = np.flatnonzero(new)
                first = np.searchsorted(words.doc, words.doc[at])
                end = np.concatenate((at[1:], [len(label)]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + words.doc[at]]), pa.array(at - first), pa.array(end - first), pa.array([model.langs[i] for i in label[at]])], ["doc_id", "start", "end", "lang"])

    return texts(docs).mapInArrow(run, "doc_id long, start long, end long, lang string") if model.langs else texts(docs).select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("und").alias("lang")).where("false")


def identify(docs: DataFrame, most: int = SAMPLE, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; score is the share of letters with the language.

    A null text and one without a letter is `und` with score 0, and so is every text where no labelled
    one exists. Letters are characters of Unicode's letter categories: digits, marks and symbols of any
    script are none. Ties go to the first language in order. Texts of any length are labelled whole.
    Rows without a doc_id take no part; rows that repeat one are all returned. Further columns aren't used. An empty table gives none.
    """
    model = learn(docs, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for a, b, data, bounds in parts(batch.column("text")):
                n, k = b - a, max(1, len(model.langs))
                weight = np.zeros((n, k))
                if model.langs and len(data):
                    words, label = labelled(data, bounds, model, switch)
                    np.add.at(weight, (words.doc, label), words.letters)
                total = weight.sum(axis=1)
                best = weight.argmax(axis=1)
                share = weight[np.arange(n), best] / np.maximum(total, 1)
                pred += [model.langs[i] if t else "und" for i, t in zip(best.tolist(), total.tolist())]
                score += np.where(total > 0, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
