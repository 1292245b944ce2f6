"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and of word stems is learned from labelled texts. Features of a text are densities
of the lexicon, how near its words stand to the second person, rates of capitals, punctuation and
obfuscated spellings. Trees are fitted to the labels of a bounded sample, and their sum is mapped to
a probability by isotonic regression on a part of the sample that the trees have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import batched, bounded_ids, cut, held_out, one_text_each, short_batches, texts

#: Labelled texts that a model is fitted on (a parameter), toxic texts that a term must be in, letters of a stem.
SAMPLE, SEEN, STEM = 20_000, 4, 5
#: Words of the second person in the languages of the corpus, and how many words away they still count.
YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú ti tuyo vosotros".split())
NEAR = 4
#: ASCII punctuation but the signs that stand for letters separates words.
SPLIT = bytes(32 if chr(b) in ".,;:!?\"()[]{}<>/\\|'`" else b for b in range(256))
#: Signs that stand for letters.
SPELT = str.maketrans("013457@$€", "oieastase")
MASKED = re.compile(r"[^\W\d_][\d@$€*#]+[^\W\d_]|(.)\1\1|\b(?:\w[ .\-_*]){3,}\w\b")
NAMES = ["word density", "stem density", "weight density", "strongest", "distinct", "hits", "near second person", "second person", "spelt hits", "masked", "capitals", "shouted", "punctuation", "exclamation", "words", "word length"]


def split_words(text: str) -> list[str]:
    return text.lower().encode().translate(SPLIT).decode().split()


def features(text: str, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    words = split_words(text)
    n = max(1, len(words))
    hits = [(i, w) for i, w in enumerate(words) if w in lexicon or w[:STEM] in stems]
    whole = [lexicon[w] for _, w in hits if w in lexicon]
    part = [stems[w[:STEM]] for _, w in hits if w[:STEM] in stems]
    weights = [max(lexicon.get(w, 0.0), stems.get(w[:STEM], 0.0)) for _, w in hits]
    you = 0
    near = 0
    if hits or not YOU.isdisjoint(words):
        you = sum(map(YOU.__contains__, words))
        near = sum(not YOU.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i, _ in hits)
    masked = sum(1 for _ in MASKED.finditer(text))
    spelt = 0
    if masked:
        spelt = sum(1 for w in words if not w.isalpha() and (s := re.sub(r"[\W_]|(.)(?=\1\1)", "", w.translate(SPELT))) != w and (s in lexicon or s[:STEM] in stems))
    raw = np.frombuffer(text.encode(), np.uint8)
    size = max(1, len(raw))
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    marks = int((((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64))).sum())
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if upper > 2 else 0
    return [len(whole) / n, len(part) / n, sum(weights) / n, max(weights, default=0.0), len({w for _, w in hits}), len(hits), near / n, you / n, spelt / n, masked / n, upper / size, shouted / n, marks / size, int((raw == 33).sum()) / size, len(words), size / n]


class Trees:
    """Gradient boosting of the logistic loss over binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[list[tuple]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.concatenate((np.quantile(c, np.linspace(0, 1, self.bins)), np.quantile(c[c > c.min()], np.linspace(0, 1, self.bins)) if (c > c.min()).any() else c[:1]))) for c in x.T]
        b = self.binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree: list[tuple] = []
            raw += self.rate * self._grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth, tree, np.zeros(len(y)))
            self.nodes.append(tree)
        return self

    def _grow(self, b, g, h, rows, depth, tree, out):
        me = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = total_g / (total_h + 1.0)
        tree.append((-1, 0, 0, 0, float(value)))
        out[rows] = value
        best = (1e-6, -1, 0)
        if depth and len(rows) >= 2 * self.least:
            for j in range(b.shape[1]):
                width = len(self.edges[j]) + 1
                sg = np.cumsum(np.bincount(b[rows, j], g[rows], width))[:-1]
                sh = np.cumsum(np.bincount(b[rows, j], h[rows], width))[:-1]
                k = np.cumsum(np.bincount(b[rows, j], minlength=width))[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(k < self.least) | (len(rows) - k < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] >= 0:
            left = b[rows, best[1]] <= best[2]
            at = len(tree)
            self._grow(b, g, h, rows[left], depth - 1, tree, out)
            right = len(tree)
            self._grow(b, g, h, rows[~left], depth - 1, tree, out)
            tree[me] = (best[1], best[2], at, right, float(value))
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        for tree in self.nodes:
            at = np.zeros(len(x), np.int64)
            feature, cut_at, left, right, value = (np.array(c) for c in zip(*tree))
            for _ in range(self.depth):
                f = feature[at]
                down = b[np.arange(len(x)), np.maximum(f, 0)] <= cut_at[at]
                at = np.where(f < 0, at, np.where(down, left[at], right[at]))
            out += self.rate * value[at]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing function of the score that fits y best (pool adjacent violators), each with one observation of the mean of all mixed in, so that no step is at 0 or 1."""
    # equal scores are one observation with a weight
    values, at = np.unique(score, return_inverse=True)
    pools: list[list[float]] = []  # sum, number, first and last score
    for s, v, n in zip(values.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist()):
        pools.append([v, n, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, _, last = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += n2
            pools[-1][3] = last
    mean = float(y.mean())
    xs = np.array([x for p in pools for x in (p[2], p[3])])
    ys = np.array([v for p in pools for v in [(p[0] + mean) / (p[1] + 1)] * 2])
    return xs, np.maximum.accumulate(ys)


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """All words and stems that occur in at least SEEN toxic texts and far more often in those than in others, with the smoothed log odds of texts. sample: text, toxic; a term needs texts of the sample, whose number is bounded."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                words = set(split_words(text.as_py()))
                for kind, found in (("word", words), ("stem", {w[:STEM] for w in words if len(w) > STEM})):
                    for t in found:
                        seen.setdefault((kind, t), [0, 0])[toxic] += 1
            if len(seen) > 200_000:
                yield told(seen)
                seen = {}
        if seen:
            yield told(seen)

    def told(seen: dict) -> pa.RecordBatch:
        kind, term = zip(*seen)
        clean, toxic = zip(*seen.values())
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(term), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["kind", "term", "clean", "toxic"])

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    counted = sample.mapInArrow(terms, "kind string, term string, clean long, toxic long").groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counted.where(F.col("toxic") >= SEEN).withColumn("odds", odds).where("odds > 2.5").select("kind", "term", "odds").collect()
    return {r.term: r.odds for r in kept if r.kind == "word"}, {r.term: r.odds for r in kept if r.kind == "stem"}


class Model:
    """A lexicon, trees and their calibration; without labels of both kinds, the share of toxic ones for every text."""

    def __init__(self, share: float = 0.0):
        self.share = share
        self.lexicon: dict[str, float] = {}
        self.stems: dict[str, float] = {}
        self.trees: Trees | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.raw(x), *self.steps), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on at most `most` labelled doc_ids outside the held-out rows, one text for each; texts and their labels alone are used. Rows with a null label or doc_id take no part; of repeated labels of a document the larger counts. Where a doc_id repeats, the text of it that is first by its hash is fitted on."""
    known = labels.where("toxic is not null and doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = bounded_ids(known.where(~held_out(4, 2)), most)
    # the bound keeps this side small
    sample = cut(one_text_each(texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")))
    share = sample.agg(F.avg("toxic").alias("m"), F.count("*").alias("n")).first()
    if not share.n or share.m in (0.0, 1.0):
        return Model(float(share.m or 0.0))
    model = Model(float(share.m))
    # the last part of the sample calibrates; lexicon and trees don't see it
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    model.lexicon, model.stems = learn_lexicon(sample.where(~apart))
    rows = extracted(sample.withColumn("apart", apart.cast("int")), model, ["toxic", "apart"]).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    x, y, late = np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float), rows["apart"].to_numpy(bool)
    if y[~late].min(initial=1) == y[~late].max(initial=0) or not late.any():
        return Model(float(share.m))
    model.trees = Trees().fit(x[~late], y[~late])
    model.steps = isotonic(model.trees.raw(x[late]), y[late])
    return model


def extracted(rows: DataFrame, model: Model, more: list[str]) -> DataFrame:
    lexicon, stems = model.lexicon, model.stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py(), lexicon, stems) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in more), pa.array(x, pa.list_(pa.float64()))], ["doc_id", *more, "x"])

    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{c} int, " for c in more) + "x array<double>")


def apply(docs: DataFrame, model: Model, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs with a score and what it predicts, under the given names; columns of docs that have these names are replaced, so whoever keeps them gives others. A null text is scored as an empty one."""
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    short_batches(docs.sparkSession)
    text = next(c for c in kept if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "", model.lexicon, model.stems) for t in batch.column(text)]).reshape(batch.num_rows, len(NAMES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, *names])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([docs.schema[c] for c in kept]).add(names[0], DoubleType()).add(names[1], IntegerType())
    return docs.select(*kept).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each document.

    A text of any length is scored whole, as densities over all its words; null and empty texts are
    scored as texts without a word. A score of exactly the threshold is predicted 1; texts with equal
    features have equal scores. Rows without a doc_id take no part; rows that repeat one are all
    scored. An empty table gives none; without labels of both kinds every score is the share of toxic
    ones (0 without any).
    """
    model = fit(docs, labels, most)
    return apply(texts(docs).select("doc_id", "text"), model, threshold).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
