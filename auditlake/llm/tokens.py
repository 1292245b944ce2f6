"""Token ids by public tokenizers, inside Spark tasks.

A tokenizer that drops white space and never merges across it gives each run of other characters the
same ids wherever it stands. For such a tokenizer a worker keeps the ids of the runs it has seen and
joins them; texts with runs that hold characters outside a plain range, or that may hold a special
string, go through the library whole. All other tokenizers always do.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from struct import pack

import numpy as np

#: A special string's start, and separators of Python's that are none of the library's.
APART = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Characters for which lower-casing and composition are the same in Python as in the library: ASCII and Latin letters with marks, without control characters and dotted capital I.
UNUSUAL = re.compile(r"[^!-~\xa1-įı-ɏ]")
#: Runs that one worker remembers, and once more those of before.
REMEMBERED = 300_000
#: Normalisers and splitting pattern of a tokenizer that may be taken run by run.
BY_RUNS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


class Unusual(Exception):
    """A run holds a character out of the plain range."""


class Runs(dict):
    """Ids by run, learned where they are first asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, run: str) -> bytes:
        ids = self[run] = self.learn(run)
        return ids


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_runs = False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: pieces.encode(text, num_threads=1)
            return
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.whole = lambda text: self.lib.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        normal, split = held.get("normalizer") or {}, held.get("pre_tokenizer") or {}
        steps = split.get("pretokenizers") or [{}]
        special = [t["content"] for t in held.get("added_tokens", [])]
        self.by_runs = (
            normal.get("normalizers") == BY_RUNS["normalizer"]
            and steps[0].get("pattern") == {"Regex": BY_RUNS["split"]}
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
            and (steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == (False, False)
            and held.get("post_processor") is None
            and all(s.startswith("<|") for s in special)
        )
        if self.by_runs:
            import regex

            self.pieces = regex.compile(BY_RUNS["split"]).findall
            # runs of late and those of before: what is met again stays, what isn't goes
            self.runs = Runs(self._learn)
            self.before: dict[str, bytes] = {}
            self.tokenize = self.lib.model.tokenize
            # each byte stands for itself where it prints, else for a character from 256 on
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = iter(range(256, 512))
            self.shown = {b: b if b in shown else next(rest) for b in range(256)}

    def _learn(self, run: str) -> bytes:
        """The ids of a run that isn't among those of late."""
        ids = self.before.get(run)
        if ids is not None:
            return ids
        plain = run.isascii()
        if not (plain and run.isprintable()) and UNUSUAL.search(run):
            raise Unusual(run)
        if not run.isalpha():
            head = run[:-1]
            if head.isalpha():
                # a sign or digit behind a word is a word of its own
                return self.runs[head] + self.runs[run[-1]]
            if len(words := self.pieces(run)) > 1:
                return b"".join(map(self.runs.__getitem__, words))
        tokens = self.tokenize(run if plain else run.encode().decode("latin-1").translate(self.shown))
        return pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def ids(self, text: str) -> bytes:
        if not self.by_runs or any(a in text for a in APART):
            return np.array(self.whole(text), "<u4").tobytes()
        if len(self.runs) >= REMEMBERED:
            self.before, self.runs = self.runs, Runs(self._learn)
        try:
            return b"".join(map(self.runs.__getitem__, text.lower().split()))
        except Unusual:
            return np.array(self.whole(text), "<u4").tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker and tokenizer."""
    return Encoder(path)
