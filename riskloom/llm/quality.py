"""Quality classifier: positive-unlabelled learning on measures of style.

Measures are taken over the whole text and over its worst line, and coded by level, so that the
linear model can follow any course of a measure. Words themselves are no features.
"""

from __future__ import annotations

import math
import re
from operator import eq

from pyspark.sql import DataFrame

from riskloom.llm.pu import PuSettings, kept_rows, score, train

SETTINGS = PuSettings(folds=5, held=0, z=1.0)  # few features, so weak ones may come along
_SIGN = re.compile(r"[^\w\s.,;:'\"?()\-]")
_MARKS = re.compile(r"([^\w\s])\1")
#: Flags of a word, each in a field of its own, so that words are counted by one sum.
_FLAGS = ("signs", "marks", "bars", "capitals", "digits", "long")
_FIELD = 32
_MASK = (1 << _FIELD) - 1
MEMO_WORDS = 200_000


class _WordFlags(dict):
    """Memo of packed word flags; emptied when full."""

    def __missing__(self, word: str) -> int:
        found = (bool(_SIGN.search(word)), bool(_MARKS.search(word)), word == "|", len(word) > 1 and word.isupper(),
                 any(map(str.isdigit, word)), len(word) > 30)
        packed = sum(1 << _FIELD * i for i, flag in enumerate(found) if flag)
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) < 40:
            self[word] = packed
        return packed


_MEMO = _WordFlags()


def _level(share: float) -> int:
    """0 for none, then by halves down from 1."""
    return 0 if share <= 0 else max(1, 9 + math.floor(math.log2(min(share, 1.0))))


def _levels(packed: int, echoes: int, distinct: int, n: int) -> list[int]:
    counts = [packed >> _FIELD * i & _MASK for i in range(len(_FLAGS))]
    return [_level(c / n) for c in (*counts, echoes, n - distinct)]


def style_features(text: str) -> set[str]:
    """Coded measures of the whole text and of its worst line of five words or more.

    Measures are shares of the words: with signs, with doubled signs, bars, capitals, with digits, very
    long, equal to the word before in the line, and repeated.
    """
    names = (*_FLAGS, "echo", "same")
    packed = echoes = n = 0
    distinct: set[str] = set()
    worst = [-1] * len(names)
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        own, again, different = sum(map(_MEMO.__getitem__, words)), sum(map(eq, words, words[1:])), set(words)
        packed, echoes, n = packed + own, echoes + again, n + len(words)
        distinct |= different
        if len(words) >= 5:
            worst = list(map(max, worst, _levels(own, again, len(different), len(words))))
    found = {f"all {k} {v}" for k, v in zip(names, _levels(packed, echoes, len(distinct), max(1, n)))}
    found.add(f"words {min(12, n.bit_length())}")
    found.update(f"line {k} {v}" for k, v in zip(names, worst) if v >= 0)
    return found


def score_quality(docs: DataFrame, labels: DataFrame, settings: PuSettings = SETTINGS, label: str = "quality",
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """See ``pu.score``: probability that ``label`` is 1, learned outside the held-out rows."""
    model = train(docs, labels, label, style_features, settings, key, text, key)
    return score(docs, model, style_features, settings, 0.3, key, text)


def keep_good(docs: DataFrame, labels: DataFrame, settings: PuSettings = SETTINGS, label: str = "quality",
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted to be good, with all their columns; repeated rows are judged each."""
    return kept_rows(docs, train(docs, labels, label, style_features, settings, key, text, key), style_features, 0.3, text)
