"""Toxicity classifier: non-negative positive-unlabelled learning on words and word stems."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from riskloom.llm.pu import PuSettings, score, train

SETTINGS = PuSettings(folds=4, held=2, z=6.0, lift=2.5, least=8)
#: Stems of these lengths stand beside the whole word, so that inflected forms share what they learn.
STEMS = (4, 5, 6)
_WORDS = re.compile(r"[^\W\d_]+")


def word_features(text: str) -> set[str]:
    """Distinct lower-case words, their stems with a hyphen, and with a 2 those stems that occur twice or more."""
    words = Counter(_WORDS.findall(text.lower()))
    found = set(words)
    stems: dict[str, int] = {}
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                stem = word[:size] + "-"
                stems[stem] = stems.get(stem, 0) + n
    found.update(stems)
    found.update([stem + "2" for stem, n in stems.items() if n > 1])
    return found


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: PuSettings = SETTINGS, label: str = "toxic",
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """See ``pu.score``: probability that ``label`` is 1, learned outside the held-out rows."""
    model = train(docs, labels, label, word_features, settings, key, text, key)
    return score(docs, model, word_features, settings, 0.3, key, text)
