from __future__ import annotations

import pytest

#: What every operator must bear: nulls, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "one two"), (6, " One\n\ntwo "), (7, "one  two"),
    (8, "the cat sat on the mat " * 4000), (9, "x" * 200_000), (10, "é▁ﬁ😀\x00 　a b"), (None, "one two"),
    (None, None), (11, "The Cat sat on the mat and the dog lay by the fire all day long"),
    (12, "the cat sat on the mat and the dog lay by the fire all day long"),
]
#: Names that operators use for their own columns.
CLASHES = ("key", "ids", "size", "shard", "score", "fingerprint", "kept", "block", "n_words", "label", "p", "u")


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, *range(len(CLASHES))) for r in ODD]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{c} int" for c in CLASHES)]))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
