import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from riskloom.llm import quality, queries
from riskloom.staging import stage
from test_fingerprints import slow_components, slow_fingerprint
from test_phrases import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    kept, seen = {r.doc_id: r.text or "" for r in docs.collect()}, {}
    frames = {}
    for name, step in corpus_pipeline.STAGES:
        docs = frames[name] = stage(step(spark, docs, SF), name)
        seen[name] = docs.collect()
        assert name == "pieces" or docs.columns == columns
    ids = {name: sorted(r.doc_id for r in rows) for name, rows in seen.items()}

    scored = quality.score_quality(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    assert ids["quality"] == sorted(r.doc_id for r in scored.collect() if r.predicted)
    bad = {r.doc_id for r in queries.table(spark, SF, "labels").collect() if r.quality == 0}
    good = {r.doc_id for r in queries.table(spark, SF, "labels").collect() if r.quality == 1}
    # Accuracy is tested on more rows; of these few bad documents most must go, and hardly a good one.
    assert len(bad & set(ids["quality"])) <= 0.5 * len(bad) and len(good - set(ids["quality"])) <= 0.02 * len(good)

    texts = {k: kept[k] for k in ids["quality"]}
    owner = {}
    for k in sorted(texts):
        owner.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[k]), k)
    assert ids["exact"] == sorted(owner.values()) and len(ids["exact"]) < len(ids["quality"])

    marks = [(k, slow_fingerprint(kept[k])) for k in ids["exact"]]
    assert ids["near"] == [k for (k, _), c in zip(marks, slow_components(marks)) if k == c]

    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    judged = brute([(k, kept[k]) for k in ids["near"]], items)
    assert ids["benchmark"] == [k for k, *_, contaminated in judged if not contaminated]

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in seen["pieces"]:
        want = library.encode(kept[r.doc_id]) + [2]
        assert (r["ids"], r.n_tokens) == (want, len(want))
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert ids["pieces"] == ids["benchmark"]


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_odd_rows(spark, odd_docs, no_docs, name, step):
    out = step(spark, odd_docs, SF)
    rows = out.collect()
    assert len(rows) <= odd_docs.count()
    if name != "pieces":
        assert out.columns == odd_docs.columns
        assert {r.doc_id for r in rows if r.doc_id is not None} or name == "quality"
        if name != "quality":
            # Copies of rows that have an id are dropped like any other where copies are what the stage drops.
            assert sum(r.doc_id is None for r in rows) == (0 if name in ("exact", "near") else 2)
    assert step(spark, no_docs, SF).count() == 0


def test_rows_decide_for_themselves(spark):
    """Rows that share an id neither drop nor keep each other; a repeated row stays once."""
    item = next(r.text for r in queries.table(spark, SF, "benchmark").collect() if len((r.text or "").split()) > 20)
    only = "Nobody numbered this page about the slow green river that bends around the chapel and the empty orchard"
    fish = "Seven silver fish swam below the old stone bridge while the miller counted sacks of oats in the morning"
    ship = "A tall ship from the north brought amber furs and salted herring to the quiet harbour before winter came"
    rows = [(1, fish), (7, fish), (None, fish), (7, ship), (7, ship), (7, item), (None, item), (None, only), (None, only)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    for name in ("exact", "near"):
        got = [tuple(r) for r in steps[name](spark, docs, SF).collect()]
        assert sorted(got, key=str) == sorted([(1, fish), (7, ship), (7, item), (None, only)], key=str)
    got = [tuple(r) for r in steps["benchmark"](spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != item], key=str)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert corpus_pipeline.ORACLE_SQL is None
