import numpy as np
import pytest
import public_tokenizers
import sentencepiece

from riskloom.llm import queries, tokenfiles

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_scan_against_a_loop(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(tokenfiles, "RUN_BLOCKS", 4)
    draw = np.random.default_rng(7)
    files = {"empty": [], "none": [5, 6, 7], "only": [2], "ends": [2, 2, 2, 2], "tail": [4, 2, 2, 9],
             "many": draw.choice([2, 3, 514, 512], 150).tolist()}  # bytes of 2 that are no id 2
    want = set()
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
        doc = start = 0
        for i, x in enumerate(ids):
            if x == 2:
                want.add((str(tmp_path / name), doc, start, i - start, True))
                doc, start = doc + 1, i + 1
        if start < len(ids):
            want.add((str(tmp_path / name), doc, start, len(ids) - start, False))
    frame = spark.createDataFrame([(str(tmp_path / n),) for n in [*files, "many"]] + [(None,)], "file string")
    got = [tuple(r) for r in tokenfiles.token_counts(frame, 2, block_tokens=block).collect()]
    assert len(got) == len(want) and set(got) == want


def test_file_of_another_width_is_an_error(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="no file of 2-byte ids"):
        tokenfiles.token_counts(spark.createDataFrame([(str(tmp_path / "odd"),)], "file string"), 2).collect()


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {(r.doc_id, len(library.encode(r.text or "")), True) for r in queries.table(spark, sf, "documents").collect()}
    got = [tuple(r) for r in queries.op8_token_counts(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_odd_rows(odd_docs, no_docs, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    manifest = tokenfiles.write_files(odd_docs, MODEL, f"file://{tmp_path}/a")
    rows = manifest.join(tokenfiles.token_counts(manifest.select("file"), 2), ["file", "doc"]).collect()
    want = [(r.doc_id, len(library.encode(r.text or ""))) for r in odd_docs.collect()]
    assert sorted(map(repr, want)) == sorted(repr((r["key"], r.n_tokens)) for r in rows)
    none = tokenfiles.write_files(no_docs, MODEL, f"file://{tmp_path}/b")
    assert tokenfiles.token_counts(none.select("file"), 2).count() == 0
