import hashlib
import random

import pytest
import public_tokenizers
import sentencepiece

from riskloom.llm import pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_table_gives_what_the_library_gives(library):
    draw = random.Random(5)
    texts = ["".join(draw.choice(" \n\t▁aé😀ﬁb\x00 <s>0x") for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    table = pieces.PieceTable(MODEL, entries=50)  # emptied again and again
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        assert table.encode(part) == library.encode(part, num_threads=1)


def test_odd_rows(odd_docs, no_docs, library):
    rows = pieces.encode_decode(odd_docs, MODEL).collect()
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "") + [2]
        want.append((r.doc_id, ids, library.decode(ids)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rows)
    assert pieces.encode_decode(no_docs, MODEL).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_sentencepiece(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "") + [2]
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        assert got[r.doc_id] == (len(ids), *digest)
