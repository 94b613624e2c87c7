"""SentencePiece encoding and decoding through a table of distinct marked words.

A piece of the model may begin with white-space markers but never holds one after another
character, so no merge reaches across the left edge of a marked word. Neither does one reach
a line break, which no piece holds. A text is therefore cut at those edges, each distinct
word is segmented once per task, and its ids are put back by position.

The table is local to a task and bounded: a global one would shuffle every word of the corpus
to save a segmentation that takes less time than the shuffle. When it is full it is emptied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import keyed_text, portions

MARK = "▁"
TABLE_ENTRIES = 250_000
BATCH_BYTES = 4_000_000
_WORDS = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|\n|[^ {MARK}\n]+")


class PieceTable:
    """Exact encoder of one model; ``encode`` gives what the library gives, without end ids."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "a  ﬁＡ\t é \nb "
        self.prefix = " " if self.model.encode("a", out_type=str)[0].startswith(MARK) else ""
        if (any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
                or self.model.normalize(probe) != (self.prefix + probe).replace(" ", MARK)):
            raise ValueError("this model's pieces can cross the edges of marked words")
        self.lead = len(self.model.encode("\n"))
        self.entries = entries
        self.table: dict[str, list[int]] = {}

    def learn(self, words: set[str]) -> None:
        """Segment the words that the table lacks. A line break in front keeps the prefix marker apart."""
        missing = [w for w in words if w not in self.table]
        if len(self.table) + len(missing) > self.entries:
            self.table.clear()
            missing = list(words)
        found = self.model.encode(["\n" + w for w in missing], num_threads=1)
        self.table.update((w, ids[self.lead:]) for w, ids in zip(missing, found))

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [_WORDS.findall(self.prefix + t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        table, out = self.table, []
        for words in cut:
            ids: list[int] = []
            for word in words:
                ids += table[word]
            out.append(ids)
        return out


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
                  end: bool = True) -> DataFrame:
    """Per row of ``docs``: ``key``, ``ids`` (with the end id if ``end``) and ``decoded``, the text of those ids.

    Null and empty texts have the end id alone. Repeated rows and null keys are returned as
    they are; an empty table gives an empty one. ``model`` is a path that every executor reads.
    """
    schema = f"`{key}` long, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in portions(batches, BATCH_BYTES):
            pieces = pieces or PieceTable(model)
            tail = [pieces.model.eos_id()] if end else []
            ids = [x + tail for x in pieces.encode(batch.column("text").to_pylist())]
            decoded = [pieces.model.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                names=[key, "ids", "decoded"])

    return keyed_text(docs, key, text).mapInArrow(run, schema)
