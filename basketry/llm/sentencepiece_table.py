"""SentencePiece encoding and decoding with a table of distinct chunks.

In the vocabulary no piece holds a character before a white space marker, and
none holds a line feed, so a text may be cut before every run of markers and
around every line feed: no merge crosses such a cut.  Each distinct chunk
("marked word") is segmented once in a worker and its ids are joined back by
position.  Whether the cuts hold is read from the model when it is loaded; a
model with crossing pieces is refused.

The table lives in the worker, not in a shuffle: a shuffle of every
(document, position, word) row would move several times the input.

Null text is treated as empty: no ids, an empty decoded text.  Texts of any
length are processed whole, repeated rows give repeated results, other columns
of the input are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.common import ChunkTable, longs, map_texts, per_worker

MARKER = "▁"
#: Chunks of a text whose markers are written as spaces.
CHUNKS = re.compile(r" *[^ \n]+| +|\n").findall


class ChunkCodec:
    """Encodes and decodes whole texts by distinct chunks."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any("\n" in p or re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces):
            raise ValueError("the model has pieces that cross white space markers")
        # encode() puts a marker before each text; a line feed shields the chunk from it
        self.lead = len(sp.encode("\n"))
        self.feed = sp.encode("\n")[1:]
        self.table = ChunkTable(self._split, self._encode)

    @staticmethod
    def _split(text: str) -> list[str]:
        return CHUNKS(" " + text.replace(MARKER, " ")) if text else []

    def _encode(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        coded = self.sp.encode(["\n" + c for c in chunks], num_threads=1)
        ids = [c[self.lead:] for c in coded]
        decoded = self.sp.decode([self.feed + i for i in ids], num_threads=1)
        return [(len(i), ",".join(map(str, i)), c if d[1:] == c else d[1:]) for c, i, d in zip(chunks, ids, decoded)]

    def rows(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, ids as decimals joined by commas, decoded text."""
        out = []
        for found in self.table.lookup(texts):
            n, ids, text = zip(*found) if found else ((), (), ())
            out.append((sum(n), ",".join(ids), "".join(text)[1:]))
        return out


def _codec(model_path: str) -> ChunkCodec:
    return per_worker(("sentencepiece", model_path), lambda: ChunkCodec(model_path))


def encode(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``ids array<int>``, ``decoded`` text."""

    def rows(part, texts):
        coded = _codec(model_path).rows(texts)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([[int(x) for x in c[1].split(",")] if c[0] else [] for c in coded], pa.list_(pa.int32())), pa.array([c[2] for c in coded], pa.string())], ["id", "ids", "decoded"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_texts(df.select(id_column, text_column), text_column, rows, f"`{id_column}` {kind}, ids array<int>, decoded string")


def encode_digests(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by
    commas, ``decoded_sha256`` of the decoded text; the ids themselves do not
    leave the task."""

    def rows(part, texts):
        coded = _codec(model_path).rows(texts)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return pa.RecordBatch.from_arrays([part.column(0), longs([c[0] for c in coded]), pa.array([sha(c[1]) for c in coded], pa.string()), pa.array([sha(c[2]) for c in coded], pa.string())], ["id", "n", "i", "d"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_texts(df.select(id_column, text_column), text_column, rows, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
