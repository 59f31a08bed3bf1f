"""Best-fit-decreasing packing of token streams into windows.

Each document's ids and one separator id are cut into full windows and a rest.
Full windows stand alone; rests are dealt into shards of a bounded number of
pieces by a hash of the document, and each shard is packed by best-fit
decreasing: a segment tree indexed by remaining capacity finds the tightest
open window in O(log size).  With thousands of rests in a shard, the open
space left at its end is a small fraction of a window per shard.

Only piece sizes are shuffled, never ids.  Null text is empty and packs as the
separator alone; very long texts give many full windows; repeated rows are
packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ChunkTable, longs, map_texts, per_worker

#: Cuts of a text that the byte-level pattern makes in any case: before a
#: space or line feed after anything else, and after a run of Latin letters
#: and digits that no letter or digit follows.
CHUNKS = re.compile(r"[ \n]*(?:[A-Za-z0-9À-ÖØ-öø-ÿ]+(?!\w)|[^ \n]+)|[ \n]+").findall
#: White space other than space and line feed joins runs across those cuts.
ODD_SPACE = re.compile(r"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


#: The pattern that byte-level BPE files without one of their own cut by (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space or of other characters longer than this are left to the
#: library; the encoder by ranks takes time with the square of a run's length.
RUN = 256
SHORT_RUNS = re.compile(rf"\s{{0,{RUN}}}+(?:\S{{1,{RUN}}}+\s{{1,{RUN}}}+)*+\S{{0,{RUN}}}+").fullmatch
#: Long texts are coded in parts of about so many characters, cut before a space
#: after anything else, where the pattern cuts in any case.
PART_CHARS = 1 << 17
CUT = re.compile(r"(?<=\S) ").search


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    start = 0
    while len(text) - start > size and (cut := CUT(text, start + size)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def settled(c: str) -> bool:
    """Whether Unicode 3.2 and today's tables put a character in the same class,
    so that two libraries of different versions cut around it alike."""
    now = unicodedata.category(c)
    return c in "\t\n\r" or now not in ("Cc", "Cn") and now[0] == unicodedata.ucd_3_2_0.category(c)[0]


def _as_ranks(path: str):
    """The vocabulary of a byte-level BPE file as an encoder by ranks, which codes
    texts several times faster; None unless ids follow the merges' order,
    nothing else is done to a text, and so both give the same ids."""
    import tiktoken
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, cut = told["model"], told.get("pre_tokenizer") or {}
    vocabulary, merges = model["vocab"], model["merges"]
    joined = ("".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges)
    first = min((i for t, i in vocabulary.items() if len(t) > 1), default=0)
    if (told.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            or any(vocabulary[t] != first + i for i, t in enumerate(joined))):
        return None
    # printable bytes stand for themselves, the others in order for code points from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in added}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Little-endian unsigned 32-bit ids of whole texts by a byte-level BPE file.
    With ``added_tokens`` the strings of added tokens in a text become their
    ids, as the library does as loaded; else they are ordinary text."""

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        # strings that no cut may touch
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.table = ChunkTable(CHUNKS, self._encode)
        self.ranks = _as_ranks(path)
        self.settled: set[str] = set()

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_ranks(self, text: str) -> bytes | None:
        """None where the libraries' Unicode tables could differ, and for long runs."""
        if self.ranks is None or not SHORT_RUNS(text):
            return None
        if not text.isascii() or not text.isprintable():
            new = set(text) - self.settled
            if not all(map(settled, new)):
                return None
            self.settled |= new
        code = self.ranks.encode_ordinary
        return b"".join(array("I", code(p)).tobytes() for p in parts(text))

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out = list(map(self._by_ranks, chunks))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._encode_whole([chunks[i] for i in rest])):
            out[i] = x
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Whole texts by ranks; those that this leaves by the chunk table, or by
        the library if no chunk can be cut off safely."""
        out = [None if any(a in t for a in self.added) else self._by_ranks(t) for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        cut = [i for i in rest if not ODD_SPACE(texts[i]) and not any(a in texts[i] for a in self.added)]
        for i, found in zip(cut, self.table.lookup([texts[i] for i in cut])):
            out[i] = b"".join(found)
        for i in rest:
            if out[i] is None:
                out[i] = self._encode_whole([texts[i]])[0]
        return out


class CapacityTree:
    """Open windows by remaining capacity 0..size; finds the least capacity
    of at least ``need`` that some window has."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        if len(self.windows[capacity]) == 1:
            self._touch(capacity, 1)

    def _touch(self, capacity: int, by: int) -> None:
        node = capacity + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """Least open capacity >= need."""
        node = need + self.width
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.width:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.width

    def take(self, capacity: int) -> int:
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self._touch(capacity, -1)
        return window


class Packer:
    """Places pieces, longest first, each in the tightest open window."""

    def __init__(self, size: int):
        self.size, self.tree, self.opened = size, CapacityTree(size), 0

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset of the next piece of 1..size tokens."""
        room = self.tree.tightest(length)
        if room is None:
            window, room = self.opened, self.size
            self.opened += 1
        else:
            window = self.tree.take(room)
        if room > length:
            self.tree.add(room - length, window)
        return window, self.size - room


def pieces(df: DataFrame, tokenizer_path: str, size: int = 1024, separator: int = 0,
           id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Per piece: document, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens`` and, if asked for, the piece's ``ids array<int>``;
    ``added_tokens`` as in ``Tokens``."""
    end = np.array([separator], dtype="<u4").tobytes()

    def rows(part, texts):
        coded = [c + end for c in per_worker(("tokens", tokenizer_path, added_tokens), lambda: Tokens(tokenizer_path, added_tokens)).ids(texts)]
        source, start, crc, ids = [], [], [], []
        for i, c in enumerate(coded):
            for s in range(0, len(c), 4 * size):
                source.append(i)
                start.append(s // 4)
                crc.append(zlib.crc32(c[s:s + 4 * size]))
                if with_ids:
                    ids.append(np.frombuffer(c[s:s + 4 * size], dtype="<u4").astype(np.int32))
        total = np.array([len(c) // 4 for c in coded], dtype=np.int64)[source]
        start = np.array(start, dtype=np.int64)
        columns = [part.column(0).take(pa.array(source, pa.int64())), longs(start), longs(np.minimum(total - start, size)), longs(crc), longs(total)]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, [f"c{i}" for i in range(5 + with_ids)])

    return map_texts(df.select(F.col(id_column).cast("bigint").alias("doc_id"), text_column), text_column, rows, PIECE_SCHEMA + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, size: int = 1024, shards: int = 16) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1..size tokens.
    Pieces of a document's hash share a shard; ``shards`` grows with the
    number of pieces (``shard_count``)."""
    schema = pieces.schema
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))
    order = ["shard", F.desc("length"), "doc_id", "start", "ids_crc32"]
    placed = pieces.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition holds whole shards, one after the other, longest piece first
        packer, current = Packer(size), None
        for batch in batches:
            window_of, offset = [], []
            for s, n in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist()):
                if s != current:
                    packer, current = Packer(size), s
                window, at = packer.place(n)
                window_of.append((s << 40) + window)
                offset.append(at)
            keep = [batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(keep + [longs(window_of), longs(offset)], [*schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return placed.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def shard_count(pieces: int, per_shard: int = 30_000) -> int:
    """Shards for so many pieces."""
    return max(1, math.ceil(pieces / per_shard))


def sequences(packed: DataFrame, size: int = 1024, pad: int = 0) -> DataFrame:
    """Packed pieces with ids as training sequences: ``sequence_id``, ``ids``
    padded to ``size`` except where they already number a power of two, and
    ``documents`` (document, start, offset, length) in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    short = F.when(F.bit_count(F.size(ids)) == 1, F.lit(0)).otherwise(F.lit(size) - F.size(ids))
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), short)).alias("ids"), F.transform("parts", lambda p: F.struct(p.doc_id.alias("doc_id"), p.start.alias("start"), p.offset.alias("offset"), p.length.alias("length"))).alias("documents"))
