"""Operator 13: phrases of two to five words that occur together more often than
their parts let expect, per language.

Texts are lowered (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into
words at spaces and tabs; f(phrase) counts its contiguous occurrences within
pieces.  Candidates have f >= ``least``.  With all a language's words n, a cut
of a candidate (a = f) into parts of frequencies l and r scores
floor(1000 * a * n / (l * r)); its lowest cut counts (ties: the shortest first
part).  Candidates inside a longer one that is as frequent are dropped, and the
first ``keep`` of each language by score, a and phrase are returned.

1. Summaries.  Every n-gram of one to five words has a hash; its upper bits name
   one of a power of two of hash partitions, so no partition has more than its
   share of distinct n-grams however often one occurs.  A task summarises blocks of
   hashes as (partition, mass, distinct hashes with their counts).  Each partition
   merges its summaries, one after the other, into one of Misra-Gries kind: if
   it has more entries than its capacity, the largest count beyond that is
   subtracted from all and what is not above zero goes.  The capacity is
   ``SLACK`` times the partition's mass divided by ``least``, and more than that
   mass divided by ``least``, so what is subtracted in all, at most mass / (capacity
   + 1), stays below ``least`` and every n-gram with f >= ``least`` survives.  The
   memory of a merge is the capacity and one buffer.
2. Exact counts.  The survivors whose count and subtracted sum reach ``least`` are
   bits in a filter of fixed size, which is all that is sent around.  The second
   pass over the texts counts the n-grams whose bit is set and whose shorter
   parts' bits are set, by their words themselves; Spark adds these counts up and
   keeps those of at least ``least``.  A bit too many costs a count, no result.

All parts of a candidate are at least as frequent as itself, so the second
pass has their counts, too.  Products are decimals of 38 digits.

Defined results: null and empty texts have no words; a null lang is 'und';
repeated rows count as often as they occur; texts of any length are read in
stretches that overlap by four words; a table without candidates gives no row;
extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.common import join_spread, text_batches
from basketry.session import materialize

LONGEST, LEAST, KEEP = 5, 100, 2000
#: Capacity of a summary, in times of its mass divided by ``least``.
SLACK = 4
#: Text read at once, hashes summarised together, entries merged together.
STRETCH, BLOCK, BUFFER = 4_000_000, 6_000_000, 2_000_000
#: 2^27 bits: 16 MB, however large the input.
FILTER_BITS = 27
#: At most so many hash partitions (as a power of two), and the bytes of text for one.
PARTITION_BITS, PARTITION_BYTES = 16, 2_000_000
#: Phrases whose counts a task adds up before it sends them.
PHRASES = 400_000
#: Parts of a language that are ranked on their own before they meet.
SALTS = 32
_PIECE = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TO_SPACE = bytes.maketrans(_PIECE, b" " * len(_PIECE))
_KIND = np.zeros(256, dtype=np.uint8)  # of a byte: part of a word, between words, between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[list(_PIECE)] = 2
_GAP = re.compile(rb"[ \t" + re.escape(_PIECE) + rb"]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a stretch of lowered text: ``ids`` into ``vocabulary``, and the
    number of the ``piece`` each is in.  The first ``seen`` words were counted
    with the stretch before."""

    def __init__(self, text: bytes, seen: int):
        found = text.translate(_TO_SPACE).split()
        number: dict[bytes, int] = {}
        self.ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
        self.vocabulary, self.seen = list(number), seen
        kind = _KIND[np.frombuffer(text, dtype=np.uint8)]
        word = kind == 0
        word[1:] &= kind[:-1] != 0
        self.start = np.flatnonzero(word)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]

    def hashes(self, lang: str) -> np.ndarray:
        """A hash of every entry of the vocabulary, other ones for another language."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary], dtype=np.uint64)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from here on are in one piece."""
        return self.piece[n - 1:] == self.piece[:len(self.piece) - n + 1]


def longer(shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their first n - 1 words and of their last one."""
    x = (shorter ^ (shorter >> np.uint64(29))) * _ODD + last
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(30))


def stretches(text: bytes, limit: int = STRETCH) -> Iterator[Words]:
    """``text`` in stretches of about ``limit`` bytes that end between words; each
    begins with the last LONGEST - 1 words of the one before."""
    text = text.translate(_LOWER)
    start, end, seen = 0, 0, 0
    while end < len(text):
        gap = _GAP.search(text, max(end + 1, start + limit))
        end = gap.start() if gap else len(text)
        words = Words(text[start:end], seen)
        if len(words.ids):
            yield words
            seen = min(LONGEST - 1, len(words.ids))
            start += int(words.start[len(words.ids) - seen])


def _by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for batch in batches:
        for part, texts in text_batches(batch, "text", STRETCH):
            by: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                by.setdefault(lang, []).append(text)
            for lang, of in by.items():
                for words in stretches("\n".join(of).encode()):
                    yield lang, words


# ---- summaries ----------------------------------------------------------------

def ngram_hashes(words: Words, lang: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams, for each n, that end in new words."""
    one = words.hashes(lang)[words.ids]
    h = one
    yield h[words.seen:]
    for n in range(2, LONGEST + 1):
        if len(one) < n:
            return
        h = longer(h[:-1], one[n - 1:])
        counted = words.whole(n)
        counted[:max(0, words.seen - n + 1)] = False
        yield h[counted]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each begins."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return x[at], at


def pack(prints: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit fingerprints and their counts."""
    steps = np.diff(prints.astype(np.uint32), prepend=np.uint32(0))
    planes = np.stack([steps, np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)]).view(np.uint8).reshape(2, -1, 4)
    return zstandard.ZstdCompressor(level=1).compress(planes.transpose(0, 2, 1).tobytes())


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(2, 4, -1)
    steps, counts = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32)[:, :, 0]
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


class Summary:
    """Misra-Gries counts of 32-bit fingerprints, at most ``capacity`` of them.
    No true count exceeds the one kept (none: 0) by more than ``subtracted``."""

    def __init__(self, capacity: int):
        self.capacity, self.subtracted = capacity, 0
        self.prints, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.held = [], 0

    def add(self, prints: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((prints, counts))
        self.held += len(prints)
        if self.held >= BUFFER:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        prints = np.concatenate([self.prints, *(p for p, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.held = [], 0
        order = np.argsort(prints, kind="stable")
        self.prints, at = runs(prints[order])
        self.counts = np.add.reduceat(counts[order], at) if len(at) else self.counts
        if len(self.counts) > self.capacity:
            least = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            above = self.counts > least
            self.prints, self.counts = self.prints[above], self.counts[above] - least
            self.subtracted += least

    def survivors(self, least: int) -> np.ndarray:
        """All fingerprints whose true count may be ``least``."""
        self.merge()
        return self.prints[self.counts + self.subtracted >= least]


def _summarised(docs: DataFrame, bits: int) -> DataFrame:
    """(part, mass, payload): per hash partition a row with its mass alone, and one
    with the fingerprints and counts, of every block."""
    shift = np.uint64(32 - bits)

    def flush(waiting: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(waiting)
        keys >>= shift
        keys.sort()
        distinct, at = runs(keys)
        counts = np.diff(at, append=len(keys))
        edges = np.searchsorted(distinct, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        spans = [(p, s, e) for p, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
        parts = [p for p, _, _ in spans]
        masses = [int(counts[s:e].sum()) for _, s, e in spans]
        payloads = [pack(distinct[s:e] & np.uint64(0xFFFFFFFF), counts[s:e]) for _, s, e in spans]
        empty = [None] * len(parts)
        return pa.RecordBatch.from_arrays([pa.array(parts * 2, pa.int32()), pa.array(masses + empty, pa.int64()), pa.array(empty + payloads, pa.binary())],
                                          names=["part", "mass", "payload"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for lang, words in _by_language(batches):
            for h in ngram_hashes(words, lang):
                waiting.append(h)
                held += len(h)
            if held >= BLOCK:
                yield flush(waiting)
                waiting, held = [], 0
        if held:
            yield flush(waiting)

    return docs.mapInArrow(run, "part int, mass bigint, payload binary")


def _merged(summaries: DataFrame, bits: int, least: int, filter_bits: int) -> DataFrame:
    """(part, bits): the filter's bits of every hash partition."""
    slice_bits = filter_bits - bits

    def told(part: int, summary: Summary) -> pa.RecordBatch:
        own = np.zeros(1 << slice_bits, dtype=np.uint8)
        own[(summary.survivors(least) >> np.uint64(32 - slice_bits)).astype(np.int64)] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["part", "bits"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None
        for batch in batches:
            for p, m, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "mass", "payload"))):
                if p != part:
                    if summary is not None:
                        yield told(part, summary)
                    part, mass, summary = p, 0, None
                if payload is None:  # a partition's masses come first
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(SLACK * mass // least + 1)
                summary.add(*unpack(payload))
        if summary is not None:
            yield told(part, summary)

    dealt = summaries.repartition("part").sortWithinPartitions("part", F.col("payload").isNotNull())
    return dealt.mapInArrow(run, "part int, bits binary")


def partition_bits(docs: DataFrame) -> int:
    """The number of hash partitions for texts of that size, as a power of two."""
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(PARTITION_BITS, max(6, int(length // PARTITION_BYTES).bit_length()))


def survivors_filter(docs: DataFrame, part_bits: int, least: int = LEAST, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """First pass: the packed bits, indexed by the upper ``filter_bits`` of an
    n-gram's hash, of all n-grams of ``docs`` (lang, text) that may occur
    ``least`` times."""
    bits = min(part_bits, filter_bits - 3)
    out = np.zeros(1 << (filter_bits - 3), dtype=np.uint8)
    width = 1 << (filter_bits - bits - 3)
    for row in _merged(_summarised(docs, bits), bits, least, filter_bits).collect():
        out[row.part * width:(row.part + 1) * width] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


# ---- exact counts -------------------------------------------------------------

def counted_phrases(words: Words, lang: str, bits: np.ndarray, filter_bits: int = FILTER_BITS) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(n, phrases, counts) of the n-grams whose bits, and whose parts' bits, are set."""

    def maybe(h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - filter_bits)).astype(np.int64)
        return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    one = words.hashes(lang)
    alive = maybe(one)[words.ids]
    h, one = one[words.ids], one[words.ids]
    counts = np.bincount(words.ids[words.seen:], minlength=len(words.vocabulary))
    told = np.flatnonzero((counts > 0) & maybe(words.hashes(lang)))
    yield 1, [words.vocabulary[i].decode() for i in told], counts[told]
    at, gram = np.flatnonzero(alive), words.ids
    for n in range(2, LONGEST + 1):
        # positions whose n words are in one piece and whose two shorter n-grams may be frequent
        at = at[(at + n <= len(words.ids))]
        at = at[alive[at + 1] & (words.piece[at + n - 1] == words.piece[at])]
        if not len(at):
            return
        h_at = longer(h[at], one[at + n - 1])
        passed = maybe(h_at)
        at, h_at = at[passed], h_at[passed]
        keys = gram[at] * len(words.vocabulary) + words.ids[at + n - 1]
        distinct, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = at + n - 1 >= words.seen
        counts = np.bincount(inverse[new], minlength=len(distinct))
        told = np.flatnonzero(counts)
        where = at[index[told]]
        rows = words.ids[where[:, None] + np.arange(n)].tolist() if len(told) else []
        yield n, [b" ".join([words.vocabulary[i] for i in row]).decode() for row in rows], counts[told]
        h, gram, alive = h.copy(), np.zeros(len(words.ids), np.int64), np.zeros(len(words.ids) + 1, bool)
        h[at], gram[at], alive[at] = h_at, inverse, True


def _pack_phrases(counts: dict[tuple[str, int], dict[str, int]], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, payload) for every part that the phrases' hashes name."""
    by: dict[int, list[str]] = {}
    for (lang, n), of in counts.items():
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        split: dict[int, list[str]] = {}
        for phrase, count in of.items():
            split.setdefault(xxhash.xxh3_64_intdigest(phrase, seed) % parts, []).append(f"{phrase}\n{count}")
        for part, lines in split.items():
            by.setdefault(part, []).append("\n".join([lang.replace("\\", "\\b").replace("\n", "\\n"), str(n), str(len(lines)), *lines]))
    for part, lines in by.items():
        yield part, zstandard.ZstdCompressor(level=1).compress("\n".join(lines).encode())


def _unpack_phrases(raw: bytes) -> Iterator[tuple[str, int, list[str], list[int]]]:
    lines = zstandard.ZstdDecompressor().decompress(raw).decode().split("\n")
    at = 0
    while at < len(lines):
        lang, n, size = lines[at].replace("\\n", "\n").replace("\\b", "\\"), int(lines[at + 1]), int(lines[at + 2])
        at += 3 + 2 * size
        yield lang, n, lines[at - 2 * size:at:2], list(map(int, lines[at + 1 - 2 * size:at:2]))


def frequent_phrases(docs: DataFrame, bits: np.ndarray, part_bits: int, least: int = LEAST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Second pass: (lang, n, phrase, f) of all phrases with f >= ``least``; and
    with n = 0 and an empty phrase, each language's number of words.

    Tasks add up what they count before they pack it by the phrases' hashes; a
    part of that holds at most its share of the phrases that may be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    parts = 1 << part_bits

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            packed = list(_pack_phrases(sums, parts))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names=["part", "payload"])

        bits, sums, held = shared.value, {}, 0
        for lang, words in _by_language(batches):
            size = len(words.ids) - words.seen
            for n, phrases, counts in [(0, [""], np.array([size])), *counted_phrases(words, lang, bits, filter_bits)]:
                of = sums.setdefault((lang, n), {})
                held -= len(of)
                for phrase, c in zip(phrases, counts.tolist()):
                    of[phrase] = of.get(phrase, 0) + c
                held += len(of)
            if held >= PHRASES:
                yield flush()
                held = 0
        if sums:
            yield flush()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for (lang, n), of in sums.items():
                kept = [(p, c) for p, c in of.items() if c >= least or n == 0]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array([n] * len(kept), pa.int32()), pa.array([p for p, _ in kept], pa.string()),
                                                      pa.array([c for _, c in kept], pa.int64())], names=["lang", "n", "phrase", "f"])

        part, sums = None, {}
        for batch in batches:
            for p, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "payload"))):
                if p != part:
                    yield from told()
                    part, sums = p, {}
                for lang, n, phrases, counts in _unpack_phrases(payload):
                    of = sums.setdefault((lang, n), {})
                    for phrase, c in zip(phrases, counts):
                        of[phrase] = of.get(phrase, 0) + c
        yield from told()

    packed = docs.mapInArrow(count, "part int, payload binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(add, "lang string, n int, phrase string, f bigint")


# ---- scores -------------------------------------------------------------------

def _words(first, count):
    return F.array_join(F.slice("w", first, count), " ")


def mine(docs: DataFrame, least: int = LEAST, keep: int = KEEP, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``keep`` best collocations of each
    language of ``docs`` (text, lang)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    part_bits = partition_bits(texts)
    bits = survivors_filter(texts, part_bits, least, filter_bits)
    found = materialize(frequent_phrases(texts, bits, part_bits, least, filter_bits), "phrases")
    # a language's total meets its phrases where they lie if it has many of them
    sizes = found.groupBy("lang").agg(F.max(F.when(F.col("n") == 0, F.col("f"))).alias("total"), F.count(F.when(F.col("n") >= 2, 1)).alias("weight"))
    part = found.where("n between 1 and 4").select("lang", "phrase", "f")
    many = found.where("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    whole = join_spread(many, sizes, ["lang"], "weight", many.count(), "inner")
    # A longer candidate as frequent as a shorter one inside it has, by one word
    # more than the shorter, a candidate between them that is as frequent.
    inside = whole.where("n >= 3").select("lang", F.explode(F.array(
        _words(F.lit(1), F.col("n") - 1), _words(F.lit(2), F.col("n") - 1))).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    alone = whole.join(inside, ["lang", "phrase"], "left").where("around is null or 100 * around < 100 * a").drop("around")
    cuts = alone.select("lang", "total", "phrase", "a", F.explode(F.expr("sequence(1, n - 1)")).alias("k"), "w", "n").select(
        "lang", "total", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("first"), _words(F.col("k") + 1, F.col("n") - F.col("k")).alias("rest"))
    left = part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "total", "l", "r")}
    scored = met.withColumn("above", (wide["a"] * wide["total"] * F.lit(1000)).cast("decimal(38,0)")).withColumn(
        "below", (wide["l"] * wide["r"]).cast("decimal(38,0)")).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("turn") <= keep)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= keep).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("total").alias("n"), F.col("cut.score").cast("bigint").alias("score"))
