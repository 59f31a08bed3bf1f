"""Quartile bucket digests of documents.

A text's UTF-8 byte triplets are hashed into ``BUCKETS`` buckets and counted;
each bucket's count is encoded in two bits as its place among the quartiles of
the counts, after one byte for the length (its logarithm).  Two digests differ by
the sum of their buckets' differences and their lengths' difference; the sum
is bounded at what unrelated texts reach and scaled to a likeness of 0 to 1.

Null text is empty; an empty text has a digest too (all zero).  Texts are read
whole.  Rows of equal id are ordered by text, null ids after all others; a
single row's next document is itself; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import even_labels, longs, map_texts, text_batches

BUCKETS = 1024
#: Mean difference of two independent codes of 0..3, per bucket.
UNRELATED = 1.25
#: Length bytes are steps of this many to a factor of e; a step counts as so many code steps.
LENGTH_STEPS, LENGTH_WEIGHT = 16, 2
_TABLES = np.random.default_rng(2024).integers(0, BUCKETS, (3, 256)).astype(np.uint16)
_QUARTILES = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]


def digest(text: str) -> np.ndarray:
    """Length byte and ``BUCKETS`` codes of 0..3, as unsigned bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if len(data) > 2:
        a, b, c = _TABLES
        counts = np.bincount(a[data[:-2]] ^ b[data[1:-1]] ^ c[data[2:]], minlength=BUCKETS)
    low, mid, high = np.sort(counts)[_QUARTILES]
    out = np.empty(BUCKETS + 1, dtype=np.uint8)
    out[0] = min(255, int(LENGTH_STEPS * math.log(len(data) + 1)))
    out[1:] = (counts > low).view(np.uint8) + (counts > mid).view(np.uint8) + (counts > high).view(np.uint8)
    return out


def to_hex(codes: np.ndarray) -> str:
    """Two hex digits of length, then four codes to a byte."""
    quads = codes[1:].reshape(-1, 4) << np.array([6, 4, 2, 0], dtype=np.uint8)
    return bytes([codes[0]]).hex() + np.bitwise_or.reduce(quads, axis=1).astype(np.uint8).tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """1 for equal digests, 0 from the bound on."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16))
    score = int(apart[1:].sum()) + LENGTH_WEIGHT * int(apart[0])
    return max(0.0, 1.0 - score / (UNRELATED * BUCKETS))


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id and ``fingerprint``."""

    def rows(part, texts):
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([to_hex(digest(t)) for t in texts], pa.string())], ["id", "f"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_texts(df.select(id_column, text_column), text_column, rows, f"`{id_column}` {kind}, fingerprint string")


def with_following(df: DataFrame, rows_per_bucket: int = 4000) -> DataFrame:
    """(doc_id, text) rows in buckets of falling id, each bucket followed by
    the first rows of the next one: ``bucket, guest, key, text``.

    Bucket bounds are quantiles of the ids alone, so every text is shuffled
    once, and each bucket goes to a task of its own.  The driver holds three
    numbers per bucket, no rows."""
    lowest = -(1 << 63)
    keys = df.select(F.coalesce("doc_id", F.lit(lowest)).alias("key"))
    count = keys.count()
    n = max(1, math.ceil(count / rows_per_bucket))
    bounds = sorted(set((keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None) or []), reverse=True)
    falling = np.array([-b - 1 for b in bounds], dtype=np.int64)  # ~b: rising as ids fall, without overflow

    @F.pandas_udf("int")
    def own_bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(falling, ~key.to_numpy(np.int64), side="right").astype(np.int32))

    tops = keys.groupBy(own_bucket("key").alias("bucket")).agg(F.max("key").alias("top")).orderBy("bucket").collect()
    # the first key of each bucket also closes the one before, which need not be
    # the bucket above if that is empty; the very first closes the last
    guest_of: dict[int, int] = {row.top: tops[i - 1].bucket for i, row in enumerate(tops)}
    tasks = max(1, len(tops))
    labels = even_labels(df.sparkSession, tasks)
    label = np.zeros(n + 1, dtype=np.int64)  # of each bucket
    for i, row in enumerate(tops):
        label[row.bucket] = labels[i]

    @F.pandas_udf("array<int>")
    def buckets(key: pd.Series) -> pd.Series:
        keys = key.to_numpy(np.int64)
        own = np.searchsorted(falling, ~keys, side="right")
        return pd.Series([[int(label[b]), int(label[guest_of[k]])] if k in guest_of else [int(label[b])] for b, k in zip(own, keys.tolist())])

    placed = df.select("doc_id", "text", F.coalesce("doc_id", F.lit(lowest)).alias("key")).withColumn("to", buckets("key"))
    dealt = placed.select("doc_id", "text", "key", F.posexplode("to").alias("guest", "bucket"))
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), F.xxhash64("text"), "text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_likeness(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last half of its
    code points replaced by the first as many of the next document's, in
    falling id; after the last comes the first.  Likeness of the text's
    fingerprint to the edited text's and to the next document's."""
    ordered = with_following(df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its next; a bucket's first guest closes it
        for batch in batches:
            for part, texts in text_batches(batch, "text"):
                out = []
                for doc_id, guest, text in zip(part.column("doc_id").to_pylist(), part.column("guest").to_pylist(), texts):
                    if guest and not held:
                        continue
                    codes = digest(text)
                    if held:
                        out.append(_compared(*held, text, codes))
                    held = None if guest else (doc_id, text, codes)
                if out:
                    yield _batch(out)

    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compared(doc_id, text, codes, following, following_codes):
    new = edited(text, following)
    new_codes = digest(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), to_hex(codes), to_hex(new_codes), likeness(codes, new_codes), likeness(codes, following_codes)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, sha, own, new, near_edited, near_next = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), longs(n), *(pa.array(x, pa.string()) for x in (sha, own, new)), *(pa.array(x, pa.float64()) for x in (near_edited, near_next))], [f"c{i}" for i in range(7)])
