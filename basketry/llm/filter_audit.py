"""Operator 12: what each filter of a set removes, keeps for others and repeats,
for every order the filters may run in.

Method (min-plus removal ranks): a document's failed filters are a row of a mask
matrix, 0 where it fails and infinite elsewhere; an order of the filters is a
column of positions (the inverse permutation).  Their min-plus product is the
step at which that order removes the document: the smallest position of a
failed filter.  Documents with equal masks go alike, so the product is taken
over the distinct masks (32 at most) of a part and 120 orders; the removal
steps then say where each mask's weights (documents, good, toxic ones) are
added up, and which later filters would have failed it too.

The five filters of ``FILTERS`` look at whole texts; words are runs of other
bytes than ASCII white space.  E looks at the whole table: a digest of every
text meets the smallest doc_id that has it.  Only digests, ids and masks are
shuffled.  Rows are counted by (doc_id, part, mask) before they meet the labels.

Defined results: null texts are empty (and equal to empty ones); a null lang is
the part ''; a null doc_id is neither smaller nor larger than another and has
no label; rows that repeat a doc_id are documents of their own and pass E
where no smaller doc_id has their text; a doc_id with several labels is good
(toxic) if any of them says so; an empty table gives no row.  Extra columns are
not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import join_spread, map_texts
from basketry.session import materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
_UPPER = bytes(range(65, 91))
_LATER = bytes(range(0x80, 0xC0))  # all but the first byte of a code point
_MARKS = re.compile(rb"[#$%&*|]")
_GAP = re.compile(rb"[ \t-\r]")
_STRETCH = 1_000_000


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of about a megabyte at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _STRETCH)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def content_mask(text: bytes) -> int:
    """Bits 0 to 3: whether the text fails A, B, C, D."""
    words, distinct = 0, set()
    for found in _stretches(text):
        words += len(found)
        distinct.update(found)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _LATER))
    return ((words < MIN_WORDS) | (100 * len(distinct) < DISTINCT_PERCENT * words) << 1
            | (100 * upper > UPPER_PERCENT * points) << 2 | bool(_MARKS.search(text)) << 3)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, text, lang): bit i is
    set if it fails filter i of ``FILTERS``."""

    def rows(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        raw = [t.encode() for t in texts]
        return pa.RecordBatch.from_arrays([
            part.column("doc_id"), pc.fill_null(part.column("part"), ""),
            pa.array([content_mask(t) for t in raw], pa.int32()),
            pa.array([blake2b(t, digest_size=16).digest() for t in raw], pa.binary())], names=["doc_id", "part", "mask", "digest"])

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("part"), "text")
    seen = materialize(map_texts(plain, "text", rows, "doc_id bigint, part string, mask int, digest binary"), "filter-masks")
    copies = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = join_spread(seen, copies, ["digest"], "n", seen.count())
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return met.select("doc_id", "part", F.when(repeated, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def weigh(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents have the mask, and how many
    of them ``labels`` (doc_id, quality, toxic) marks."""
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        *(F.max(F.coalesce((F.col(of) == 1).cast("int"), F.lit(0))).alias(name) for of, name in (("quality", "good"), ("toxic", "toxic"))))
    counted = found.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    return counted.join(marked, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(name, F.lit(0))).alias(name) for name in ("good", "toxic")))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
ORDERS = np.array(list(permutations(range(len(FILTERS)))))  # order -> its filters
POSITIONS = np.argsort(ORDERS, axis=1).T                    # filter -> its position in each order


def removal_steps(mask: np.ndarray) -> np.ndarray:
    """Min-plus product of the masks' rows and the orders' positions: the position
    (from 0) of the filter that removes each mask in each order, or one past
    the last if none does."""
    size = len(FILTERS)
    fails = mask[:, None] >> np.arange(size) & 1
    cost = np.where(fails, 0, size)
    return np.minimum((cost[:, :, None] + POSITIONS[None]).min(axis=1), size)


def tabulate(mask: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` by (order, step) for masks with ``weights`` (documents, good, toxic)."""
    size = len(FILTERS)
    removal = removal_steps(mask)
    lost = np.zeros((3, len(ORDERS), size + 1), dtype=np.int64)
    for kind, weight in zip(lost, weights):
        np.add.at(kind, (np.arange(len(ORDERS)), removal), np.broadcast_to(weight[:, None], removal.shape))
    lost = lost[:, :, :size]
    n, fails = weights[0], mask[:, None] >> np.arange(size) & 1
    removed = lost[0]
    earlier = removal[:, :, None] < np.arange(size)        # mask, order, step
    redundant = np.einsum("m,mos,mos->os", n, earlier, fails[:, ORDERS])
    alone = np.array([n[mask == 1 << f].sum() for f in range(size)])
    shapley = np.zeros(size, dtype=np.int64)
    np.add.at(shapley, ORDERS, removed)
    return {"kept": n.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": redundant, "unique_fails": alone[ORDERS],
            "good_lost": lost[1], "toxic_lost": lost[2], "shapley": shapley[ORDERS]}


def audit(weighed: DataFrame) -> DataFrame:
    """Per part of ``weighed``, order and step (from 1): ``COUNTS``.  A group has one
    row a mask, 32 at most."""

    def one_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = tabulate(rows["mask"].to_numpy(), rows[["n", "good", "toxic"]].to_numpy(dtype=np.int64).T)
        size = len(FILTERS)
        return pd.DataFrame({
            "part": key[0], "filter_order": np.repeat(["".join(FILTERS[f] for f in o) for o in ORDERS], size),
            "step": np.tile(np.arange(1, size + 1, dtype=np.int32), len(ORDERS)), **{c: counts[c].ravel() for c in COUNTS}})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return weighed.groupBy("part").applyInPandas(one_part, schema)
