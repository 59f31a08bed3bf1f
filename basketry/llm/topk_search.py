"""Exact top-k inner-product search by a three-phase uniform threshold.

Components become integers floor(scale * x).  A vector's dimensions are cut
into ``slices``; a (query, vector) pair has one partial score per slice and
its score is their sum.

1. Gather: every block of vectors gives, for each query, the best entries of
   each slice's score list with their whole scores.  The k-th best score
   gathered for a query over all blocks is a cutoff that the true k-th best
   cannot fall below.
2. Cut off: the cutoff goes to every block.  A vector whose partial scores all
   lie below cutoff / slices scores less than the cutoff, so only entries with
   some partial score at or above it are collected.
3. Resolve: the remaining partial scores of those entries are added, entries
   below the cutoff go, and the k best of the rest are exact.

Queries and vectors are both packed into blocks of bounded size, and a query
block meets a vector block as one pair of matrices; no row pairs are formed
and nothing is collected to the driver.

Vectors that are null or hold a null or non-finite component, and rows without
an id, take no part.  Shorter vectors count as padded with zeros.  Equal
scores go to the smaller id; repeated rows count as often as they occur; a
query never finds its own id.  Other columns are ignored; an empty table gives
an empty result.  Quantised components saturate at +-2^31 and scores are exact
64-bit integers while dimension * 2^62 is not reached by the values at hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.session import materialize

QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
EDGE = float(1 << 31)


def quantised(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, q): the vectors that take part, as integers."""
    x = F.transform(F.col(vector_column), lambda v: v.cast("double") * scale)
    whole = df.select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    return whole.select("vec_id", F.transform("x", lambda v: F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(v).cast("double"))).cast("bigint")).alias("q"))


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """One row per at most ``rows`` vectors of a partition: a block number,
    the ids and the matrix as little-endian integers, row by row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = [], []

        def packed():
            width = max(map(len, lists), default=0)
            matrix = np.zeros((len(lists), width), dtype="<i8")
            for row, x in zip(matrix, lists):
                row[:len(x)] = x
            small = matrix.astype("<i2") if np.abs(matrix).max(initial=0) < 1 << 15 else matrix
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary()), pa.array([small.itemsize], pa.int32())], ["ids", "matrix", "item"])

        for batch in batches:
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("q").to_pylist()):
                ids.append(i)
                lists.append(x)
                if len(ids) == rows:
                    yield packed()
                    ids, lists = [], []
        if ids:
            yield packed()

    packed = vectors.mapInArrow(run, "ids binary, matrix binary, item int")
    return packed.select(*(F.col(c).alias(f"{name}_{c}") for c in packed.columns))


def _unpack(batch: pa.RecordBatch, i: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    value = lambda c: batch.column(f"{name}_{c}")[i].as_py()
    ids = np.frombuffer(value("ids"), "<i8")
    return ids, np.frombuffer(value("matrix"), "<i2" if value("item") == 2 else "<i8").reshape(len(ids), -1)


def _partials(queries: np.ndarray, vectors: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial scores of each slice: one queries x vectors matrix per slice."""
    width = min(queries.shape[1], vectors.shape[1])  # beyond it one side is zero
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(width, 1)
    kind = np.float64 if reach < 1 << 53 else np.int64  # floating products are exact below 2^53
    edges = np.linspace(0, width, slices + 1).astype(int)
    return [queries[:, a:b].astype(kind) @ vectors[:, a:b].astype(kind).T for a, b in zip(edges, edges[1:])]


def _pairs(batches: Iterable[pa.RecordBatch], slices: int, vectors_per_step: int = 2048):
    """(batch, row, query ids, vector ids, own, partial scores) of block
    pairs, a bounded number of vectors at a time; own marks pairs of equal id."""
    for batch in batches:
        for i in range(batch.num_rows):
            query_ids, queries = _unpack(batch, i, "query")
            vector_ids, vectors = _unpack(batch, i, "vector")
            for a in range(0, len(vector_ids), vectors_per_step):
                ids = vector_ids[a:a + vectors_per_step]
                yield batch, i, query_ids, ids, query_ids[:, None] == ids[None, :], _partials(queries, vectors[a:a + vectors_per_step], slices)


def _rows(query_ids, vector_ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(vector_ids), pa.array(scores.astype(np.int64))], ["query_id", "vec_id", "score"])


ENTRY = "query_id bigint, vec_id bigint, score bigint"


def _best(entries: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, slices: int = 4) -> DataFrame:
    """``queries`` and ``vectors`` are (vec_id, q) rows.  Per query id its k best
    vectors of another id: ``query_id, rank, vec_id, score``; a query repeated
    with the same vector counts once."""
    queries = queries.dropDuplicates(["vec_id", "q"])
    spread = max(1, -(-queries.count() // QUERY_BLOCK))
    # written once, so that both passes see the same blocks whatever is lost between them
    query_blocks = materialize(blocks(queries.repartition(spread, "vec_id"), QUERY_BLOCK, "query").withColumn("query_block", F.monotonically_increasing_id()), "query-blocks")
    vector_blocks = materialize(blocks(vectors, VECTOR_BLOCK, "vector").withColumn("vector_block", F.monotonically_increasing_id()), "vector-blocks")
    # every query block meets every vector block: a stated query set against all rows, in blocks
    met = vector_blocks.select("vector_block").join(query_blocks.select("query_block"))

    def pairs(queries: DataFrame) -> DataFrame:
        return met.join(queries, "query_block").join(vector_blocks, "vector_block").repartition("vector_block", "query_block")

    def gather(batches):
        for _, _, query_ids, ids, own, parts in _pairs(batches, slices):
            total = sum(parts)
            chosen = np.zeros(total.shape, dtype=bool)
            lead = min(k, len(ids))
            for part in parts:
                listed = np.where(own, -np.inf, part.astype(np.float64))
                np.put_along_axis(chosen, np.argpartition(listed, len(ids) - lead, axis=1)[:, len(ids) - lead:], True, axis=1)
            q, v = np.nonzero(chosen & ~own)
            # of a block's lists no more than the k best whole scores can matter
            order = np.lexsort((ids[v], -total[q, v], q))
            q, v = q[order], v[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, v = q[rank < k], v[rank < k]
            yield _rows(query_ids[q], ids[v], total[q, v])

    gathered = _best(pairs(query_blocks).mapInArrow(gather, ENTRY), k)
    cutoffs = gathered.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("cutoff"))

    def resolve(batches):
        for batch, i, query_ids, ids, own, parts in _pairs(batches, slices):
            known = batch.column("cutoffs")[i].as_py() or []
            by_query = {x["query_id"]: x["cutoff"] for x in known if x["cutoff"] is not None}
            cutoff = np.array([by_query.get(int(q), -np.inf) for q in query_ids], dtype=np.float64)[:, None]
            reached = parts[0] * len(parts) >= cutoff
            for part in parts[1:]:
                reached |= part * len(parts) >= cutoff
            q, v = np.nonzero(reached & ~own)
            score = sum(part[q, v] for part in parts)
            kept = score >= cutoff[q, 0]
            yield _rows(query_ids[q[kept]], ids[v[kept]], score[kept])

    # a block's cutoffs travel as one row beside its matrix, one per query at most
    members = query_blocks.select("query_block", "query_ids").mapInArrow(_members, "query_block bigint, query_id bigint")
    told = members.join(cutoffs, "query_id").groupBy("query_block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs"))
    best = _best(pairs(query_blocks.join(told, "query_block", "left")).mapInArrow(resolve, ENTRY), k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, packed in zip(batch.column("query_block").to_pylist(), batch.column("query_ids").to_pylist()):
            ids = np.unique(np.frombuffer(packed, "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(ids)], ["query_block", "query_id"])
