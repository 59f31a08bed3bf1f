"""Operator 11: near-duplicate vectors by an exact metric range join.

Two vectors link if their labels are equal and their cosine, in double
precision, is at least ``least``.  The angle between vectors is a metric, so:

1. Equal vectors of a label become one row with a number of copies.
2. Every label with enough rows gets pivots, a sample of its vectors; a vector
   belongs to the cell of its nearest pivot.  Their number is bounded by bytes
   over all labels (``PIVOT_BYTES``), each label getting its share; labels too
   small for a share are one cell.
3. With range r = arccos(least), cell radius R and angles t, the triangle
   inequality says that a vector u of cell q can link into cell p only if
   t(u, p) <= t(u, q) + 2 r and t(u, p) <= R(p) + r.  Where both hold, u is
   replicated to p.
4. Cells are joined independently.  A cell's own rows and its replicas are cut
   into chunks of ``CHUNK_BYTES`` by hash, and each pair of chunks is a task
   of its own, so neither a hot label nor a dense cell meets in one place.  A
   task compares tiles whose angles to the pivot differ by r at most.

A task returns a number of links per own row and, for components, an edge from
each linked row to the smallest linked row of the task, never pairs: what
leaves a task grows with its rows, not with the links between them.  Copies
link to one another, since the cosine of a vector with itself is 1.

Vectors that are null, zero, empty or hold null or non-finite components link
with nothing; so do rows with a null label or null id, and vectors of different
lengths.  Rows that repeat an id are vectors of their own.  Pairs within 1e-12
of the bound are decided on exactly rounded sums.  An empty table gives no row.
Vectors are scaled by a power of two before they are squared, so that large
and small components neither overflow nor vanish.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import join_spread
from basketry.llm.components import components
from basketry.session import materialize

LEAST = 0.93
#: All pivots together.
PIVOT_BYTES = 8_000_000
#: Rows of a label that one pivot stands for.
CELL_ROWS = 1024
#: Vectors of one side of a task.
CHUNK_BYTES = 4_000_000
TILE = 1024
_EDGE = 1e-9  # angles are rounded; replicate a little more than needed


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def stacked(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles of similar size."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, 1))
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class Linked:
    """Sets of linked rows; a row's label is the smallest row of its set so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.label, up := self.label[self.label]):
                self.label = up


def _links(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    cos = x @ y.T / (nx[:, None] * ny[None])
    for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):
        dot, a, b = (math.fsum(u * v) for u, v in ((x[i], y[j]), (x[i], x[i]), (y[j], y[j])))
        cos[i, j] = dot / math.sqrt(a * b)
    return cos >= least


def join_tiles(left: np.ndarray, right: np.ndarray | None, left_angle: np.ndarray, right_angle: np.ndarray | None,
               left_copies: np.ndarray, right_copies: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each left row and each right row with rows of the other side (with
    the same side, but itself, if ``right`` is None), and the smallest row,
    left ones first, of each row's linked set."""
    same = right is None
    if same:
        right, right_angle, right_copies = left, left_angle, left_copies
    order, other = np.argsort(left_angle, kind="stable"), np.argsort(right_angle, kind="stable")
    sorted_angle = right_angle[other]
    reach = math.acos(least) + _EDGE
    nl, nr = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    of_left, of_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    sets = Linked(len(left) if same else len(left) + len(right))
    for s in range(0, len(order), TILE):
        i = order[s:s + TILE]
        first = np.searchsorted(sorted_angle, left_angle[i[0]] - reach, "left")
        last = np.searchsorted(sorted_angle, left_angle[i[-1]] + reach, "right")
        for t in range(first, last, TILE):
            j = other[t:min(t + TILE, last)]
            linked = _links(left[i], right[j], nl[i], nr[j], least)
            if same:
                linked[i[:, None] == j[None]] = False
            of_left[i] += linked @ right_copies[j]
            if not same:
                of_right[j] += left_copies[i] @ linked
            a, b = np.nonzero(linked)
            sets.join(i[a], j[b] if same else len(left) + j[b])
    return of_left, of_right, sets.label




def _placed(groups: DataFrame, pivots: dict, reach: float, radii: dict | None) -> DataFrame:
    """Each row in its own cell and, if ``radii`` are known, in those that it is
    replicated to: adds (cell, angle to the cell's pivot, own)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = list(zip(batch.column("label").to_pylist(), batch.column("dims").to_pylist()))
            for space in set(spaces):
                at = np.array([k for k, s in enumerate(spaces) if s == space])
                part = batch.take(pa.array(at))
                if (of := pivots.get(space)) is None:
                    row, cell, angle, own = np.arange(len(at)), np.zeros(len(at), int), np.zeros(len(at)), np.ones(len(at), bool)
                else:
                    t = angles(units(stacked(part.column("v"))), of)
                    nearest = t.argmin(axis=1)
                    least = t[np.arange(len(t)), nearest]
                    there = np.zeros(t.shape, bool)
                    if radii is not None:
                        widest = np.array([radii.get((*space, c), -math.inf) for c in range(len(of))])
                        there = (t <= least[:, None] + 2 * reach + _EDGE) & (t <= widest + reach + _EDGE)
                    there[np.arange(len(t)), nearest] = True
                    row, cell = np.nonzero(there)
                    angle, own = t[row, cell], nearest[row] == cell
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int32()), pa.array(angle), pa.array(own)],
                                                 names=[*out.schema.names, "cell", "angle", "own"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema) + ", cell int, angle double, own boolean"
    return groups.mapInArrow(run, schema)


def choose_pivots(groups: DataFrame, cell_rows: int = CELL_ROWS, budget_bytes: int = PIVOT_BYTES) -> dict:
    """{(label, dims): unit pivots}, a sample of the vectors of each label with at
    least two cells' rows, ``budget_bytes`` in all."""
    sizes = groups.groupBy("label", "dims").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n"), F.max("dims")).first()
    if not total[0]:
        return {}
    budget = max(2, budget_bytes // (8 * total[1]))
    share = F.least(F.ceil(F.col("n") / cell_rows), F.floor(F.col("n") * budget / total[0]))
    # a share of two or more is n * budget >= 2 * total: fewer than ``budget`` labels
    large = sizes.withColumn("share", share).where("share >= 2").select("label", "dims", (F.col("share") / F.col("n")).alias("part"))
    draw = F.pmod(F.xxhash64(F.lit(11), "v"), F.lit(1 << 30)) / float(1 << 30)
    drawn = groups.join(F.broadcast(large), ["label", "dims"]).where(draw < F.col("part"))
    chosen = drawn.select("label", "dims", "v").orderBy(F.xxhash64(F.lit(11), "v"), "v").limit(2 * budget).collect()
    found: dict = {}
    for label, dims, v in chosen:
        found.setdefault((label, dims), []).append(v)
    return {space: units(np.ldexp(x := np.array(v, float), -np.frexp(np.abs(x).max(axis=1))[1][:, None])) for space, v in found.items()}


def link_counts(groups: DataFrame, least: float = LEAST, cell_rows: int = CELL_ROWS, budget_bytes: int = PIVOT_BYTES,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(gid, links, root) for ``groups`` (gid, label, dims, v, copies), several rows
    a gid: add the links up; roots are edges to a smaller gid of the component."""
    reach = math.acos(least)
    pivots = choose_pivots(groups, cell_rows, budget_bytes)
    spaces = groups.sparkSession.createDataFrame(
        [(*s,) for s in pivots] or [], groups.select("label", "dims").schema)
    # radii of pivots' cells only, so no more rows than pivots
    wide = _placed(groups, pivots, reach, None).join(F.broadcast(spaces), ["label", "dims"], "left_semi").groupBy("label", "dims", "cell")
    radii = {(r[0], r[1], r[2]): r[3] for r in wide.agg(F.max("angle")).collect()}
    placed = _placed(groups, pivots, reach, radii)
    rows = F.greatest(F.lit(1), F.floor(F.lit(chunk_bytes) / (8 * F.col("dims"))))
    sizes = placed.groupBy("label", "dims", "cell").agg(
        *(F.ceil(F.sum(F.when(side, 1).otherwise(0)) / rows).alias(name) for name, side in (("owns", F.col("own")), ("guests", ~F.col("own")))))
    # a cell's own chunks 0 .. owns-1 meet each other, and its guests' chunks own ones
    chunk = F.pmod(F.xxhash64(F.lit(12), "gid"), F.when(F.col("own"), F.col("owns")).otherwise(F.col("guests")))
    met = placed.join(sizes, ["label", "dims", "cell"]).withColumn("chunk", chunk)
    others = F.sequence(F.lit(0).cast("bigint"), F.col("owns") - 1)
    with_guests = F.when(F.col("guests") > 0, F.sequence(F.col("owns"), F.col("owns") + F.col("guests") - 1)).otherwise(F.array().cast("array<bigint>"))
    meets = F.when(F.col("own"), F.concat(others, with_guests)).otherwise(others)
    at = F.col("chunk") + F.when(F.col("own"), F.lit(0)).otherwise(F.col("owns"))
    dealt = met.withColumn("at", at).withColumn("with", F.explode(meets)).select(
        "label", "dims", "cell", F.least("at", "with").alias("a"), F.greatest("at", "with").alias("b"), (F.col("at") <= F.col("with")).alias("first"),
        "gid", "v", "angle", "copies", "own")

    def pair(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy()
        sides = [table.filter(pa.array(first)), table.filter(pa.array(~first))]
        same = table.column("a")[0] == table.column("b")[0]
        x = [stacked(s.column("v")) for s in sides]
        angle = [s.column("angle").to_numpy() for s in sides]
        copies = [s.column("copies").to_numpy() for s in sides]
        gids = np.concatenate([s.column("gid").to_numpy() for s in sides])
        own = np.concatenate([s.column("own").to_numpy() for s in sides])
        if not same and not (len(x[0]) and len(x[1])):
            return pa.table({"gid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        left, right, label = join_tiles(x[0], None if same else x[1], angle[0], angle[1], copies[0], copies[1], least)
        links = np.where(own, left if same else np.concatenate([left, right]), 0)
        # the smallest gid of each set
        smallest = np.full(len(gids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, gids)
        root = smallest[label]
        told = (links > 0) | (root != gids)
        return pa.table({"gid": pa.array(gids[told]), "links": pa.array(links[told]), "root": pa.array(root[told])})

    return dealt.groupBy("label", "dims", "cell", "a", "b").applyInArrow(pair, "gid bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, least: float = LEAST, cell_rows: int = CELL_ROWS, budget_bytes: int = PIVOT_BYTES,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links (other
    rows linked directly), component_id (smallest vec_id that links reach, its
    own included) and kept (vec_id = component_id)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    every = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    takes_part = usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    # adding zero turns -0.0 into 0.0, which equals it
    v = F.transform("embedding", lambda x: x + F.lit(0).cast(kind))
    rows = every.where(takes_part).select("vec_id", "label", v.alias("v"))
    key = [F.xxhash64(F.lit(k), "v").alias(f"h{k}") for k in (1, 2)]
    found = materialize(
        rows.groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("gid"), "label", F.size("v").alias("dims"), "v", "copies", "least_id"), "vectors")
    told = materialize(link_counts(found.drop("least_id"), least, cell_rows, budget_bytes, chunk_bytes), "links")
    counted = told.groupBy("gid").agg(F.sum("links").alias("links"))
    reached = components(told.where("root <> gid").select(F.col("gid").alias("a"), F.col("root").alias("b")))
    # the smallest vec_id of each component, then of each group of copies
    labelled = materialize(reached.join(found.select(F.col("gid").alias("node"), "least_id"), "node"), "labelled")
    of_component = labelled.groupBy("label").agg(F.min("least_id").alias("component"), F.count("*").alias("n"))
    component = join_spread(labelled, of_component, ["label"], "n", labelled.count(), "inner").select(F.col("node").alias("gid"), "component")
    table = (found.select("gid", "label", *key, "copies", "least_id").join(counted, "gid", "left").join(component, "gid", "left")
             .select("label", "h1", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "least_id").alias("component_id")))
    table = materialize(table, "vector-groups")
    total = table.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    linked = join_spread(rows.select("vec_id", "label", *key), table, ["label", "h1", "h2"], "copies", total, "inner")
    alone = every.where(~takes_part).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
