"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together inside a task; bounds what one step holds in memory.
BATCH_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_batches(batch: pa.RecordBatch, column: str, limit: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch whose texts (null: empty) have about ``limit`` bytes,
    one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield _slice(batch, column, start, i)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield _slice(batch, column, start, batch.num_rows)


def _slice(batch: pa.RecordBatch, column: str, start: int, stop: int) -> tuple[pa.RecordBatch, list[str]]:
    part = batch.slice(start, stop - start)
    return part, [x or "" for x in part.column(column).to_pylist()]


def map_texts(df: DataFrame, column: str, rows: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch | None],
              schema: str) -> DataFrame:
    """``rows(part, texts)`` over slices of every partition of ``df``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, column):
                if (out := rows(part, texts)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


#: Bytes that a worker's table of chunks may take, and the longest chunk it keeps.
TABLE_BYTES, LONGEST_CHUNK = 80_000_000, 64
_SLOT = 120  # of a dict, and what an allocator rounds up


def held_bytes(chunk: str, value) -> int:
    """Bytes of a table's entry, about."""
    own = _SLOT + getsizeof(chunk) + getsizeof(value)
    return own + sum(map(getsizeof, value)) if type(value) is tuple else own


class ChunkTable:
    """Chunks of the texts seen so far in a worker and what each is encoded to.
    A distinct chunk is encoded once a call and looked up by position
    afterwards.  Chunks of up to ``longest`` characters are kept for later
    calls, in two generations: a younger one that has a third of the bytes
    replaces the older, unless it grew past two thirds in one call, and what is
    used of the older moves back.  What is not kept costs time and changes no
    result."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable],
                 limit: int = TABLE_BYTES, longest: int = LONGEST_CHUNK):
        self.split, self.encode, self.third, self.longest = split, encode, limit // 3, longest
        self.young, self.old, self.bytes = {}, {}, 0

    def lookup(self, texts: list[str]) -> list[list]:
        """Per text: its chunks' values in order."""
        chunks = [self.split(t) for t in texts]
        distinct = set()
        for c in chunks:
            distinct.update(c)
        young, old = self.young, self.old
        missing = [c for c in distinct if c not in young]
        moved = {c: old[c] for c in missing if c in old}
        if new := [c for c in missing if c not in moved]:
            moved.update(zip(new, self.encode(new)))
        young.update(moved)
        value = young.__getitem__
        out = [list(map(value, c)) for c in chunks]
        for c in missing:
            if len(c) > self.longest:
                del young[c], moved[c]
        self.bytes += sum(map(held_bytes, moved, moved.values()))
        if self.bytes > self.third:
            self.old = young if self.bytes <= 2 * self.third else {}
            self.young, self.bytes = {}, 0
        return out


#: What a Python worker keeps between tasks, which Spark may run in one worker.
_PER_WORKER: dict = {}


def per_worker(key, make: Callable):
    """The worker's one kept object, made anew when another kind is asked for."""
    if key not in _PER_WORKER:
        release()
        _PER_WORKER[key] = make()
    return _PER_WORKER[key]


def release() -> None:
    """Frees what the worker keeps, before tasks that need the memory, and hands
    free memory back to the system where the C library can (glibc)."""
    _PER_WORKER.clear()
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def even_labels(spark: SparkSession, tasks: int) -> list[int]:
    """One int for each of ``tasks`` partitions that ``repartition`` by an int
    column deals there, so that one range goes to one task; 40 are tried for
    each, and any other number stands for a partition that none goes to."""
    numbers = spark.range(40 * tasks).select(F.col("id").cast("int").alias("part"))
    told = numbers.groupBy(F.pmod(F.hash("part"), F.lit(tasks)).alias("to")).agg(F.min("part").alias("part"))
    found = [r.part for r in told.orderBy("part").collect()]
    return found + list(range(40 * tasks, 41 * tasks - len(found)))


#: Keys with more than one in so many of all rows are joined by broadcast; there
#: are fewer than that of them.
SPREAD = 1000


def join_spread(rows: DataFrame, table: DataFrame, key: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, one row a key, whose column ``weight`` says
    how many of the ``total`` rows have the key.  The rows of a key that holds
    more than a share of 1 / SPREAD stay where they are: its row of the table is
    broadcast, and there are fewer than SPREAD such.  All others are shuffled."""
    hot = F.col(weight) * SPREAD > total
    few, rest = table.where(hot).drop(weight), table.where(~hot).drop(weight)
    stay = rows.join(F.broadcast(few), key)
    move = rows.join(F.broadcast(few.select(*key)), key, "left_anti").join(rest, key, how)
    return stay.unionByName(move, allowMissingColumns=True)


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))
