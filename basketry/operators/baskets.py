"""Basket affinity (A7, A8, J5, T3o).

A basket is every product a customer ever bought (trap T11), unless another
``basket_key`` is given.  Pairs are made per
basket, but:

* baskets are de-duplicated first (A7) and stored, so repeat purchases add
  nothing and the order table is read once;
* products rarer than a proven lower bound of the ``limit``-th largest pair count
  cannot be in the result and are left out (``support_floor``);
* a basket's left products are dealt into blocks of about ``block``, so a task
  meets a bounded number of left products with the basket's right ones;
* baskets are joined with the numbers of the left products once and stored as numbers;
* the pairs of a basket are made and counted as numbers in Arrow batches and
  leave a task as packed sorted runs (``frequent_pair_counts``);
* when a pair was first seen decides ties alone, so it is looked up for the
  pairs that reach the ``limit``-th count and no others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize


def basket_sets(orders: DataFrame, basket_key: str = "customer_id", item: str = "product_id") -> DataFrame:
    """Distinct (basket, product) rows; null keys are ignored."""
    return (orders.filter(F.col(basket_key).isNotNull() & F.col(item).isNotNull())
                  .select(F.col(basket_key).alias("basket"), F.col(item).alias("product"))
                  .distinct())


def _first_key(orders: DataFrame) -> Column:
    """Ascending order in which newest-first orders fill a dict of baskets."""
    return F.struct((-F.unix_micros("created_at")).alias("t"), (-F.col("order_id").cast("bigint")).alias("o"),
                    F.col("line").cast("bigint").alias("l"), F.col("product_id").cast("bigint").alias("p"),
                    F.col("quantity").cast("bigint").alias("q"), F.col("revenue").cast("double").alias("r"))


def pair_counts(baskets: DataFrame, block: int = 1000) -> DataFrame:
    """J5 + count: (left, right, pair_count) with left < right.

    A basket with more than ``block`` products has its left ones dealt into
    blocks, so that a task meets a bounded number of them with the basket's
    right ones, however large the basket is."""
    large = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block)
    tagged = baskets.join(large, "basket", "left").withColumn("_blocks", F.coalesce(F.ceil(F.col("_size") / block), F.lit(1).cast("bigint")))
    left = tagged.select("basket", F.col("product").alias("left"), F.pmod(F.xxhash64("product"), "_blocks").alias("salt"))
    right = tagged.select("basket", F.col("product").alias("right"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("salt"))
    pairs = left.join(right, ["basket", "salt"]).filter(F.col("left") < F.col("right"))
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("pair_count"))


#: A product pair as one number: the smaller number in the upper half.  Multiplied
#: by an odd number (which can be undone) its upper bits name a partition.
_ODD = 0x9E3779B97F4A7C15
PAIRS_AT_ONCE, PAIRS_A_PART = 4_000_000, 4_000_000


def _pack(numbers: np.ndarray) -> bytes:
    """Ascending distinct numbers, their low bits as they are and the rest in unary
    (Elias-Fano): two bits more a number than its share of the range needs."""
    n = len(numbers)
    low = max(0, (int(numbers[-1]) // n).bit_length() - 1)
    bits = np.unpackbits(numbers.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - low:]
    high = (numbers >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1, np.uint8)
    unary[high] = 1
    return n.to_bytes(4, "little") + bytes([low]) + np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    n, low = int.from_bytes(packed[:4], "little"), packed[4]
    split = 5 + (n * low + 7) // 8
    bits = np.unpackbits(np.frombuffer(packed[5:split], np.uint8), count=n * low).reshape(n, low)
    numbers = np.zeros((n, 8), np.uint8)
    whole = (low + 7) // 8
    if low:
        padded = np.zeros((n, 8 * whole), np.uint8)
        padded[:, 8 * whole - low:] = bits
        numbers[:, 8 - whole:] = np.packbits(padded, axis=1)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(packed[split:], np.uint8))) - np.arange(n)
    return numbers.view(">u8").ravel().astype(np.uint64) | high.astype(np.uint64) << np.uint64(low)


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Most pairs are counted once in a run: the others' places and counts."""
    many = np.flatnonzero(counts > 1)
    return many.astype(np.uint32).tobytes(), counts[many].astype(np.uint32).tobytes()


def _unpack_counts(length: int, places: bytes, counts: bytes) -> np.ndarray:
    n = np.ones(length, np.int64)
    n[np.frombuffer(places, np.uint32)] = np.frombuffer(counts, np.uint32)
    return n


def _numbered_products(products: DataFrame) -> DataFrame:
    """(product, number) with numbers 0, 1, ... in 32 bits of distinct products."""
    rows = materialize(products.select("product").withColumn("_id", F.monotonically_increasing_id()), "products")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row a partition
    first, items = 0, []
    for r in sizes:
        items += [F.lit(r.part), F.lit(first)]
        first += r.n
    if first >= 1 << 32:
        raise ValueError("more products than 32 bits can number")
    before = F.element_at(F.create_map(*items), part) if items else F.lit(0)
    return rows.select("product", (place + before).cast("bigint").alias("number"))


def _pairs_of(group: np.ndarray, side: np.ndarray, across: np.ndarray, number: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of rows of one group, sorted by group; only of different sides where
    ``across`` is set.  One step per distance, over the rows that reach so far."""
    at = np.arange(len(group) - 1)
    far = 1
    while len(at):
        at = at[at + far < len(group)]
        at = at[group[at + far] == group[at]]
        met = at[~across[at] | (side[at] != side[at + far])]
        a, b = number[met], number[met + far]
        yield np.minimum(a, b) << np.uint64(32) | np.maximum(a, b)
        far += 1


def frequent_pair_counts(baskets: DataFrame, least: int, block: int = 1000, products: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """J5 + count: (left, right, pair_count) of the pairs with pair_count >= ``least``
    and left < right, of all products or of those in ``products`` (distinct).

    With ``limit`` a hash partition tells only its pairs that reach its own
    ``limit``-th largest count.  That is at most the one of all pairs, so every pair
    that reaches the latter is told, ties included, where ``least`` alone may let all
    pairs pass: 1 is the bound where the most frequent products seldom meet.

    Tasks make the pairs of whole baskets, or of two blocks of a large basket's
    products, as numbers, count equal ones and send sorted runs by hash partition;
    the counts of a partition are added up from its runs.  A pair has no more bits
    than two product numbers need, and a run holds of each the low bits that its
    length does not tell, so that a pair takes two or three bytes."""
    numbers = _numbered_products(baskets.select("product").distinct() if products is None else products)
    each = max(1, (int(numbers.agg(F.max("number")).first()[0] or 0)).bit_length())
    half, mask, odd = np.uint64(each), np.uint64((1 << 2 * each) - 1), np.uint64(_ODD & ((1 << 2 * each) - 1))
    undo = np.uint64(pow(_ODD, -1, 1 << 2 * each))
    held = materialize(baskets.join(numbers, "product").select("basket", "number"), "numbered-baskets")
    sizes = materialize(held.groupBy("basket").agg(F.count(F.lit(1)).alias("_size")), "basket-sizes")
    size = F.col("_size").cast("double")
    total = sizes.agg(F.sum(size * (size - 1) / 2)).first()[0]
    bits = min(2 * each, max(4, int((total or 0) // PAIRS_A_PART).bit_length()))
    rest = np.uint64(2 * each - bits)
    # written, so that the baskets are not shuffled to meet the few large ones
    large = materialize(sizes.where(F.col("_size") > block), "large-baskets")
    blocks = F.coalesce(F.ceil(F.col("_size") / block), F.lit(1).cast("bigint"))
    placed = held.join(large, "basket", "left").select(
        "basket", "number", blocks.alias("blocks"), F.pmod(F.xxhash64("number"), blocks).alias("own"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "basket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("first"), "number")
    # hashed after the shuffle, which sends no random bytes
    sorted_rows = dealt.repartition("basket", "a", "b").sortWithinPartitions("basket", "a", "b").select(
        F.xxhash64("basket", "a", "b").alias("deal"), F.xxhash64(F.lit(3), "basket", "a", "b").alias("again"),
        (F.col("a") != F.col("b")).alias("across"), "first", "number")

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            x = np.concatenate(waiting)
            x = ((x >> np.uint64(32) << half | x & np.uint64(0xFFFFFFFF)) * odd) & mask
            x.sort()
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            x, n = x[starts], np.diff(starts, append=len(x))
            edges = np.searchsorted(x >> rest, np.arange((1 << bits) + 1, dtype=np.uint64))
            spans = [(p, s, e) for p, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
            counts = [_pack_counts(n[s:e]) for _, s, e in spans]
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, _, _ in spans], pa.int32()), pa.array([_pack(x[s:e] - (np.uint64(p) << rest)) for p, s, e in spans], pa.binary()),
                 pa.array([c[0] for c in counts], pa.binary()), pa.array([c[1] for c in counts], pa.binary())], names=["part", "pairs", "places", "counts"])

        waiting, held, kept = [], 0, None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("deal", "again", "first", "across", "number")]
            if kept is not None:
                rows = [np.concatenate([k, r]) for k, r in zip(kept, rows)]
            # the last group may go on in the next batch
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            end = new[-1] if len(new) else 0
            kept = [r[end:] for r in rows]
            if end:
                group = np.cumsum(np.concatenate([[0], (rows[0][1:end] != rows[0][:end - 1]) | (rows[1][1:end] != rows[1][:end - 1])]))
                for pairs in _pairs_of(group, rows[2][:end], rows[3][:end], rows[4][:end].astype(np.uint64)):
                    waiting.append(pairs)
                    held += len(pairs)
                    if held >= PAIRS_AT_ONCE:
                        yield flush()
                        waiting, held = [], 0
        if kept is not None and len(kept[0]):
            waiting += list(_pairs_of(np.zeros(len(kept[0]), np.int64), kept[2], kept[3], kept[4].astype(np.uint64)))
        if sum(map(len, waiting)):
            yield flush()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            x, n = np.concatenate([p for p, _ in runs]), np.concatenate([c for _, c in runs])
            order = np.argsort(x, kind="stable")
            x, n = x[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            x, n = x[starts], np.add.reduceat(n, starts)
            reach = max(least, np.partition(n, -limit)[-limit]) if limit and len(n) > limit else least
            x, n = ((x[n >= reach] + (np.uint64(part) << rest)) * undo) & mask, n[n >= reach]
            low = (np.uint64(1) << half) - np.uint64(1)
            return pa.RecordBatch.from_arrays([pa.array((x >> half).astype(np.int64)), pa.array((x & low).astype(np.int64)), pa.array(n)],
                                              names=["one", "two", "pair_count"])

        part, runs = None, []
        for batch in batches:
            for p, pairs, places, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "pairs", "places", "counts"))):
                if p != part and runs:
                    yield told()
                    runs = []
                part = p
                pairs = _unpack(pairs)
                runs.append((pairs, _unpack_counts(len(pairs), places, counts)))
        if runs:
            yield told()

    packed = sorted_rows.mapInArrow(make, "part int, pairs binary, places binary, counts binary").repartition("part").sortWithinPartitions("part")
    counted = packed.mapInArrow(add, "one bigint, two bigint, pair_count bigint")
    named = counted.join(numbers.select(F.col("number").alias("one"), F.col("product").alias("_p")), "one").join(
        numbers.select(F.col("number").alias("two"), F.col("product").alias("_q")), "two")
    return named.select(F.least("_p", "_q").alias("left"), F.greatest("_p", "_q").alias("right"), "pair_count")


def first_seen(pairs: DataFrame, baskets: DataFrame, orders: DataFrame, basket_key: str) -> DataFrame:
    """``pairs`` (left, right, ...) with ``first_seen``, the key of the first basket
    that holds both products.  The pairs and what is found of them are written, so
    that baskets and orders are not shuffled where these are few."""
    pairs = materialize(pairs, "leading-pairs")
    held = materialize(pairs.select("left", "right").join(baskets.withColumnRenamed("product", "left"), "left"), "pair-baskets")
    both = materialize(held.join(baskets.withColumnRenamed("product", "right"), ["basket", "right"]), "pair-baskets")
    known = orders.filter(F.col("product_id").isNotNull()).withColumn("basket", F.col(basket_key))
    first = known.join(both.select("basket").distinct(), "basket", "left_semi").groupBy("basket").agg(F.min(_first_key(orders)).alias("_k"))
    seen = both.join(first, "basket").groupBy("left", "right").agg(F.min("_k").alias("first_seen"))
    return pairs.join(seen, ["left", "right"])


def frequent_pairs(baskets: DataFrame, min_support: int) -> DataFrame:
    """Pairs in at least ``min_support`` baskets.  Both products of such a pair
    are in as many, so rarer products are left out before pairs are made."""
    frequent = baskets.groupBy("product").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)
    return frequent_pair_counts(baskets, min_support, products=frequent)


def support_floor(baskets: DataFrame, product_counts: DataFrame, limit: int, candidates: int) -> F.Column:
    """A lower bound on the ``limit``-th largest pair count (scalar subquery).

    Pairs among the ``candidates`` most frequent products are counted
    exactly (their baskets restricted to those products; the candidate list
    is bounded by ``candidates`` and broadcast); the ``limit``-th largest of
    those real counts cannot exceed the true one.  1 when there are fewer
    candidate pairs."""
    top = product_counts.orderBy(F.desc("n"), "product").limit(candidates).select("product")
    cand = baskets.join(F.broadcast(top), "product", "left_semi")
    counts = pair_counts(cand).orderBy(F.desc("pair_count")).limit(limit)
    return counts.agg(F.when(F.count(F.lit(1)) >= limit, F.min("pair_count")).otherwise(F.lit(1))
                      .cast("bigint")).scalar()


def basket_analysis(orders: DataFrame, limit: int = 10, basket_key: str = "customer_id",
                    block: int = 1000, prune_candidates: int | None = 200) -> DataFrame:
    """Top ``limit`` pairs with support, confidence and lift.

    Ties in pair count resolve as a Counter filled basket by basket would:
    by the first basket (newest order first) holding the pair, then by the
    pair itself.

    The pair space is cut exactly (the Apriori bound): a pair counted in c
    baskets needs both products in >= c baskets, so only products reaching the
    support floor L (``support_floor`` over the ``prune_candidates`` most
    frequent products, <= the true ``limit``-th count) can be in the result.
    Of the pairs among those, the ones are stored that are counted L times or more
    and reach the ``limit``-th largest count of their hash partition.
    """
    baskets = materialize(basket_sets(orders, basket_key), "baskets")
    one = orders.sparkSession.range(1)
    # one row a product, read by the bound, the products' numbers and the result
    product_counts = materialize(baskets.groupBy("product").agg(F.count(F.lit(1)).alias("n")), "product-counts")
    total, floor = one.select(baskets.select(F.count_distinct("basket")).scalar(),
                              support_floor(baskets, product_counts, limit, prune_candidates) if prune_candidates else F.lit(1)).first()
    total = F.lit(total)
    pairs = materialize(frequent_pair_counts(baskets, floor, block, product_counts.filter(F.col("n") >= floor), limit), "pairs")
    # all pairs that reach the ``limit``-th largest count
    least = pairs.orderBy(F.desc("pair_count")).limit(limit).agg(F.min("pair_count")).first()[0]
    top = pairs.filter(F.col("pair_count") >= F.lit(least))
    timed = "created_at" in orders.columns
    if timed:
        top = first_seen(top, baskets, orders, basket_key)
    order = [F.desc("pair_count")] + ([F.asc("first_seen")] if timed else []) + [F.asc("left"), F.asc("right")]
    top = top.orderBy(*order).limit(limit)
    # at most ``limit`` rows reach this window
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    # the few ranked pairs are broadcast to the product counts, which are not shuffled again
    sides = ranked.select("*", F.explode(F.array("left", "right")).alias("product"))
    met = product_counts.join(F.broadcast(sides), "product")
    count_of = lambda side: F.max(F.when(F.col("product") == F.col(side), F.col("n"))).alias(f"{side}_count")
    j = met.groupBy(*ranked.columns).agg(count_of("left"), count_of("right"))
    support = F.col("pair_count") / total
    expected = (F.col("left_count") / total) * (F.col("right_count") / total)
    return j.select(
        "rank", "left", "right",
        F.col("pair_count").cast("bigint").alias("basket_count"),
        F.round(support, 3).alias("support"),
        F.round(F.col("pair_count") / F.greatest(F.col("left_count"), F.lit(1)), 3).alias("confidence"),
        F.round(F.when(expected != 0, support / expected).otherwise(F.lit(0.0)), 3).alias("lift"),
        total.cast("bigint").alias("total_baskets"),
    )
