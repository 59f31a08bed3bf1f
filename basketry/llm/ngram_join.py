"""Near-duplicate classes by an exact Jaccard join of word shingles.

Documents with equal shingle sets form a class.  Classes are joined by a
grouped prefix join under one order of all shingles, rare ones first: two sets
with Jaccard similarity >= 3/4 share a shingle among the first n - ceil(3n/4) + 1
of each.

* Order.  A count sketch of bounded size tells the few shingles that may be
  very frequent ("heavy").  They come last, by sketch.  All others come by
  exact document count, which is taken where the shingle's documents meet; no
  such list is longer than the sketch's bound.
* Groups.  Documents with identical prefix and size become one group; shingles
  that occur once cannot match and are dropped from prefixes.
* Pairs.  In each prefix shingle's list every group is first compared with one
  pivot only, the group with the fewest shingles of its own, and linked
  documents get one label.  Then all remaining pairs of the lists whose
  documents have different labels, and whose prefixes have enough in common,
  are compared.  So large groups of copies take linear work, and no link
  between differently labelled documents is lost.
* Expansion and verification.  Group pairs of compatible size are expanded to
  their members and checked on the whole sets.

Null text, and text without words, has an empty set and is linked with
nothing.  Texts are read whole; repeated rows are equal sets; other columns
are ignored; an empty table gives an empty result.  Hashes have 64 bits for
sets and classes.  Candidate search takes 48 bits of each shingle; the places
of a prefix are those of a document's different 48-bit values, of which two
linking documents share as many as the bounds ask for whatever collides.

``near_duplicates`` gives the classes that links reach; ``jaccard_links`` gives
all verified links between documents of different sets, and the membership.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.common import even_labels, longs, map_texts, release, text_batches
from basketry.llm.components import components
from basketry.llm.shingles import shingle_set, signature
from basketry.session import materialize

#: Buckets of the sketch (4 bytes each go to every executor), rows it travels in.
SKETCH, SKETCH_ROWS = 1 << 19, 64
#: A bucket is heavy from so many times the mean count on, and from this count on.
HEAVY_TIMES, HEAVY_LEAST = 16, 256
#: Shingles that one task counts.
TASK_SHINGLES = 2_000_000
#: Signatures a map task remembers to skip copies.
REMEMBER = 1_000_000
PIVOT_ROUNDS, PIVOTS = 1, 3
#: Members compared with a pivot by one task.
STAR = 500
#: Bits of the filter that keeps sets of documents without candidates out of a shuffle.
FILTER_BITS = 1 << 24
_LOW48 = np.uint64((1 << 48) - 1)


def _six_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def _needed(n, other_n):
    """Shingles that two linking documents of such sizes have in common in
    their prefixes, at least.

    Their overlap is 3/7 of both sizes together or more, and what of it is not
    in both prefixes lies in one document's rest after its prefix.  If d of a
    document's shingles collide with others of its own, overlap and rest are
    both smaller by d at most, so the bound holds for 48-bit values too."""
    rest = lambda size: F.floor((3 * size + 3) / 4) - 1
    return F.greatest(F.lit(1), F.ceil(3 * (n + other_n) / 7) - F.greatest(rest(n), rest(other_n)))


def _may_link(n, shared, at, other_n, other_shared, other_at):
    """What two documents of a list satisfy if the list's shingle is the first
    that their prefixes have in common and they link: sizes within 3/4, and in
    each prefix (``shared`` shingles, this one at ``at``) enough left to come."""
    needed = _needed(n, other_n)
    return (4 * F.least(n, other_n) >= 3 * F.greatest(n, other_n)) & (shared - at >= needed) & (other_shared - other_at >= needed)


def _profiled(df: DataFrame) -> DataFrame:
    """Per document ``doc_id, sig, n``, and per task the sketch's counts in
    rows of ``place, counts``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts, seen = np.zeros(SKETCH, dtype=np.uint32), set()
        for batch in batches:
            for part, texts in text_batches(batch, "text"):
                sig, n, new = [], [], []
                for t in texts:
                    own = shingle_set(t)
                    n.append(len(own))
                    sig.append(signature(own) if len(own) else None)
                    if len(own) and sig[-1] not in seen:
                        if len(seen) >= REMEMBER:
                            seen.clear()
                        seen.add(sig[-1])
                        new.append(own)
                if new:
                    counts += np.bincount(_bucket(np.concatenate(new)), minlength=SKETCH).astype(np.uint32)
                empty = pa.nulls(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sig, pa.int64()), pa.array(n, pa.int64()), empty.cast(pa.int32()), empty.cast(pa.binary())], _PROFILE)
        rows = counts.reshape(SKETCH_ROWS, -1)
        empty = pa.nulls(SKETCH_ROWS, pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], _PROFILE)

    return df.mapInArrow(run, "doc_id bigint, sig bigint, n bigint, place int, counts binary")


_PROFILE = ["doc_id", "sig", "n", "place", "counts"]


def _sketch(profiled: DataFrame) -> np.ndarray:
    """All tasks' counts added up; the driver gets ``SKETCH`` numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, raw in zip(batch.column("place").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(raw, dtype=np.uint32).astype(np.int64)
                sums[place] = sums[place] + own if place in sums else own
        for place, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["place", "counts"])

    rows = profiled.where(F.col("place").isNotNull()).select("place", "counts").repartition(SKETCH_ROWS // 4, "place").mapInArrow(run, "place int, counts binary").collect()
    out = np.zeros((SKETCH_ROWS, SKETCH // SKETCH_ROWS), dtype=np.int64)
    for r in rows:
        out[r.place] = np.frombuffer(r.counts, dtype=np.int64)
    return out.reshape(-1)


def _dealt(df: DataFrame, sketch: np.ndarray, labels: list[int]) -> DataFrame:
    """Light shingles packed by range, and per document one row with its size,
    its number of light shingles and the heavy ones of its prefix."""
    bound = max(HEAVY_LEAST, HEAVY_TIMES * sketch.mean())
    estimate = np.minimum(sketch, (1 << 31) - 1).astype(np.int32)
    shared = df.sparkSession.sparkContext.broadcast(estimate)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        estimate, seen = shared.value, set()
        for batch in batches:
            for _, texts in text_batches(batch, "text"):
                owners, light, profiles = [], [], []
                for t in texts:
                    own = shingle_set(t)
                    if not len(own) or (sig := signature(own)) in seen:
                        continue
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(sig)
                    n, own = len(own), np.unique(own & _LOW48)
                    guess = estimate[_bucket(own)]
                    heavy = guess >= bound
                    rare = own[~heavy]
                    wanted = max(0, prefix_length(n) - len(rare))
                    order = np.lexsort((own[heavy], guess[heavy]))[:wanted]
                    profiles.append((sig, n, len(rare), own[heavy][order].astype(np.int64), guess[heavy][order].astype(np.int64)))
                    owners.append(np.full(len(rare), len(profiles) - 1, dtype=np.int32))
                    light.append(rare)
                if profiles:
                    yield _packed(profiles, np.concatenate(owners), np.concatenate(light), labels)

    return df.mapInArrow(run, "part int, sig bigint, n int, light int, heavy array<bigint>, guess array<bigint>, shingles binary, owners binary, counts binary")


def _packed(profiles: list[tuple], owner: np.ndarray, light: np.ndarray, labels: list[int]) -> pa.RecordBatch:
    signatures = np.array([p[0] for p in profiles], dtype=np.int64)
    part = ((light >> np.uint64(20)) % np.uint64(len(labels))).astype(np.int32)
    order = np.argsort(part, kind="stable")  # owners stay in order within a part
    part, owner, light = part[order], owner[order], light[order]
    kinds, at = np.unique(part, return_index=True)
    rows = []
    for k, a, b in zip(kinds, at, [*at[1:], len(part)]):
        own, first, count = np.unique(owner[a:b], return_index=True, return_counts=True)
        rows.append((labels[k], None, None, None, None, None, _six_bytes(light[a:b]), signatures[own].tobytes(), count.astype("<i4").tobytes()))
    rows += [(labels[p[0] % len(labels)], *p, None, None, None) for p in profiles]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "sig", "n", "light", "heavy", "guess", "shingles", "owners", "counts"])


#: Heavy shingles come after all others in the order.
_AFTER = 1 << 40


def _shared_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's ranges: shingles of two or more documents as ``sig,
    shingle, rank``; profiles go through as ``sig, n, light`` and their heavy
    shingles."""
    release()
    shingles, owners = [], []
    for batch in batches:
        profile = batch.filter(pc.is_valid(batch.column("sig")))
        if profile.num_rows:
            sig, n, light = (profile.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "n", "light"))
            heavy = profile.column("heavy")
            sizes = np.diff(heavy.offsets.to_numpy())
            yield _posted(sig, n, light, None, None)
            if sizes.sum():
                yield _posted(np.repeat(sig, sizes), None, None, heavy.flatten().to_numpy(), profile.column("guess").flatten().to_numpy() + _AFTER)
        for raw, own, count in zip(*(batch.column(c).to_pylist() for c in ("shingles", "owners", "counts"))):
            if raw is not None:
                shingles.append(_from_six(raw))
                owners.append(np.repeat(np.frombuffer(own, "<i8"), np.frombuffer(count, "<i4")))
    if not shingles:
        return
    shingle, owner = np.concatenate(shingles), np.concatenate(owners)
    shingles.clear()
    owners.clear()
    order = np.lexsort((owner, shingle))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), dtype=bool)
    same = shingle[1:] == shingle[:-1]
    new[1:] = ~(same & (owner[1:] == owner[:-1]))  # copies that several tasks have sent
    shingle, owner = shingle[new], owner[new]
    starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    count = np.diff(np.concatenate([starts, [len(shingle)]]))
    count = np.repeat(count, count)
    several = count > 1
    shingle, owner, count = shingle[several].astype(np.int64), owner[several], count[several]
    for a in range(0, len(shingle), 100_000):
        yield _posted(owner[a:a + 100_000], None, None, shingle[a:a + 100_000], count[a:a + 100_000])


def _posted(sig, n, light, shingle, rank) -> pa.RecordBatch:
    column = lambda x: pa.nulls(len(sig), pa.int64()) if x is None else longs(x)
    return pa.RecordBatch.from_arrays([column(x) for x in (sig, n, light, shingle, rank)], ["sig", "n", "light", "shingle", "rank"])


def _postings(df: DataFrame, sketch: np.ndarray, shingles: int) -> DataFrame:
    """``sig, n, shingle, rank`` of all prefixes, without shingles that occur
    once; ``rank`` and ``shingle`` give the order."""
    tasks = max(1, math.ceil(shingles / TASK_SHINGLES))
    posted = _dealt(df, sketch, even_labels(df.sparkSession, tasks)).repartition(tasks, "part").mapInArrow(_shared_shingles, "sig bigint, n bigint, light bigint, shingle bigint, rank bigint")
    own = Window.partitionBy("sig")
    along = own.orderBy(F.col("rank").asc_nulls_first(), "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = posted.select("sig", F.max("n").over(own).alias("n"), F.max("light").over(own).alias("light"), "shingle", "rank",
                         F.dense_rank().over(own.orderBy(F.col("rank").asc_nulls_first(), "shingle")).alias("at"),
                         F.count(F.when(F.col("rank") < _AFTER, 1)).over(own).alias("several"))
    # profiles have the place 1, shingles the places after it; what several
    # tasks have sent of a copy has the same places and is dropped below
    once = F.col("light") - F.col("several")
    prefix = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1
    return told.where(F.col("shingle").isNotNull() & (F.col("at") - 1 + once <= prefix)).select("sig", "n", "shingle", "rank").distinct()


def _grouped(postings: DataFrame) -> DataFrame:
    """``sig, n, group, prefix``: per document the shingles of its prefix that
    other prefixes have too, in order; ``group`` is equal for documents with
    identical prefix and size."""
    met = postings.groupBy("shingle").agg(F.count("*").alias("documents")).where("documents > 1").select("shingle")
    whole = postings.join(met, "shingle").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "shingle"))).alias("p"))
    told = whole.select("sig", "n", F.col("p.shingle").alias("prefix"))
    complete = F.size("prefix") == F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1
    return told.select("sig", "n", F.when(complete, F.xxhash64("prefix", "n")).otherwise(F.xxhash64("sig")).alias("group"), "prefix")


def _pivots(lists: DataFrame, members: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a, b`` of one pivot document per list and the members of all
    groups in the list that have another label."""
    place = F.xxhash64("group", F.lit(turn), F.col("shingle") % PIVOTS)
    if not turn:  # first the document with the fewest shingles of its own
        place = F.struct(-F.col("shared") / F.col("n"), place)
    pivots = lists.groupBy("shingle").agg(F.min_by(F.struct(*(F.col(c).alias(f"pivot_{c}") for c in ("group", "n", "shared"))), place).alias("of")).select("shingle", "of.*")
    fits = _may_link(F.col("n"), F.col("shared"), F.lit(0), F.col("pivot_n"), F.col("pivot_shared"), F.lit(0))
    met = lists.join(pivots, "shingle").where(fits).select("pivot_group", "group").distinct()
    first = members.groupBy("group").agg(F.min_by(F.struct("sig", "label"), F.xxhash64("sig", F.lit(turn))).alias("first"))
    pairs = met.join(first.withColumnRenamed("group", "pivot_group"), "pivot_group").join(members, "group")
    return pairs.where(F.col("first.label") != F.col("label")).select(F.col("first.sig").alias("a"), F.col("sig").alias("b")).distinct()


def _short(prefix):
    """31 bits of each of a prefix's shingles, and how many of them are lost to
    collisions within the prefix."""
    short = F.transform(prefix, lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    return short.alias("short"), (F.size(prefix) - F.size(F.array_distinct(short))).alias("lost")


def _in_common(short, lost, other_short, other_lost):
    """Shingles that two prefixes have in common, at most: different 31-bit
    values in common, and what collisions can have merged among them."""
    return F.size(F.array_intersect(short, other_short)) + F.least(lost, other_lost)


def _rest(lists: DataFrame, grouped: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of documents with different labels whose prefixes have enough
    in common to link."""
    labels = members.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    marked = lists.join(labels, "group")
    mixed = marked.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("shingle")
    short = grouped.select("group", *_short(F.col("prefix"))).dropDuplicates(["group"])
    columns = ["shingle", "group", "n", "shared", "at", "low", "high", "short", "lost"]
    left = marked.join(mixed, "shingle").join(short, "group").select(*columns)
    right = left.toDF("shingle", *(f"other_{c}" for c in columns[1:]))
    fits = (F.col("group") <= F.col("other_group")) & _may_link(*map(F.col, ("n", "shared", "at", "other_n", "other_shared", "other_at")))
    differ = F.least("low", "other_low") < F.greatest("high", "other_high")
    enough = _in_common(*map(F.col, ("short", "lost", "other_short", "other_lost"))) >= _needed(F.col("n"), F.col("other_n"))
    groups = left.join(right, (left.shingle == right.shingle) & fits & differ & enough).select("group", "other_group").distinct()
    one = members.select("group", F.col("sig").alias("a"), F.col("label").alias("label_a"))
    two = members.select(F.col("group").alias("other_group"), F.col("sig").alias("b"), F.col("label").alias("label_b"))
    pairs = groups.join(one, "group").join(two, "other_group").where("label_a <> label_b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidate_sets(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """``sig, hashes`` of the documents whose signature is in ``candidates``;
    a filter of bounded size keeps most others out of the shuffle."""
    place = F.col("sig").bitwiseAND(FILTER_BITS - 1)
    words = candidates.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(sig & {FILTER_BITS - 1} & 63 as int))").alias("bit"))
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    told = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits[told["word"].to_numpy(dtype=np.int64)] = told["bits"].to_numpy(dtype=np.int64)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def rows(part, texts):
        sets = {}
        for t in texts:
            own = shingle_set(t)
            if len(own):
                sig = signature(own)
                at = sig & (FILTER_BITS - 1)
                if int(shared.value[at >> 6]) >> (at & 63) & 1:
                    sets[sig] = own.tobytes()
        return pa.RecordBatch.from_arrays([longs(list(sets)), pa.array(list(sets.values()), pa.binary())], ["sig", "hashes"]) if sets else None

    hashed = map_texts(df, "text", rows, "sig bigint, hashes binary")
    return hashed.join(candidates, "sig", "left_semi").groupBy("sig").agg(F.first("hashes").alias("hashes"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with Jaccard similarity >= 3/4.

    A document ``a`` meets all its partners; its set is sent once per ``STAR``
    of them, each partner's set once per pair."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("stars"))
    partners = pairs.join(stars, "a").withColumn("star", F.pmod(F.xxhash64("b"), F.col("stars")).cast("int")).join(sets.withColumnRenamed("sig", "b"), "b").select("a", "star", "b", "hashes")
    centres = stars.join(sets.withColumnRenamed("sig", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("stars") - 1)).alias("star"), F.lit(None).cast("bigint").alias("b"), "hashes")
    met = centres.union(partners).repartition("a", "star").sortWithinPartitions("a", "star", F.col("b").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b, shared = [], [], []
            for x, y, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "hashes"))):
                other = np.frombuffer(raw, dtype="<u8")
                if y is None:
                    own = other
                    continue
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= 75 * (len(own) + len(other) - common):
                    a.append(x)
                    b.append(y)
                    shared.append(common)
            yield pa.RecordBatch.from_arrays([longs(a), longs(b), longs(shared)], ["a", "b", "shared"])

    return met.mapInArrow(run, "a bigint, b bigint, shared bigint")


def _prepared(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, ...]:
    """Per row ``doc_id, sig, n``; groups of prefixes, the lists of their
    shingles, members with themselves as label, and the members' sets."""
    docs = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    profiled = materialize(_profiled(docs), "profiles")
    known = profiled.where(F.col("place").isNull()).select("doc_id", "sig", "n")
    sketch = _sketch(profiled)
    grouped = materialize(_grouped(materialize(_postings(docs.select("text"), sketch, int(sketch.sum())), "prefixes")), "grouped")
    lists = grouped.dropDuplicates(["group"]).select("group", "n", F.size("prefix").alias("shared"), F.posexplode("prefix").alias("at", "shingle"))
    members = grouped.select("group", "sig", F.col("sig").alias("label"))
    return known, grouped, lists, members, materialize(_candidate_sets(docs.select("text"), members.select("sig")), "sets")


def jaccard_links(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: links ``a, b, n_shared`` (a < b; classes, each named by
    its smallest id), all verified on whole sets, and the membership ``doc_id,
    n_shingles, class_id, n_links`` with each row's number of other rows linked
    directly, rows of its own class included; documents without words are
    classes of their own without links.

    Every link is an output row, so near copies of one text cost work in
    proportion to the pairs of their different sets; ``near_duplicates``
    spares them."""
    known, grouped, lists, members, sets = _prepared(df, id_column, text_column)
    found = materialize(_linked(materialize(_rest(lists, grouped, members), "pairs"), sets), "links")
    classes = materialize(known.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")), "classes")
    one, two = classes.toDF("a", "class_a", "rows_a"), classes.toDF("b", "class_b", "rows_b")
    named = found.join(one, "a").join(two, "b")
    links = named.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), F.col("shared").alias("n_shared"))
    both = named.select(F.col("a").alias("sig"), F.col("rows_b").alias("others")).unionByName(named.select(F.col("b").alias("sig"), F.col("rows_a").alias("others")))
    counted = classes.join(both.groupBy("sig").agg(F.sum("others").alias("others")), "sig", "left")
    told = known.join(counted.select("sig", "class_id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "sig", "left")
    own = F.col("sig").isNull()
    return links, told.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``, the smallest id that
    links reach."""
    known, grouped, lists, members, sets = _prepared(df, id_column, text_column)
    labels = None
    for turn in range(PIVOT_ROUNDS + 1):
        pairs = materialize(_pivots(lists, members, turn) if turn < PIVOT_ROUNDS else _rest(lists, grouped, members), "pairs")
        links = _linked(pairs, sets)
        # links between labels, which are documents themselves
        label = members.select(F.col("sig").alias("node"), "label")
        ends = links.join(label.toDF("a", "x"), "a").join(label.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        merged = components(ends).toDF("label", "merged")
        members = materialize(members.join(merged, "label", "left").select("group", "sig", F.coalesce("merged", "label").alias("label")), "members")
        labels = members.select("sig", "label")
    classes = known.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("least"))
    placed = classes.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    reached = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = materialize(placed.join(reached, "label").select("sig", "component_id"), "classes")
    told = known.join(of_class, "sig", "left")
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
