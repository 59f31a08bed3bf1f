"""Operator 8 against SQL and against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import ngram_join
from basketry.llm.components import components
from basketry.llm.queries import OP8_SQL, op8_ngram_jaccard
from basketry.llm.shingles import shingle_set, word_hashes
from tests.conftest import SF_SMALL
from tests.llm.cases import empty_documents, odd_documents, odd_rows
from tests.oracle_harness import compare, duck


def test_query_equals_sql(spark):
    assert compare("op8", spark, duck(SF_SMALL), SF_SMALL, op8_ngram_jaccard, OP8_SQL)["status"] == "OK"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered)


def plain_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                label[root(i)] = root(j)
    reached = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            reached[root(i)] = min(reached.get(root(i), doc_id), doc_id)
    return sorted(((rows[i][0], len(x), reached.get(root(i)) if x else rows[i][0]) for i, x in enumerate(sets)), key=repr)


def test_shingles_are_those_of_the_words():
    pick = random.Random(2)
    parts = ["a", "B", "b", "é", "İ", " ", " ", "\n", "\t", "\x0b", "\x1c", "word", "中"]
    for _ in range(2000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 30)))
        assert len(word_hashes(text)) == len(words(text))
        assert len(shingle_set(text)) == len(plain_set(text)), repr(text)


def edited(pick, text, changes):
    w = text.split()
    for _ in range(changes):
        w[pick.randrange(len(w))] = f"edit{pick.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize("heavy", [ngram_join.HEAVY_LEAST, 3])
def test_groups_of_copies_of_all_sizes(spark, monkeypatch, heavy):
    """Chains and stars of near copies, a common passage, and many documents
    that nearly link; with a low bound most shingles are heavy."""
    monkeypatch.setattr(ngram_join, "HEAVY_LEAST", heavy)
    monkeypatch.setattr(ngram_join, "HEAVY_TIMES", 0 if heavy == 3 else ngram_join.HEAVY_TIMES)
    pick = random.Random(heavy)
    fresh = lambda n: " ".join(f"w{pick.randrange(10 ** 6)}" for _ in range(n))
    passage, rows = fresh(60), []
    for _ in range(6):
        base = fresh(pick.randint(6, 90))
        for _ in range(pick.randint(2, 25)):
            rows.append(edited(pick, base, pick.randint(0, 3)))
    chain = fresh(100)
    for _ in range(12):
        chain = edited(pick, chain, 1)
        rows.append(chain)
    rows += [f"{fresh(pick.randint(5, 70))} {passage}" for _ in range(40)]
    rows += ["a b c", "A  b\nc", "a b", "a b c d", "a b c d e", None, "", " "]
    pick.shuffle(rows)
    table = list(enumerate(rows))
    got = ngram_join.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string").repartition(6))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(table)


def plain_links(rows):
    """Links between classes of equal sets, by their smallest ids, and per row
    its class and the number of other rows it links with."""
    sets = [plain_set(t) for _, t in rows]
    least = {}
    for (doc_id, _), x in zip(rows, sets):
        least[frozenset(x)] = min(least.get(frozenset(x), doc_id), doc_id)
    pairs, n = set(), [0] * len(rows)
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                n[i], n[j] = n[i] + 1, n[j] + 1
                if x != sets[j]:
                    pairs.add((*sorted((least[frozenset(x)], least[frozenset(sets[j])])), len(x & sets[j])))
    return sorted(pairs), sorted((rows[i][0], len(x), least[frozenset(x)] if x else rows[i][0], n[i]) for i, x in enumerate(sets))


def near_copies(pick):
    fresh = lambda n: " ".join(f"w{pick.randrange(10 ** 6)}" for _ in range(n))
    rows = [edited(pick, base, pick.randint(0, 3)) for base in (fresh(pick.randint(6, 120)) for _ in range(8)) for _ in range(pick.randint(8, 16))]
    rows += rows[:9] + ["a b c", "A  b\nc", None, "", " "]
    pick.shuffle(rows)
    return list(enumerate(rows))


def test_all_links_and_membership(spark):
    table = near_copies(random.Random(8))
    links, members = ngram_join.jaccard_links(spark.createDataFrame(table, "doc_id bigint, text string").repartition(5))
    pairs, told = plain_links(table)
    assert len(pairs) > 50 and sorted(map(tuple, links.collect())) == pairs
    assert sorted(map(tuple, members.collect())) == told
    links, members = ngram_join.jaccard_links(empty_documents(spark))
    assert links.count() == 0 and members.count() == 0
    assert ngram_join.jaccard_links(odd_documents(spark))[1].count() == len(odd_rows())


def test_candidates_of_colliding_shingles(spark, monkeypatch):
    """With 13 bits for 48 many shingles of a text collide; no link is lost."""
    monkeypatch.setattr(ngram_join, "_LOW48", np.uint64((1 << 13) - 1))
    table = near_copies(random.Random(4))
    got = ngram_join.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(table)


def test_common_shingles_are_never_counted_short(spark):
    one = spark.createDataFrame([([1, 1 + (1 << 31), 7, 9],)], "p array<bigint>").select(*ngram_join._short(F.col("p")))
    two = spark.createDataFrame([([1, 1 + (1 << 31), 7, 8],)], "p array<bigint>").select(*ngram_join._short(F.col("p"))).toDF("other_short", "other_lost")
    columns = map(F.col, ("short", "lost", "other_short", "other_lost"))
    assert one.join(F.broadcast(two)).select(ngram_join._in_common(*columns)).first()[0] == 3


def test_odd_rows(spark):
    got = sorted(map(tuple, ngram_join.near_duplicates(odd_documents(spark)).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in odd_rows()])
    assert ngram_join.near_duplicates(empty_documents(spark)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, 101), (105, 101), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 101: 100, 105: 100, 200: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packed_shingles_round_trip():
    x = np.array([0, 1, (1 << 48) - 1, 1 << 33], dtype=np.uint64)
    assert ngram_join._from_six(ngram_join._six_bytes(x)).tolist() == x.tolist()
