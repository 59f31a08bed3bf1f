"""Operator 13 against SQL and against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np

from basketry.llm import collocations
from basketry.llm.queries import OP13_SQL, op13_collocations
from tests.conftest import SF_SMALL
from tests.llm.cases import empty_documents, odd_documents, odd_rows
from tests.oracle_harness import compare, duck


def test_query_equals_sql(spark):
    assert compare("op13", spark, duck(SF_SMALL), SF_SMALL, op13_collocations, OP13_SQL)["status"] == "OK"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, w[i:i + m]) for i in range(len(w) - m + 1))
    return f, n


def brute(rows, least, keep):
    f, n = counts(rows)
    candidates = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    inside = set()
    for (lang, w), c in candidates.items():
        for m in range(2, len(w)):
            inside.update((lang, w[i:i + m]) for i in range(len(w) - m + 1) if 100 * c >= 100 * f[lang, w[i:i + m]])
    out = []
    for lang in {p[0] for p in candidates}:
        scored = []
        for (other, w), a in candidates.items():
            if other == lang and (lang, w) not in inside:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(scored)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(seed, n=300):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünit", "it's", "中文", "x\xa0y", "W1"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(pick.randint(0, 40)):
            words.append(pick.choice(vocabulary[: pick.choice([3, 17])]))
            words.append(pick.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "; "]))
        rows.append((i, "".join(words), pick.choice(["en", "en", "de", None, ""]), None, None))
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_equals_plain_counting(spark):
    rows = texts(1)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", n int, f int").repartition(5)
    for least, keep in ((5, 2000), (3, 7)):
        found = sorted(tuple(r) for r in collocations.mine(df, least, keep, filter_bits=14).collect())
        assert len(found) > 10 and found == brute(rows, least, keep)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PHRASES", 40)
    rows = [(i, t, lang if lang != "de" else "d\\n\ne\\b", *rest) for i, t, lang, *rest in texts(2, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in collocations.mine(df, 4, 100, filter_bits=9).collect()) == brute(rows, 4, 100)


def test_odd_and_empty_tables(spark):
    found = collocations.mine(odd_documents(spark), 4, 50, filter_bits=14)
    assert sorted(tuple(r) for r in found.collect()) == brute(odd_rows(), 4, 50)
    assert collocations.mine(empty_documents(spark)).collect() == []


def test_stretches_count_every_ngram_once():
    text = " ".join(t for _, t, *_ in texts(3, 40)).encode()
    f, n = counts([(0, text.decode(), "en")])
    bits = np.full(1 << 9, 255, np.uint8)
    for limit in (1, 5, 50, 10**6):
        told, hashes, size = Counter(), Counter(), 0
        for words in collocations.stretches(text, limit):
            size += len(words.ids) - words.seen
            for h in collocations.ngram_hashes(words, "en"):
                hashes.update(h.tolist())
            for _, phrases, c in collocations.counted_phrases(words, "en", bits, 12):
                told.update(dict(zip(phrases, c.tolist())))
        assert size == n["en"]
        assert told == Counter({" ".join(w): c for (_, w), c in f.items()})
        assert sorted(hashes.values()) == sorted(f.values())


def test_summaries_lose_no_frequent_entry(monkeypatch):
    monkeypatch.setattr(collocations, "BUFFER", 500)
    pick = np.random.default_rng(4)
    least, parts = 20, []
    for _ in range(40):
        x = np.sort(np.concatenate([pick.integers(0, 1 << 32, 300), pick.choice(50, 30, p=np.arange(1, 51) / 1275)]).astype(np.uint64))
        parts.append(x)
    mass = sum(len(x) for x in parts)
    summary = collocations.Summary(mass // least + 1)
    for x in parts:
        prints, at = collocations.runs(x)
        summary.add(*collocations.unpack(collocations.pack(prints, np.diff(at, append=len(x)))))
    kept = set(summary.survivors(least).tolist())
    true = Counter(np.concatenate(parts).tolist())
    frequent = {p for p, c in true.items() if c >= least}
    assert frequent and frequent <= kept
    assert 0 < summary.subtracted < least and len(summary.counts) <= summary.capacity
    assert len(kept) < len(true) / 10


def test_products_beyond_64_bits(spark, monkeypatch):
    """Scores are exact where 1000 * a * n and l * r pass 64 bits."""
    a, l, r, n = 3_000_000_007, 4_000_000_009, 5_000_000_011, 7_000_000_000_003
    rows = [("en", 0, "", n), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    monkeypatch.setattr(collocations, "survivors_filter", lambda *_: None)
    monkeypatch.setattr(collocations, "frequent_phrases", lambda docs, *_: docs.sparkSession.createDataFrame(rows, "lang string, n int, phrase string, f bigint"))
    assert [tuple(r) for r in collocations.mine(empty_documents(spark)).collect()] == [("en", 1, "x y", a, l, r, n, 1000 * a * n // (l * r))]
