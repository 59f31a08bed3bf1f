"""Operator 4 against its definition, row by row."""

import hashlib

from basketry.llm import fingerprint
from basketry.llm.queries import op4_fingerprint
from tests.conftest import SF_SMALL
from tests.llm.cases import empty_documents, odd_documents, odd_rows


def brute(rows):
    """rows of (doc_id, text), ids distinct."""
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + following[:half]
        a, b, c = map(fingerprint.digest, (text, new, following))
        yield (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint.to_hex(a), fingerprint.to_hex(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c))


def test_query_equals_definition(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_fingerprint(spark, SF_SMALL).collect())) == sorted(brute(rows))


def test_many_buckets_and_uneven_ids(spark):
    rows = [(i ** 3 - 5000, f"text number {i} " * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    ordered = fingerprint.with_following(docs, rows_per_bucket=9)
    assert ordered.select("bucket").distinct().count() > 10
    import basketry.llm.fingerprint as module
    small = module.with_following
    try:
        module.with_following = lambda df: small(df, rows_per_bucket=9)
        got = sorted(map(tuple, module.edit_likeness(docs).collect()))
    finally:
        module.with_following = small
    assert got == sorted(brute(rows))


def test_odd_rows(spark):
    got = fingerprint.edit_likeness(odd_documents(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((r[0] is None, r[0] or 0, len(r[1] or "")) for r in odd_rows())
    same = {r.fingerprint for r in got if r.doc_id in (0, 6)}
    assert len(same) == 1  # equal texts have equal fingerprints
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprint.edit_likeness(empty_documents(spark)).count() == 0
    one = fingerprint.edit_likeness(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert one.near_next == 1.0


def test_likeness_is_bounded_and_tells_edits_from_others(spark):
    text = " ".join(f"alpha{i * 7919 % 1013}" for i in range(400))
    other = " ".join(f"omega{i * 104729 % 997}zz" for i in range(400))
    a, b, c = fingerprint.digest(text), fingerprint.digest(text[:-40]), fingerprint.digest(other)
    assert fingerprint.likeness(a, a) == 1.0
    assert fingerprint.likeness(a, b) > 0.8 > fingerprint.likeness(a, c) >= 0.0
    assert fingerprint.likeness(a, fingerprint.digest("")) >= 0.0
