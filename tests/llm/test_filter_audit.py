"""Operator 12 against SQL and against filters run one after the other."""

import re
from itertools import permutations

from basketry.llm import filter_audit
from basketry.llm.queries import OP12_SQL, op12_filter_audit
from tests.conftest import SF_SMALL
from tests.llm.cases import empty_documents, odd_documents, odd_rows
from tests.oracle_harness import compare, duck

LABELS = "doc_id bigint, quality int, toxic int"


def test_query_equals_sql(spark):
    assert compare("op12", spark, duck(SF_SMALL), SF_SMALL, op12_filter_audit, OP12_SQL)["status"] == "OK"


def brute(rows, labels):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    docs = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": doc_id is not None and first[text] < doc_id}
        own = [r for r in labels if doc_id is not None and r[0] == doc_id]
        docs.append((lang or "", fails, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    out, by_filter = [], {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                alone = sum(d[0] == part and [k for k in "ABCDE" if d[1][k]] == [f] for d in docs)
                out.append([part, "".join(order), step, len(left), len(hit), sum(d[1][f] for d in gone), alone, sum(d[2] for d in hit), sum(d[3] for d in hit)])
                by_filter[part, f] = by_filter.get((part, f), 0) + len(hit)
                gone += hit
    return sorted((*r, by_filter[r[0], r[1][r[2] - 1]]) for r in out)


def test_equals_filters_run_in_turn(spark):
    rows = odd_rows()
    prose = " ".join(f"word{i}" for i in range(120))
    rows += [(100 + i, t, lang, None, None) for i, (t, lang) in enumerate(
        [(prose, "de"), (prose, "en"), (prose + " 5%", "de"), (prose.upper(), None), (prose, ""), ("a " * 200, "de"), (prose + " é", "de")])]
    rows.append((100, prose, "de", None, None))
    labels = [(100, 1, 0), (100, None, 1), (101, 0, 1), (103, 1, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, part int, n int").repartition(3)
    result = filter_audit.audit(filter_audit.weigh(filter_audit.masks(df), spark.createDataFrame(labels, LABELS)))
    assert sorted(tuple(r) for r in result.collect()) == brute(rows, labels)


def test_odd_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    found = filter_audit.masks(odd_documents(spark))
    assert sorted(tuple(r) for r in filter_audit.audit(filter_audit.weigh(found, none)).collect()) == brute(odd_rows(), [])
    assert filter_audit.audit(filter_audit.weigh(filter_audit.masks(empty_documents(spark)), none)).collect() == []


def test_long_texts_are_read_in_stretches(monkeypatch):
    text = (" ".join(f"w{i % 850}" for i in range(1000)) + "\n\x0b é ").encode()
    whole = filter_audit.content_mask(text)
    for stretch in (1, 7, 100):
        monkeypatch.setattr(filter_audit, "_STRETCH", stretch)
        assert filter_audit.content_mask(text) == whole
