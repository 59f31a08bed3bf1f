"""Operators 9 and 10 by held-out accuracy, and the pipeline stage by stage."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import language_id, quality
from basketry.llm.queries import op9_language_id, op10_quality
from tests.llm.cases import empty_documents, odd_documents, odd_rows
from tests.llm.test_join import brute

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows)


def test_language_odd_rows(spark):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = language_id.predict(odd_documents(spark), model).collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r for r in got}
    for doc_id in (1, 2, 3, 4):  # null, empty, white space
        assert tuple(by_id[doc_id][1:]) == ("und", 0.0, True)
    assert language_id.predict(empty_documents(spark), model).count() == 0
    none = language_id.fit(empty_documents(spark))
    assert {r.lang_pred for r in language_id.predict(odd_documents(spark), none).collect()} == {"und"}
    other = spark.createDataFrame([(0, "Привет мир это текст"), (1, "12345 !!! 678")], "doc_id bigint, text string")
    assert [r.rejected for r in language_id.predict(other, model).orderBy("doc_id").collect()] == [True, True]


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op10_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_quality_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), sample=200)
    got = quality.score(odd_documents(spark), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # null is empty
    assert quality.score(empty_documents(spark), model).count() == 0
    unlabelled = quality.fit(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, quality int"))
    assert {r.score for r in quality.score(docs.limit(5), unlabelled).collect()} == {0.5}


def test_machine_equals_all_pairs():
    machine = quality.Machine(40, 3)
    pick = np.random.default_rng(1)
    machine.linear, machine.bias = pick.normal(size=40), 0.3
    places, x = np.array([3, 7, 11, 30]), np.array([0.5, -1.0, 2.0, 0.25])
    pairs = sum(machine.factors[places[i]] @ machine.factors[places[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(machine.raw(places, x) - (0.3 + machine.linear[places] @ x + pairs)) < 1e-12


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").withColumn("score", F.lit("clash"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before, docs
    for name in ("language_id", "quality", "near_duplicates", "secrets"):
        assert kept[name][1].columns == kept["language_id"][0].columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(kept["language_id"][1]) == ids(kept["language_id"][0])  # all are clean
    told = {i: q for i, q in labels.items() if q is not None and i < 300}
    assert ids(kept["quality"][1]) & set(told) == {i for i, q in told.items() if q == 1}
    before, after = kept["near_duplicates"]
    groups = {}
    for doc_id, _, component in brute([(r.doc_id, r.text) for r in before.collect()]):
        groups.setdefault(component, set()).add(doc_id)
    left = ids(after)
    assert all(len(g & left) == 1 for g in groups.values())
    masked = {r.doc_id: r for r in kept["secrets"][1].collect()}
    assert set(masked) == left and all(r.n_chars == len(r.text) for r in masked.values())
    assert not any("AKIA" in r.text for r in masked.values())
    assert {r.doc_id for r in docs.collect()} == left


def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path):
    for place, table in (("odd", odd_documents(spark)), ("none", empty_documents(spark))):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{place}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{place}/{name}")


def test_an_id_with_many_rows_counts_once_in_the_samples(spark):
    rows = [(i % 40, f"the text of row {i % 40} in plain words", "en" if i % 2 else "de") for i in range(40)]
    few = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    many = few.unionByName(few.where("doc_id = 7").crossJoin(spark.range(500)).select(*few.columns))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    a, b = (quality.fit(df, labels) for df in (few, many))
    assert np.allclose(a["mean"], b["mean"]) and np.allclose(a["spread"], b["spread"])
    a, b = (language_id.fit(df.withColumn("lang", F.lit("en"))) for df in (few, many))
    assert len(a["centres"]) == len(b["centres"])
