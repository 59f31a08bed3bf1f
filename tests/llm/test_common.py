"""The worker's chunk table: right values, bounded bytes."""

import random
import re

from pyspark.sql import functions as F

from basketry.llm.common import ChunkTable, even_labels, held_bytes


def texts(pick):
    cjk = "".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    base64 = " ".join("".join(pick.choices("ABCDEFabcdef0123456789+/", k=pick.choice([20, 60, 500]))) for _ in range(60))
    return [cjk, base64, " ".join(f"w{pick.randint(0, 3000)}" for _ in range(500)), ""]


def test_values_and_bytes():
    pick = random.Random(1)
    calls = []

    def encode(chunks):
        calls.extend(chunks)
        return [(len(c), c.upper()) for c in chunks]

    table = ChunkTable(re.compile(r"\S+").findall, encode, limit=400_000, longest=64)
    for _ in range(60):
        batch = texts(pick)
        assert table.lookup(batch) == [[(len(c), c.upper()) for c in t.split()] for t in batch]
        held = [*table.young.items(), *table.old.items()]
        assert sum(held_bytes(c, v) for c, v in held) <= 400_000
        assert all(len(c) <= 64 for c, _ in held)
    assert len(calls) < 60 * 500  # common chunks are not encoded again


def test_used_chunks_outlive_the_younger_half():
    seen = []
    table = ChunkTable(str.split, lambda chunks: seen.extend(chunks) or [len(c) for c in chunks], limit=40_000)
    for i in range(300):
        table.lookup([f"often x{i} y{i} z{i}"])
    assert seen.count("often") < 10


def test_even_labels_go_to_a_partition_each(spark):
    for tasks in (1, 7, 64):
        labels = even_labels(spark, tasks)
        dealt = spark.createDataFrame([(x,) for x in labels], "part int").repartition(tasks, "part").select(F.spark_partition_id().alias("to")).distinct()
        assert len(set(labels)) == tasks == dealt.count()
