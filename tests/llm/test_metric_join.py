"""Operator 11 against SQL and against all pairs."""

import math
from unittest import mock

import numpy as np
import pytest

from basketry.llm import metric_join
from basketry.llm.queries import OP11_SQL, op11_embedding_near_dedup
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck

SCHEMA = "vec_id bigint, embedding array<float>, label int, gid string, v int, copies int, cell int"


def test_query_equals_sql(spark):
    assert compare("op11", spark, duck(SF_SMALL), SF_SMALL, op11_embedding_near_dedup, OP11_SQL)["status"] == "OK"


def brute(rows, least=0.93):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    part = [r[0] is not None and r[2] is not None and good(r[1]) for r in rows]
    x = [np.array(r[1], dtype=np.float32).astype(float) if p else None for r, p in zip(rows, part)]
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and part[i] and part[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least or np.array_equal(x[i], x[j]):
                    links[i].append(j)
    component = [None] * len(rows)
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component[i] = min(rows[k][0] for k in seen) if part[i] else rows[i][0]
    return sorted(((r[0], len(l), c, r[0] is not None and r[0] == c) for r, l, c in zip(rows, links, component)), key=repr)


def clustered(seed, n=260, dims=6):
    """Tight and loose clusters, scaled and exact copies, in a hot label and others."""
    pick = np.random.default_rng(seed)
    centers = pick.normal(size=(8, dims))
    rows = []
    for i in range(n):
        v = centers[pick.integers(8)] + pick.normal(size=dims) * pick.choice([0.01, 0.3, 1.0])
        rows.append([int(i), (v * pick.choice([1, 1, 1e-3, 1e6])).astype(np.float32).tolist(), int(pick.choice([1, 1, 1, 2, 3]))])
    for i in range(n, n + 60):
        rows.append([i, rows[5][1], rows[5][2]])
    return rows


def odd_rows():
    inf, nan = math.inf, math.nan
    vectors = [None, [], [0.0, 0.0], [-0.0, 1.0], [0.0, 1.0], [None, 1.0], [nan, 1.0], [inf, 1.0], [1.0], [3e38, 3e38], [1e-44, 1e-44], [1.0, 1.0], [-1.0, -1.0]]
    rows = [[i, v, 7] for i, v in enumerate(vectors)]
    return [*rows, *rows[3:5], [None, [1.0, 1.0], 7], [50, [1.0, 1.0], None], [4, [9.0, -1.0], 7], [2, [9.0, -1.0], 7]]


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in metric_join.near_duplicates(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"cell_rows": 12}, {"cell_rows": 12, "chunk_bytes": 6 * 8 * 9}])
def test_equals_all_pairs(spark, kw):
    rows = clustered(3)
    with mock.patch.object(metric_join, "TILE", 7):
        assert found(spark, rows, **kw) == brute(rows)


def test_odd_rows(spark):
    assert found(spark, odd_rows()) == brute(odd_rows())
    assert found(spark, odd_rows(), cell_rows=1) == brute(odd_rows())
    assert found(spark, []) == []


def test_replication_leaves_far_cells_alone(spark):
    """Clusters at right angles: no vector is replicated, and no link is lost."""
    pick = np.random.default_rng(5)
    x = np.repeat(np.eye(6), 40, axis=0) + pick.normal(size=(240, 6)) * 0.01
    groups = spark.createDataFrame([(i, 1, 6, v.tolist(), 1) for i, v in enumerate(x)], "gid bigint, label int, dims int, v array<double>, copies bigint")
    pivots = {(1, 6): np.eye(6)}
    own = metric_join._placed(groups, pivots, math.acos(0.93), None)
    radii = {(r[0], r[1], r[2]): r[3] for r in own.groupBy("label", "dims", "cell").agg({"angle": "max"}).collect()}
    assert metric_join._placed(groups, pivots, math.acos(0.93), radii).count() == 240


def test_pivots_stay_within_their_bytes(spark):
    rows = [(i, i % 3, 4, [float(i), 1.0, 2.0, 3.0], 1) for i in range(900)]
    groups = spark.createDataFrame(rows, "gid bigint, label int, dims int, v array<double>, copies bigint")
    pivots = metric_join.choose_pivots(groups, cell_rows=5, budget_bytes=40 * 32)
    assert 0 < sum(len(p) for p in pivots.values()) <= 80
