"""The inverted file against exact search: recall, lists, parts and edge cases."""

import numpy as np
import pytest

from evidora.operators import dense, ivf
from evidora.plans.adapters import table

SF = "/root/testdata/sf0.1"


def recall(got, want):
    asked = {(r.query_id, r.id) for r in want}
    return len(asked & {(r.query_id, r.id) for r in got}) / len(asked)


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<float>").repartition(3)


def grouped(n, groups, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (groups, width))
    return centre[rng.integers(0, groups, n)] + rng.normal(0, 0.3, (n, width))


@pytest.mark.parametrize("part_rows, pack", [(1 << 16, 64), (50, 7)])
def test_recall_on_groups(spark, monkeypatch, part_rows, pack):
    monkeypatch.setattr(ivf, "PART_ROWS", part_rows)
    monkeypatch.setattr(ivf, "PACK", pack)
    v = frame(spark, grouped(1500, 30))
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = dense.dense_search(v, asked, 10).collect()
    index = ivf.build(v)
    assert index.size() == 39 and index.lists.selectExpr("sum(n) AS n", "sum(size(ids)) AS ids").first().asDict() == {"n": 1500, "ids": 1500}
    got = ivf.search(index, v, asked, 10, probes=8).collect()
    assert recall(got, want) >= 0.95
    every = ivf.search(index, v, asked, 10, probes=39).collect()
    assert recall(every, want) >= 0.999  # codes are nearly exact
    scores = {(r.query_id, r.id): r.score for r in want}
    assert all(abs(scores[r.query_id, r.id] - r.score) < 1e-9 for r in every if (r.query_id, r.id) in scores)
    ranks = sorted((r.query_id, r["rank"]) for r in every)
    assert ranks == [(q, k) for q in range(0, 1500, 20) for k in range(1, 11)]


def test_recall_on_the_table(spark):
    """Queries with an id divisible by 20 against all rows, with the query's parameters."""
    try:
        v = table(spark, SF, "embeddings").selectExpr("vec_id AS id", "embedding")
    except Exception:
        pytest.skip("no test tables")
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = ivf.build(v)
    got = ivf.search(index, v, asked, 30, probes=-(-2 * index.size() // 3)).collect()
    assert recall(got, dense.dense_search(v, asked, 30).collect()) >= 0.9


def test_small_and_odd_tables(spark):
    one = frame(spark, np.ones((1, 4)))
    asked = one.withColumnRenamed("id", "query_id")
    assert [(r.query_id, r["rank"], r.id, r.score) for r in ivf.search(ivf.build(one), one, asked, 3, 1).collect()] == [(0, 1, 0, 1.0)]
    none = one.limit(0)
    assert ivf.search(ivf.build(none), none, asked, 3, 1).count() == 0
    assert ivf.search(ivf.build(one), one, asked.limit(0), 3, 1).count() == 0
    odd = frame(spark, [[0.0] * 4, [1.0, 0, 0, 0], [1.0, 0, 0, 0], [-1.0, 0, 0, 0]])
    got = ivf.search(ivf.build(odd, cells=2), odd, odd.where("id = 1").withColumnRenamed("id", "query_id"), 3, 2).collect()
    assert [(r["rank"], r.id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 1.0), (3, 0, 0.0)]
