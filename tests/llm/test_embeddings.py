"""Operators on vectors against brute force: nulls, ties, copies, lengths that differ, clashing columns, empty tables."""

import itertools
import math
import os
from fractions import Fraction

import numpy as np
import pytest

from evidora.llm import binary_codes, hard_negatives, queries, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n long, c long, at int, key string, node string, tag string, block int, score double, rank int, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, 3, "k", "n", "t", 4, 0.5, 6, 7) for i, v, y in rows], SCHEMA).repartition(3)


def rows_with_everything(seed=1, width=6):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 1, width).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(230)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(60)]  # equal vectors: ties
    rows += [rows[50], rows[51], (50, rows[7][1], 1)]  # repeated rows, and one id with two vectors
    rows += [(400, None, 1), (401, [0.1, None] + [0.0] * (width - 2), 1), (402, [float("nan")] * width, 2), (403, [float("inf")] * width, 0), (404, [1.0] * width, None), (None, [0.5] * width, 1)]
    rows += [(450, [0.0] * width, 1), (451, [0.0] * width, 2), (452, [], 1), (500, [2.0, -1.0], 1), (501, [2.0, -1.0], 0), (550, [3.0e38] * width, 2), (551, [-3.0e38] * width, 2)]
    return rows


def whole(v, scale, width):
    return [math.floor(scale * float(x)) for x in v] + [0] * (width - len(v))


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows):
    width = max(len(v) for _, v, _ in rows if v is not None)
    seen = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(v)) for i, v, y in rows if i is not None and y is not None and usable(v)}
    known = [(i, y, whole(v, 256, width)) for i, y, v in sorted(seen)]
    out = []
    for a, label, v in known:
        if a % 50:
            continue
        scored = sorted((-max(-hard_negatives.LONG, min(hard_negatives.LONG, sum(x * z for x, z in zip(v, w)))), i, y) for i, y, w in known if i != a or y != label)
        for s, i, _ in [r for r in scored if r[2] == label and r[1] != a][:5]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("step, pack, block", [(2048, 4096, 1 << 23), (7, 64, 200)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, step, pack, block):
    for name, value in (("STEP", step), ("PACK_BYTES", pack), ("BLOCK_BYTES", block), ("CHUNK_ROWS", 64), ("ANCHORS", 2 if step == 7 else 512)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = rows_with_everything()
    got = hard_negatives.contract(table(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute_negatives(rows) and len({r[0] for r in got}) > 3


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.contract(table(spark, [])).count() == 0
    assert hard_negatives.contract(table(spark, [(50, [1.0, 0.0], 1)])).count() == 0  # no other row
    alone = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.5, 0.5], 1)]
    assert hard_negatives.contract(table(spark, alone)).count() == 0  # no other label
    far = [(50, [1.0], 1), (51, [-1.0], 1), (52, [-0.75], 2), (53, [-0.25], 2)]
    assert hard_negatives.contract(table(spark, far)).count() == 0  # windows of negative scores are empty


def test_hard_negatives_equal_sql(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries.op11_hard_negatives(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.OP11_SQL})").fetchall())


def test_percent_bounds():
    s = np.array([-LONG for LONG in (7, 100, 199)] + [0, 1, 99, 100, 101, 12345])
    for p in (0, 50, 95, 100):
        assert [int(x) for x in hard_negatives.percent_floor(s, p)] == [math.floor(Fraction(p * int(x), 100)) for x in s]
        assert [int(x) for x in hard_negatives.percent_ceil(s, p)] == [math.ceil(Fraction(p * int(x), 100)) for x in s]


def brute_links(rows, threshold=0.9):
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if usable(v) and any(v) else None for _, v, _ in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold - 1e-15:
            n[i] += 1
            n[j] += 1
            parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(smallest.get(find(i), d), d)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((d, n[i], smallest.get(find(i)), d == smallest.get(find(i))) for i, (d, _, _) in enumerate(rows)), key=key)


@pytest.mark.parametrize("block, small", [(1024, 64), (8, 64), (8, 4)])
def test_embedding_near_duplicates_equal_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(binary_codes, "BLOCK_ROWS", block)
    monkeypatch.setattr(binary_codes, "SMALL", small)
    rng = np.random.default_rng(5)
    rows = rows_with_everything(3, 24)
    for group in range(6):
        base = rng.normal(0, 1, 24)
        rows += [(1000 + 100 * group + i, (base + rng.normal(0, (0.05, 0.1, 0.2)[group % 3], 24) * (1 + i % 3) / 2).astype(np.float32).tolist(), 1) for i in range(40)]
    rows += [(2000, [4 * x for x in rows[0][1]], 0), (None, rows[0][1], 0), (None, rng.normal(0, 1, 24).tolist(), 0)]
    got = binary_codes.near_duplicates(table(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(map(tuple, got.collect()), key=lambda r: tuple((x is None, x) for x in r))
    assert got == brute_links([(d, None if v is None else np.float32(v).astype(float).tolist() if all(x is not None for x in v) else v, y) for d, v, y in rows])


def test_embedding_near_duplicates_of_nothing(spark):
    assert binary_codes.near_duplicates(table(spark, [])).count() == 0
    none = [(1, None, 1), (2, [0.0], 1), (2, [0.0], 1)]
    assert sorted(map(tuple, binary_codes.near_duplicates(table(spark, none)).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


@pytest.mark.parametrize("width", [2, 64, 200])
def test_codes_estimate_without_bias_and_bounds_hold(width):
    rng = np.random.default_rng(width)
    x, y = rng.normal(0, 1, (2, 4000, width))
    x = binary_codes.units(x)
    y = binary_codes.units(y - (y * x).sum(1)[:, None] * x)
    y = 0.9 * x + math.sqrt(1 - 0.81) * y
    missed, off = 0, []
    for lo in range(0, len(x), 500):
        u = np.vstack((x[lo : lo + 500], y[lo : lo + 500]))
        codes = binary_codes.Codes(binary_codes.encode(u), width, 0.9)
        bound = codes.all_pairs(slice(0, 1000))
        pair = bound[np.arange(500), np.arange(500) + 500]
        assert np.allclose(codes.pairs(np.arange(500), np.arange(500) + 500), pair, atol=1e-5)
        missed += int((pair < 0.9).sum())
        strangers = bound[:500, 500:][~np.eye(500, dtype=bool)]
        off.append((strangers < 0.9).mean())
    assert missed == 0
    assert width < 64 or min(off) > 0.97  # strangers are refuted from codes alone


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    for n, width in ((10_000, 64), (10_000_000, 64), (100_000, 200)):
        k, tables = binary_codes.plan(n, width, 0.9)
        x, y = rng.normal(0, 1, (2, 3000, width))
        x = binary_codes.units(x)
        y = 0.9 * x + math.sqrt(0.19) * binary_codes.units(y - (y * x).sum(1)[:, None] * x)
        met = np.zeros(len(x), bool)
        for t in range(tables):
            met |= np.all([binary_codes.places(x @ binary_codes.rotation(width, 2 + t * k + i)) == binary_codes.places(y @ binary_codes.rotation(width, 2 + t * k + i)) for i in range(k)], axis=0)
        assert met.mean() >= 0.995


@pytest.mark.parametrize("kind", ["random", "clusters", "identity", "low rank", "zero", "wide"])
@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_spectral_divide_and_conquer(kind, n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    e = {"random": rng.random(n), "clusters": np.resize([1.0, 1e-3, 5.0], n), "identity": np.ones(n), "low rank": np.where(np.arange(n) < n // 2, 0, rng.random(n)), "zero": np.zeros(n), "wide": 10.0 ** -np.linspace(0, 12, n)}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.eigen(a)
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-13
    assert np.abs(values - np.sort(e)[::-1]).max() < 1e-13
    assert np.abs(a @ x - x * values).max() < 1e-13
    if n > 1 and kind == "random":
        u = whitening.polar(a - np.median(e) * 1.001 * np.eye(n))
        assert np.abs(u @ u - np.eye(n)).max() < 1e-13


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 90, (rng.normal(0, 0.2, 5) + np.arange(5)).astype(np.float32).tolist(), i % 4) for i in range(100)]
    rows += [(200, None, 1), (201, [0.1, None, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 5, 1), (203, [float("-inf")] * 5, 1), (204, [1.5, 2.5], 0), (None, [0.1, 0.9, 2.2, 3.1, 3.9], 0), (205, [], 0), (206, [1.0e3, 1.0, 2.0, 3.0, 4.0], 0)]
    got = whitening.whiten(table(spark, rows), 4)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    stay = [(i, whole(np.float32(v), 64, 5)) for i, v, _ in rows if usable(v)]
    x = np.array([w for _, w in stay], object) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    d = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(r, sums)] for r in x])
    v = d.T @ d / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    want = d @ q[:, :4] / np.sqrt(e[:4])
    by = {}
    for r in got.collect():
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-9
    assert sum(len(c[1]) for c in by.values()) == n and all(set(c) == {1, 2, 3, 4} for c in by.values())
    flip = np.ones(4)
    for k in range(4):
        at = int(np.abs(want[:, k]).argmax())
        flip[k] = np.sign(by[(stay[at][0], int(deviation[at]))][k + 1][0].whitened * want[at, k])
    for (i, _), dev, w in zip(stay, deviation, want):
        for k in range(4):
            assert any(abs(r.whitened - flip[k] * w[k]) < 1e-6 * (1 + abs(w[k])) for r in by[(i, int(dev))][k + 1])


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None, 1)])).count() == 0
    same = whitening.whiten(table(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)])).collect()
    assert len(same) == 4 and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in same)
    line = whitening.whiten(table(spark, [(1, [0.0, 3.0], 1), (2, [1.0, 3.0], 1)])).collect()
    assert sorted((r.vec_id, r.component, None if r.whitened is None else round(abs(r.whitened), 9), r.explained) for r in line if r.component == 1) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    assert all(r.whitened is None and r.explained < 1e-30 for r in line if r.component == 2)
    huge = whitening.whiten(table(spark, [(1, [3.0e38], 1), (2, [-3.0e38], 1), (3, [0.0], 1)])).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None), (3, 0)}


def test_matrix_of_lists():
    import pyarrow as pa

    m, good = vectors.matrix(pa.array([[1.0, 2.0], None, [], [3.0], [None, 1.0], [float("nan")]], pa.list_(pa.float32())).slice(0))
    assert m.shape == (6, 2) and good.tolist() == [True, False, True, True, False, False]
    assert m[0].tolist() == [1, 2] and m[3].tolist() == [3, 0]
    rows = np.arange(6, dtype=np.int16).reshape(2, 3)
    assert (vectors.from_binary_rows(vectors.binary_rows(rows), np.int16) == rows).all()
