import numpy as np
import pytest

from vistalog.llm import nearvectors as V


def brute(rows, least=0.9):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, root = [0] * len(rows), {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    n[i] += 1
                    n[j] += 1
                    x, y = find(ids[i]), find(ids[j])
                    root[max(x, y)] = min(x, y)
    return {i: (c, find(i)) for i, c in zip(ids, n, strict=True)}


@pytest.mark.parametrize("tile, per_cell", [(2048, 1024), (20, 1024), (20, 10)])
def test_links_equal_brute_force(spark, tile, per_cell):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        centre = rng.normal(size=32)
        rows += [(centre + rng.normal(size=32) * s).tolist() for s in rng.uniform(0, 0.35, 15 if g else 60)]
    rows += [rows[3], rows[3], (np.array(rows[3]) * 2).tolist(), rng.normal(size=8).tolist(), [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [], None, [float("inf")] * 32]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as node", "1 as cell", "2 as links")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_duplicates(df, recall=0.999999, tile=tile, per_cell=per_cell).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("dim", [64, 256, 768])
def test_recall_at_the_threshold_is_the_same_at_both_ends(spark, dim):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9001 * a + np.sqrt(1 - 0.9001**2) * o
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    n = {r["vec_id"]: r["n_links"] for r in V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_cell=64).select("vec_id", "n_links").collect()}
    assert all(n[i] == n[i + 1500] for i in range(1500))
    assert sum(n.values()) / 3000 >= 0.995


def test_tables_grow_slowly_with_the_rows():
    cost = {}
    for rows in (10**5, 10**6, 10**7, 10**8, 10**9):
        axes = V.key_axes(rows, 64, 1024)
        cells = np.prod([2 * m for m in axes])
        assert 200 < rows / cells < 4000
        cost[rows] = V.tables_for(axes, 0.9, 0.999)
    assert cost[10**9] < 40 * cost[10**5]


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors = V.encode(x)
    true = x @ x.T
    assert (V.upper_bounds(x, codes, factors, 4.5) >= true - 1e-6).mean() > 0.9999
    assert abs((V.upper_bounds(x, codes, factors, 0.0) - true).mean()) < 0.001


@pytest.mark.parametrize("dim", [64, 256])
def test_codes_alone_keep_links_and_drop_most_other_pairs(dim):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * (lambda o: o / np.linalg.norm(o, axis=1, keepdims=True))((o := rng.normal(size=x.shape)) - (o * x).sum(1, keepdims=True) * x)
    sides = []
    for v in (x, y):
        codes, factors = V.encode(v)
        sides.append((V.directions(codes, dim) / factors[:, None].astype(np.float32), np.sqrt(1 - factors**2) / factors))
    (a, errors), (b, others) = sides
    reach = V.may_reach(a, errors, b, others.max(), 0.9, 4.5)
    assert reach.diagonal().all()
    assert reach.sum() < 3000 * 1.1


def test_a_pair_is_counted_in_its_first_common_cell():
    axes = V.key_axes(40_000, 16, 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 16))
    cells = V.cells_of(x / np.linalg.norm(x, axis=1, keepdims=True), axes, 3, 4)
    assert cells.shape == (200, 3, 4)
    flat = cells.reshape(200, -1)
    assert (np.diff(flat, axis=1) > 0).all()
    total, number = 3 * np.prod([2 * m for m in axes]), len({int(c) for c in flat.ravel()})
    assert flat.max() < total and number > 100


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = sorted(map(tuple, V.near_duplicates(df).collect()), key=str)
    assert rows == [(5, 1, 5, True), (None, 0, None, False), (None, 1, 5, False)]
    assert V.near_duplicates(df.limit(0)).collect() == []
