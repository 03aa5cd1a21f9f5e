import numpy as np
from pyspark.sql import functions as F

from weftline.llm import embedding_dedup as ed
from weftline.llm.components import connected_components


def plain(rows):
    """Links and groups by comparing all pairs."""
    units = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            units[k] = x / np.linalg.norm(x)
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in units:
        for b in units:
            if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= ed.COSINE:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted(((i, links[k], names.get(find(k), i)) for k, (i, _) in enumerate(rows)), key=str)


def near(rng, center, spread, n):
    return [(center + spread * rng.standard_normal(len(center))).tolist() for _ in range(n)]


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(16).tolist() for _ in range(300)]
    for _ in range(12):
        rows += near(rng, rng.standard_normal(16), 0.03, 5)
    rows += [rows[3], rows[3], [2 * x for x in rows[4]]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [0.0] * 16, [1.0, 0.0], [1.0, 0.01], [1e-200] * 16, [1e200] * 16]
    out = [(k, v) for k, v in enumerate([*rows, *odd])]
    return [*out, out[0], (None, rows[5]), (None, rng.standard_normal(16).tolist())]


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in ed.near_vectors(df).collect()), key=str)


def test_all_links(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("key", "n_links", "cell", "label")])
    assert result(df) == plain(rows)
    kept = {r["vec_id"]: r["kept"] for r in ed.near_vectors(df).where("vec_id is not null").collect()}
    assert [i for i, _, c in plain(rows) if i is not None and (i == c) != kept[i]] == []


def test_cells_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = list(enumerate(near(rng, rng.standard_normal(16), 0.12, 80) + [rng.standard_normal(16).tolist() for _ in range(60)]))
    assert result(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain(rows)


def test_recall_at_the_threshold():
    """Pairs at the threshold itself share a cell, and reach the count, as often as is calibrated."""
    rng = np.random.default_rng(3)
    plan = ed.plan_for(50_000, 0.4)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = ed.COSINE * a + np.sqrt(1 - ed.COSINE**2) * b
    shared = (plan.cells(a, plan.tables) == plan.cells(b, plan.tables)).any(1).mean()
    directions, _ = plan.directions(64, -1)
    counted = ((np.abs((a - b) @ directions) <= ed.WINDOW * ed.SPREAD / 8).sum(1) >= ed.least_count()).mean()
    assert shared > 0.98 and counted > 0.995


def test_sorted_windows_count_as_plain_ones():
    projected = np.random.default_rng(4).standard_normal((150, 8))
    part = np.arange(150)
    plain_counts = (np.abs(projected[:, None] - projected[None]) <= 0.3).sum(2)
    assert (ed.collisions(projected, part, 0.3) == plain_counts).mean() > 0.999


def test_nothing(spark):
    assert ed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    assert result(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")) == [(1, 0, 1)]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    expected = {(n, find(n)) for n in list(up) if find(n) != n}
    found = connected_components(spark.createDataFrame(edges, "a int, b int"))
    assert {tuple(r) for r in found.collect()} == expected
    assert connected_components(spark.createDataFrame([], "a int, b int")).isEmpty()
