"""op12 against brute force: recall, exact scores and order, odd vectors, hot buckets, and the exact way."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import ann, queries

from .conftest import SF


def brute(rows, k=10):
    """{query: [(distance, id)]} of rows (id, vector)."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q is None or q % 100:
            continue
        best = out.setdefault(q, {})
        for i, y in good:
            if i != q and len(x) == len(y):
                d = math.sqrt(((x - y) ** 2).sum())
                best[i] = min(best.get(i, math.inf), d)
    return {q: sorted(((d, i) for i, d in best.items()), key=lambda p: (p[0], p[1] is None, p[1] or 0))[:k] for q, best in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, wanted):
    return np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in best}) / len(best) for q, best in wanted.items() if best])


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_and_exact_scores(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    got = found(queries.QUERIES["op12_nearest_neighbours"](spark, sf))
    assert recall(got, brute(rows)) >= 0.95
    for q, best in got.items():
        assert len(best) == 10 and best == sorted(best)
        assert all(d == pytest.approx(math.sqrt(((vectors[q] - vectors[i]) ** 2).sum()), abs=1e-12) and i != q for d, i in best)


def clustered(n=4000, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20, dim)) * 4
    return [(i, (centres[i % len(centres)] + rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


def test_clustered_vectors_are_found_in_few_buckets(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(found(ann.search(df, F.col("vec_id") % 100 == 0)), brute(rows)) >= 0.9
    model = ann.fit(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k=10)
    x = np.array([v for _, v in rows], dtype=np.float64)
    cells = np.floor(model.cells(x)).astype(np.int64)
    keys = [model.keys(24, t, cells[:, t]) for t in range(2)]
    seen = [sum(np.isin(keys[t], p).sum() for t, p in enumerate(model.probes(model.cells(x[i : i + 1])[0], 24, model.radii(x[i : i + 1], 24)[0]))) for i in range(0, 4000, 100)]
    assert np.mean(seen) < 0.35 * len(rows)  # of both tables


def test_probes_fall_in_chance_and_reach_the_target(spark):
    rng = np.random.default_rng(2)
    model = ann.Model({8: 10_000}, {8: rng.standard_normal((500, 8)).astype(np.float32)}, 10, 1, 2.5, 0.9, 16_384)
    hits = []
    for _ in range(400):
        q = rng.standard_normal(8)
        radius = float(model.radii(q[None], 8)[0])
        p, steps = model._order(model.cells(q[None])[0, 0], model.w[8] / radius)
        assert (np.diff(p) <= 1e-15).all() and len(np.unique(steps, axis=0)) == len(steps)
        u = rng.standard_normal(8)
        y = q + u / np.linalg.norm(u) * radius
        if probes := model.probes(model.cells(q[None])[0], 8, radius):  # far-off queries take the exact way
            hits.append(bool(np.isin(model.keys(8, 0, np.floor(model.cells(y[None])[0]).astype(np.int64)), probes[0]).all()))
    assert len(hits) > 300
    assert np.mean(hits) >= 0.85


def test_hot_buckets_are_split_and_copies_collapse(spark):
    rows = clustered(1500) + [(10_000 + i, [1.0] * 24) for i in range(700)] + [(20_000 + i, [1.0 + 1e-3 * (i % 9), *[1.0] * 23]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, wanted = found(ann.search(df, F.col("vec_id") % 100 == 0, per=64)), brute([(i, np.float32(v).tolist()) for i, v in rows])
    assert recall(got, wanted) >= 0.9
    for q in (10_000, 10_300):  # ties go to the smaller id
        assert [i for _, i in got[q]] == [i for i in range(10_000, 10_012) if i != q][:10]
    assert ann.representatives(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10).count() <= 1500 + 11 + 9 * 11


ODD = [
    (0, [1.0, 2.0]), (0, [5.0, 5.0]), (100, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]),
    (None, [1.0, 2.0]), (None, [9.0, 9.0]), (8, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 4.0]), (300, [1.0] * 7), (9, [1.0, 2.5]), (9, [1.0, 2.5]), (-100, [3.0, 3.0]), (400, [0.0, 0.0]), (500, None),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    df = spark.createDataFrame(ODD, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("mine") for c in ("id", "v", "key", "part", "score", "rank", "asks")})
    got, wanted = found(ann.search(df, F.col("vec_id") % 100 == 0)), {q: b for q, b in brute(ODD).items() if b}
    assert {q: [i for _, i in b] for q, b in got.items()} == {q: [i for _, i in b] for q, b in wanted.items()}
    assert ann.search(df.filter("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_unreachable_targets_take_the_exact_way(spark):
    rows = clustered(600)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.search(df, F.col("vec_id") % 100 == 0, most=1, per=50))
    assert {q: [i for _, i in b] for q, b in got.items()} == {q: [i for _, i in b] for q, b in brute([(i, np.float32(v).tolist()) for i, v in rows]).items()}
