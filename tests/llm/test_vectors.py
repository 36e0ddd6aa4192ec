"""Hard negatives and near-duplicate vectors against brute force: nulls, odd numbers, ties, copies, repeated rows, several dimensions, empty tables."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinloom.llm import metric, mining
from kinloom.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, v string, cell int, group int, norm double"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def some_vectors(seed, n=400, dim=6):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(12, dim))
    rows = []
    for i in range(n):
        x = base[i % 12] * 10 ** rnd.uniform(-1, 1) + rnd.normal(size=dim) * rnd.choice([0.0, 0.05, 0.3, 1.0])
        rows.append((i, [float(y) for y in np.float32(x)], int(i % 12 // 3) if i % 9 else 1))
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(30)]  # copies
    rows += [(n + 50, None, 1), (n + 100, [float("nan")] * dim, 1), (n + 150, [1.0, None] * (dim // 2), 1), (n + 200, [0.0] * dim, 1), (n + 250, rows[3][1], None), (n + 300, [], 1), (n + 350, [float("inf")] + [1.0] * (dim - 1), 2)]
    rows += [(n + 400 + 10 * k, [1.0 + k / 50, 2.0], 1 + k % 2) for k in range(20)]  # another dimension
    rows += [rows[7], rows[7], (11, [0.5] * dim, 0)]
    return [(*r, 1, "v", 2, 3, 0.5) for r in rows] + [(None, rows[2][1], 1, 1, "v", 2, 3, 0.5), (None, None, None, None, None, None, None, None)]


def mined_by_hand(rows):
    best = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or not x or any(y is None or not math.isfinite(y) for y in x):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * y) for y in x])
        best[i] = min(best.get(i, r), r)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = set()
    for a, (label, x) in best.items():
        if a % 50 == 0:
            others = sorted((-dot(x, y), j, m) for j, (m, y) in best.items() if j != a and len(y) == len(x))
            for p, j, m in [o for o in others if o[2] == label][:5]:
                found = [(-s, k) for s, k, m in others if m != label and -50 * p <= -100 * s <= -95 * p]
                out |= {(a, j, rank, k, -p, s) for rank, (s, k) in enumerate(found[:3], 1)}
    return out


@pytest.mark.parametrize(("seed", "bucket"), [(1, 2_048), (2, 16), (3, 1)])
def test_hard_negatives(spark, scratch, tmp_path, seed, bucket):
    rows = some_vectors(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mining.mined(mining.usable(table, label, F.transform("embedding", mining.whole)), scratch, bucket=bucket)
    want = mined_by_hand(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 40
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mining.mined(mining.usable(table.limit(0), label, F.col("embedding")), scratch).count() == 0


def test_hard_negatives_by_sql(spark, tmp_path):
    rnd = np.random.default_rng(4)
    pd.DataFrame({"vec_id": range(600), "embedding": list(rnd.normal(size=(600, 4)).astype("f4")), "label": (np.arange(600) % 4).astype("i4")}).to_parquet(tmp_path / "embeddings.parquet")
    got = mining.op11_hard_negatives(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(mining.OP11_SQL).df()[list(got.columns)]
    order = ["anchor_id", "positive_id", "rank"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False)
    assert len(got) > 60


def test_large_numbers_are_exact():
    rnd = random.Random(1)
    for size in (10, 2**20, 2**25, 2**27, 2**40):
        x, y = (np.array([[float(rnd.randrange(-size, size)) for _ in range(5)] for _ in range(4)]) for _ in range(2))
        want = [[max(-(2**56), min(2**56, sum(int(p) * int(q) for p, q in zip(a, b, strict=True)))) for b in y] for a in x]
        assert mining.products(x, y).astype("i8").tolist() == want


def test_low_norms_are_not_sent(spark, scratch):
    """A thousand small vectors, a few great ones: the windows of great anchors reach into few buckets, and tasks multiply few pairs."""
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(2_000, 8))
    x[100:] *= 0.01
    rows = [(i if i < 100 else 1_000_000 + 2 * i + 1, [float(v) for v in np.floor(2_560 * y)], int(i % 2)) for i, y in enumerate(x)]
    use = mining.usable(spark.createDataFrame(rows, "vec_id long, v array<double>, label int"), F.col("label"), F.col("v"))
    buckets = scratch.write(mining.buckets_of(mining.distinct_candidates(use, 6), 50), "buckets")
    tops = [r.top for r in buckets.collect()]
    needs = spark.createDataFrame([(0, 8, float(np.percentile(tops, 90)))], "group int, dim int, need double")
    assert mining.sent(buckets, needs).count() < 0.2 * len(tops)
    anchors = use.filter("vec_id % 50 = 0").toPandas()
    anchors["scores"], anchors["positives"] = [np.array([4_000_000])] * len(anchors), [np.array([1])] * len(anchors)
    _, work = mining.negatives_of(anchors, buckets.toPandas(), 3, 50, 95)
    assert 0 < work < 0.2 * len(anchors) * 2_000


def linked_by_hand(rows, cosine):
    best = {}
    for i, x, label, *_ in rows:
        ok = bool(x) and label is not None and all(y is not None and math.isfinite(y) for y in x) and any(x)
        r = (not ok, (label is not None, label or 0), x if ok else [])
        if i is not None:
            best[i] = min(best.get(i, r), r)
    ids = sorted(best)
    cos = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True)) / (math.sqrt(sum(p * p for p in a)) * math.sqrt(sum(q * q for q in b)))
    near = {i: [j for j in ids if j != i and not best[i][0] and not best[j][0] and best[i][1] == best[j][1] and len(best[i][2]) == len(best[j][2]) and cos(best[i][2], best[j][2]) >= cosine] for i in ids}
    out, seen = {}, set()
    for i in ids:
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                new = [j for j in near[todo.pop()] if j not in group]
                group |= set(new)
                todo += new
            seen |= group
            out |= {j: (j, len(near[j]), i, i == j) for j in group}
    return sorted(out.values())


@pytest.mark.parametrize(("cosine", "chunk", "pivots"), [(0.98, 1_024, None), (0.98, 16, 5), (0.8, 30, 20), (1.0, 8, 1), (0.0, 50, 3)])
def test_vector_neardup(spark, scratch, cosine, chunk, pivots):
    rows = some_vectors(5, n=300)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in metric.linked(table, scratch, cosine, chunk=chunk, pivots=pivots).collect()]
    want = linked_by_hand(rows, cosine)
    if cosine == 1.0:  # rounding decides about multiples of a vector
        assert [r[0] for r in sorted(g for g in got if g[0] is not None)] == [r[0] for r in want]
        return
    assert sorted(g for g in got if g[0] is not None) == want and sum(r[1] for r in want) > 900
    assert [g for g in got if g[0] is None] == [(None, 0, None, True)] * 2
    assert metric.linked(table.limit(0), scratch).count() == 0


def test_vectors_of_great_and_small_numbers(spark, scratch):
    rows = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [5e-324, 0.0], 0), (4, [1e308, 0.0], 0), (5, [1.0, -0.0], 0), (6, [-1.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6)}


def test_few_guests(spark, scratch):
    """Clusters that lie apart send hardly a guest to each other's cells, and every pair within reach is found."""
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(16, 32))
    rows = [(i, [float(y) for y in centres[i % 16] + rnd.normal(size=32) * 0.05], 0) for i in range(3_000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = metric.linked(table, scratch, pivots=16).toPandas()
    x = metric.unit(np.float32([r[1] for r in rows]).astype("f8"))
    assert (got.sort_values("vec_id").n_links.to_numpy() == ((x @ x.T) >= 0.98).sum(1) - 1).all()
    assert spark.read.parquet(scratch.path("copies")).count() < 1.1 * len(rows)
    assert set(got.component_id) == set(range(16))


def test_vector_neardup_by_sql(spark, tmp_path):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(500, 16))
    x[100:300] = x[:20].repeat(10, 0) + rnd.normal(size=(200, 16)) * 0.1
    x[300:340] = x[1]
    pd.DataFrame({"vec_id": range(500), "embedding": list(x.astype("f4")), "label": (np.arange(500) % 3).astype("i4")}).to_parquet(tmp_path / "embeddings.parquet")
    got = metric.op13_vector_neardup(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(metric.OP13_SQL).df()[list(got.columns)]
    pd.testing.assert_frame_equal(got.sort_values("vec_id", ignore_index=True), want.sort_values("vec_id", ignore_index=True), check_dtype=False)
    assert (got.n_links > 0).sum() > 150
