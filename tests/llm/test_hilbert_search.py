import itertools

import numpy as np

from pairforge.llm import hilbert_search as hs
from pyspark.sql import functions as F


def test_curve_is_a_hilbert_curve():
    """All cells once, and neighbours along the curve differ by one step on one axis."""
    for axes, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = hs.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i in queries:
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
            best = [(d[j], ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = best
    return out


def results(df, **kw):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return out


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    got = results(hs.search(e, F.col("vec_id") % 100 == 0, least_window=100))
    hit = [len({i for _, i in want[q]} & {v for _, _, v in got[q]}) / 10 for q in want]
    assert np.mean(hit) >= 0.9
    exact = results(hs.search(e, F.col("vec_id") % 100 == 0))
    for q in want:
        assert [v for _, _, v in exact[q]] == [i for _, i in want[q]]
        assert np.allclose([s for _, s, _ in exact[q]], [d for d, _ in want[q]], rtol=0, atol=1e-12)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(300)] + [(i, rng.normal(size=3).round(1).tolist()) for i in range(300, 500)]
    bad = [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 2.0]), (1300, [float("nan"), 1.0, 1.0]), (1400, [float("inf"), 0.0, 1.0]),
           (1500, []), (1600, [1.0]), (None, same)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + bad + rows[:3]], "vec_id long, embedding array<double>, score double, rank int")
    got = results(hs.search(df, F.col("vec_id") % 100 == 0, least_window=2000))
    want = brute([r for r in rows if any(r[1])], {i for i, _ in rows if i % 100 == 0})
    assert set(got) == set(want)
    for q in want:
        assert [v for _, _, v in got[q]] == [i for _, i in want[q]] and [r for r, _, _ in got[q]] == list(range(1, 11))
    few = spark.createDataFrame(rows[:1] + rows[300:303], "vec_id long, embedding array<double>")
    assert [len(x) for x in results(hs.search(few, F.col("vec_id") == 0)).values()] == [3]
    assert hs.search(df.limit(0), F.col("vec_id") == 0).count() == 0
