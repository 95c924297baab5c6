import numpy as np
import pytest

from pairforge.llm import negatives as ng
from pyspark.sql import functions as F


def brute(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, vector), one an id."""
    ints = [(i, y, [int(np.floor(256 * np.float64(x))) for x in v]) for i, y, v in rows]
    out = []
    for a, ya, q in ints:
        if a not in anchors:
            continue
        scored = [(sum(x * z for x, z in zip(q, v)), i, y) for i, y, v in ints if i != a]
        near = sorted(((-s, i) for s, i, y in scored if y == ya))[:positives]
        for s, p in near:
            s = -s
            hard = sorted((-t, i) for t, i, y in scored if y != ya and low * s <= 100 * t <= high * s)[:negatives]
            out += [(a, p, r + 1, i, s, -t) for r, (t, i) in enumerate(hard)]
    return sorted(out)


COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def found(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def mine(df, **kw):
    return ng.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), **kw)


def test_str_order_makes_tight_leaves():
    x = np.random.default_rng(0).random((1000, 3))
    at = ng.str_order(x, [0, 1], 10)
    assert sorted(at.tolist()) == list(range(1000))
    packed, random = ng.Tree(x[at], leaf=10), ng.Tree(x, leaf=10)
    area = lambda t: (t.high - t.low)[t.inner:, :2].prod(axis=1).mean()
    assert area(packed) < area(random) / 20


def test_intervals_hold_every_inner_product():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-9, 9, (500, 4)).astype(float), rng.integers(-9, 9, (20, 4)).astype(float)
    tree = ng.Tree(x, leaf=16, fanout=3)
    low, high = tree.intervals(q)
    for i, rows in enumerate(tree.rows):
        s = q @ x[rows].T
        assert (low[:, tree.inner + i] <= s.min(axis=1)).all() and (s.max(axis=1) <= high[:, tree.inner + i]).all()
    assert tree.children[0] and (low[:, 0] <= (q @ x.T).min(axis=1)).all()


def test_best_first_visits_few_leaves(monkeypatch):
    """On clustered rows the queue leaves out boxes outside the windows and below the k-th score."""
    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.integers(0, 10, (64, 2)) for c in rng.integers(-2000, 2000, (64, 2))]).astype(float)
    x = x[ng.str_order(x, [0, 1], 32)]
    tree, q, ids = ng.Tree(x, leaf=32), np.array([50.0, -20.0]), np.arange(len(x))
    low, high = tree.intervals(q[None])
    reads = []

    class Seen(list):
        def __getitem__(self, i):
            reads.append(i)
            return super().__getitem__(i)
    tree.rows = Seen(tree.rows)
    scores = x @ q
    windows = [(ng.LEAST, ng.MOST), (0, 1000)]
    got = ng.best_first(tree, x, ids, np.ones(len(x), bool), q, low[0], high[0], windows, 5)
    for (least, most), hits in zip(windows, got):
        ok = [i for i in np.lexsort((ids, -scores)) if least <= scores[i] <= most][:5]
        assert [i for _, i in hits] == ok
    assert len(reads) < len(tree.rows) / 4


@pytest.mark.parametrize("small", [False, True])
def test_rows_match_brute_force(spark, monkeypatch, small):
    """Also with many small tiles, blocks and leaves, a hot label, copies and ties."""
    if small:
        for name, value in (("TILE", 16), ("BLOCK", 4), ("LEAF", 4), ("FANOUT", 2)):
            monkeypatch.setattr(ng, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2, 7])), (rng.integers(-4, 5, 3) / 4).tolist()) for i in range(240)]
    rows += [(i, 3, [0.5, 0.5, 0.25]) for i in range(240, 260)] + [(260, 9, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    assert found(mine(df)) == brute(rows, {i for i, _, _ in rows if i % 10 == 0})


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.9, 0.25]), (3, 2, [0.0, 0.0]), (4, 1, [0.0, 0.0]), (10, 2, [1.0, 0.3])]
    bad = [(20, None, [1.0, 1.0]), (30, 1, None), (40, 1, []), (50, 1, [1.0, None]), (60, 1, [nan, 1.0]), (70, 1, [inf, 1.0]), (80, 1, [1.0]), (None, 1, [1.0, 1.0])]
    again = [(2, 2, [0.9, 0.25]), (1, 5, [1.0, 1.0])]  # a repeated row, and an id that another row has
    schema = "vec_id long, label int, embedding array<double>, id long, at long, score double, rank int, block int, tile int"
    df = spark.createDataFrame([(*r, 1, 2, 0.5, 3, 4, 5) for r in rows + bad + again], schema)
    assert found(mine(df)) == brute(rows, {0, 10})
    assert mine(df.limit(0)).count() == 0 and mine(df.filter("vec_id = 0")).count() == 0
    assert mine(df.filter("vec_id in (1, 2)")).count() == 0  # no anchor


def test_huge_components_are_exact(spark):
    """Inner products beyond the integers of a double; components beyond a long are cut to its range."""
    rows = [(i, i % 2, [float(2 ** 20 + i), float(2 ** 20 - 2 * i)]) for i in range(0, 40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(mine(df)) == [r for r in brute(rows, {0, 10, 20, 30})]
    far = spark.createDataFrame(rows + [(100, 0, [1e300, -1e300]), (101, 1, [1e300, 0.0])], "vec_id long, label int, embedding array<double>")
    assert mine(far).count() > 0
