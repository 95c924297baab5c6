import collections
import random

import numpy as np
import pytest

from pairforge.llm import graph, jaccard


def brute(rows, k, part, whole):
    """Component (smallest id) and set size of each row, by counting shared shingles of all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    inv = collections.defaultdict(list)
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for x, s in enumerate(sets):
        shared = collections.Counter(y for e in s for y in inv[e])
        for y, o in shared.items():
            if whole * o >= part * (len(s) + len(sets[y]) - o):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
        for e in s:
            inv[e].append(x)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None and sets[x]:
            least[find(x)] = min(i, least.get(find(x), i))
    return collections.Counter((i, len(sets[x]), least.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(rows))


def found(df, **kw):
    return collections.Counter(tuple(r) for r in jaccard.near_classes(df, **kw).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize(("k", "part"), [(3, 90), (5, 80)])
def test_documents_match_brute_force(documents, k, part):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, k=k, part=part) == brute(rows, k, part, 100)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs, k=3, part=90) == brute(rows, 3, 90, 100)
    assert found(no_docs) == collections.Counter()


@pytest.fixture(scope="module")
def copies(spark):
    """One large group of near copies, each with its own changes, among short and cut ones."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(60)] = f"x{rng.randint(0, 99999)}"
        rows.append((1000 - i, " ".join(w[:rng.choice([60, 60, 57, 30, 2])])))
    return rows


@pytest.mark.parametrize("part", [90, 70])
def test_large_clusters_in_chunks(spark, copies, part, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_TEXTS", 20)
    assert found(spark.createDataFrame(copies, "doc_id long, text string"), k=3, part=part) == brute(copies, 3, part, 100)


def test_signature_tree_finds_all_classes():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(0, 2 ** 62, 40).astype(np.uint64)
        sets = []
        for _ in range(80):
            s = base.copy()
            n = rng.integers(0, 8)
            s[rng.integers(0, 40, n)] = rng.integers(0, 2 ** 62, n).astype(np.uint64)
            sets.append(np.unique(s[: rng.integers(30, 41)]))
        want = jaccard.Classes(80)
        for i in range(80):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want.join(i, j)
        got = jaccard.Classes(80)
        for a, b in jaccard.join_sets(sets, 85, 100):
            got.join(a, b)
        assert (got.roots() == want.roots()).all()


def test_similar_sets_share_a_part():
    """The pigeonhole: sets at the threshold always have a part in common, common shingles left out or not."""
    rng = np.random.default_rng(2)
    for t in (90, 80, 70):
        for _ in range(150):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
            change = int(len(a) * (100 - t) / (100 + t)) if rng.random() < 0.5 else 0
            b = a.copy()
            b[rng.permutation(len(b))[:change]] = rng.integers(0, 2 ** 63, change).astype(np.uint64)
            b = np.unique(b)[int(len(b) * rng.random() * (100 - t) / 100) if not change else 0:]
            both = len(np.intersect1d(a, b))
            if 100 * both < t * (len(a) + len(b) - both):
                continue
            drop = jaccard.IntTable((a[: len(a) // 3] >> np.uint64(1)).astype(np.int64), np.zeros(len(a) // 3, np.int64))
            for common in (None, drop):
                h, o = np.concatenate([a, b]), np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
                keys, owner = jaccard.part_keys(h, o, np.array([len(a), len(b)]), t, 100, common)
                assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_keep_one(spark, odd_docs, no_docs, copies):
    rows = spark.createDataFrame(copies, "doc_id long, text string")
    kept = jaccard.keep_one(rows, k=3, part=90)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for (_, _, c) in brute(copies, 3, 90, 100)})
    left = jaccard.keep_one(odd_docs, k=3, part=90)
    assert left.schema == odd_docs.schema
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted(
        (str(r.doc_id), r.text or "") for r in odd_docs.dropDuplicates(["doc_id", "text"]).filter("doc_id is null or doc_id <> 20").collect())
    assert jaccard.keep_one(no_docs).count() == 0


def test_sparse_band_beside_a_dense_one(spark, monkeypatch):
    """Texts of a large size group that also have a row in a small one are in one class, whatever merges theirs."""
    monkeypatch.setattr(jaccard, "CHUNK_TEXTS", 20)
    words = [f"w{i}" for i in range(3 * 150 + 215)]
    rows = []
    for i in range(150):  # a chain: each text is linked with its next ones only
        w = words[3 * i:3 * i + 215]
        if i % 10 == 0:  # the sparse band
            w = w + [f"y{i}x{j}" for j in range(6)]
        rows.append((i, " ".join(w)))
    rows = rows[75:] + rows[:75]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, k=3, part=90) == brute(rows, 3, 90, 100)


def test_signatures_never_rule_out_a_link():
    """Sets at the threshold pass, whatever their sizes; sets that share half don't."""
    rng = np.random.default_rng(4)
    for t in (90, 80, 70):
        for n in (1, 2, 5, 63, 64, 65, 130, 700, 3000):
            a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
            b = a.copy()
            change = int(len(a) * (100 - t) / (100 + t))
            b[rng.permutation(len(b))[:change]] = rng.integers(0, 2 ** 63, change).astype(np.uint64)
            c = a[: -(-len(a) * t // 100)]
            half = np.r_[a[: n // 2], rng.integers(0, 2 ** 63, n - n // 2).astype(np.uint64)]
            sets = [np.unique(x) for x in (a, b, c, half)]
            h, o = np.concatenate(sets), np.repeat(np.arange(4), [len(x) for x in sets])
            size = np.bincount(o, minlength=4)
            sig = jaccard.parities(h, o, size)
            for i in (1, 2):
                both = len(np.intersect1d(sets[0], sets[i]))
                if 100 * both >= t * (size[0] + size[i] - both):
                    assert jaccard.alike([sig[0], sig[i]], size[[0, i]], t, 100) == [(0, 1)]
            if n >= 63:
                assert not jaccard.alike([sig[0], sig[3]], size[[0, 3]], t, 100)


@pytest.mark.parametrize(("part_texts", "task_texts"), [(3, 64), (128, 2), (2, 2)])
def test_parts_of_many_texts(spark, copies, part_texts, task_texts, monkeypatch):
    """Whether a part's texts are compared or joined unseen, in a task or after the shuffle, the classes are the same."""
    monkeypatch.setattr(jaccard, "PART_TEXTS", part_texts)
    monkeypatch.setattr(jaccard, "TASK_TEXTS", task_texts)
    assert found(spark.createDataFrame(copies, "doc_id long, text string"), k=3, part=80) == brute(copies, 3, 80, 100)


def test_components_end_finished_or_raise(spark):
    chain = spark.createDataFrame([(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)], "a long, b long")
    assert {r.root for r in graph.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.components(chain, rounds=1)
