import collections
import math
import re

import numpy as np
import pytest

from pairforge.llm import lexical_search as ls
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if t else []


def brute(docs, items, k=10):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, size = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = {}
    for item, words in asked.items():
        found = []
        for i, c in counts:
            if i is None:
                continue
            m = 10 + 90 * sum(c.values()) * n // max(1, size)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if s > 0:
                found.append((-s, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return {i: v for i, v in out.items() if v}


def found(df, item="item_id", doc="doc_id"):
    out = {}
    for r in df.orderBy(item, "rank").collect():
        out.setdefault(r[item], []).append((r["rank"], r[doc], r.score))
    return out


def pairs(df, a, b):
    return [(r[a], r[b]) for r in df.select(a, b).collect()]


@pytest.mark.parametrize("small", [False, True])
def test_documents_match_brute_force(spark, documents, monkeypatch, small):
    """With blocks and steps of every size, and items in several chunks."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    if small:
        monkeypatch.setattr(ls, "BLOCK_DOCS", 7)
        monkeypatch.setattr(ls, "STEP", 1)
    got = ls.search(documents.repartition(3), items, chunk_bytes=2000 if small else ls.CHUNK_BYTES)
    assert found(got) == brute(pairs(documents, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_masks_of_many_terms_and_ties(spark):
    """Items of more than 64 terms, documents with equal scores, and fewer than k hits."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    docs = [(1000 - i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(150)]
    docs += [(2000 + i, docs[3][1]) for i in range(20)] + [(5, "rare")]
    items = [(0, " ".join(words[:130])), (1, " ".join(words[100:])), (2, "rare nothing"), (3, "w1"), (4, "nothing at all"), (5, docs[3][1])]
    got = ls.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute(docs, items)


def test_masks_are_left_out_once_they_cannot_win():
    """The rare term's documents fill the result, so documents with the common term only get no mask."""
    n = 400
    terms_ = [np.array([0, 1] if i < 20 else [1]) for i in range(n)]
    block = ls.Block(list(range(n)), [2] * n, terms_, 2, n, 2 * n)
    weights = np.array([3000, 10])
    seen = []
    plain = np.unique
    try:
        ls.np.unique = lambda x, **kw: (seen.append(x.shape[-1]), plain(x, **kw))[1]
        best = block.search(np.array([0, 1]), weights, (np.full(10, 10_000_000), np.arange(10)), 10)
    finally:
        ls.np.unique = plain
    assert seen == [20] and best[1].tolist() == list(range(10)) and best[0][0] > 10_000_000


def test_odd_rows(spark, odd_docs, no_docs):
    items = odd_docs.withColumnRenamed("doc_id", "item_id")
    docs, asked = pairs(odd_docs, "doc_id", "text"), pairs(items, "item_id", "text")
    assert found(ls.search(odd_docs, items)) == brute(docs, asked)
    assert ls.search(no_docs, items).count() == 0 and ls.search(odd_docs, items.limit(0)).count() == 0
    named = odd_docs.withColumn("item", F.lit(1)).withColumn("id", F.lit(2)).withColumn("terms", F.lit(3))
    assert found(ls.search(named, items)) == brute(docs, asked)
