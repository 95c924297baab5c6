import numpy as np
import pytest

from pairforge.llm import quality
from pairforge.llm.common import id_text_crc
from pyspark.sql import functions as F


def plain_ftrl(rows, bits, epochs, alpha, beta, l1, l2, seed):
    """The same updates, one coordinate at a time in Python."""
    z, n = {}, {}
    ones, zeros = (sum(r[1] for r in rows if r[0] == y) for y in (1, 0))
    bias, bias_n = np.log((ones + 1) / (zeros + 1)), 0.0
    rng = np.random.default_rng(seed)

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((beta + ni ** 0.5) / alpha + l2)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, w, at, x = rows[r]
            now = {int(i): weight(int(i)) for i in at}
            p = 1 / (1 + np.exp(-(sum(now[int(i)] * v for i, v in zip(at, x)) + bias)))
            g = w * (p - y)
            for i, v in zip(at.tolist(), x.tolist()):
                gi = g * v
                sigma = ((n.get(i, 0.0) + gi * gi) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + gi - sigma * now[i]
                n[i] = n.get(i, 0.0) + gi * gi
            bias_n += g * g
            bias -= 0.1 * g / (1 + bias_n ** 0.5)
    return {i: weight(i) for i in z}, bias


def test_updates_match_plain_ones():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        at = np.sort(rng.choice(64, rng.integers(1, 9), replace=False))
        rows.append((int(rng.random() < 0.4 + 0.4 * (at[0] < 5)), 1.0 + i % 2, at, rng.random(len(at))))
    how = dict(epochs=3, alpha=0.8, beta=1.0, l1=0.05, l2=0.1, seed=4)
    model, (want, bias) = quality.train(rows, bits=6, **how), plain_ftrl(rows, 6, **how)
    assert abs(model.bias - bias) < 1e-9 and (model.weights == 0).any()
    assert np.allclose(model.weights, [want.get(i, 0.0) for i in range(64)], atol=1e-6)


def test_features_are_whole_and_bounded():
    h = quality.Hasher(10)
    assert quality.TOKENS.findall(b"") == [] and [m.group() for m in quality.TOKENS.finditer("Ab1 é!!?? $$$".encode())] == [b"Ab1", "é".encode(), b"!!", b"??", b"$$$"]
    (none, _), (a, x), (b, y), (c, z) = h.features([None, "one two two", "one two two", "one two " * 40_000 + "end"])
    assert len(none) == 0 and (a == b).all() and (x == y).all() and abs((x * x).sum() - 1) < 1e-12
    assert len(c) <= 1 << 10 and abs((z * z).sum() - 1) < 1e-9
    last = h.features(["one two " * 40_000])[0]
    assert len(last[0]) != len(c) or not (last[0] == c).all()  # the end of a long text counts


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = (id_text_crc(F.col("doc_id")) % 5) == 0
    model = quality.learn(docs, labels.filter(~held))
    got = quality.score(docs.join(labels.filter(held).select("doc_id", "quality"), "doc_id"), model, 0.3).join(labels, "doc_id").collect()
    y, p = np.array([r.quality for r in got]), np.array([r.predicted for r in got])
    assert len(y) > 700 and np.mean(y == p) > 0.98 and p[y == 1].mean() > 0.99 and p[y == 0].mean() < 0.08


def test_a_bounded_sample_stands_for_all_rows(spark):
    """Of many rows of label 1 a few are sampled; the scores still follow the share of all labelled rows."""
    docs = spark.createDataFrame([(i, "same text") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(400)], "doc_id long, quality int")
    model = quality.learn(docs, labels, sample_docs=(40, 40))
    assert abs(quality.score(docs.limit(1), model).first().score - 0.9) < 0.08


@pytest.mark.parametrize("both", [True, False])
def test_odd_rows(spark, odd_docs, no_docs, both):
    labels = spark.createDataFrame([(i, i % 2 if both else 1) for i in range(12)] + [(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, quality int")
    model = quality.learn(odd_docs, labels)
    got = quality.score(odd_docs, model, 0.3).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score(no_docs, model).count() == 0
    empty = quality.learn(no_docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, empty).collect()} == {0.5}
