import itertools
import math

import numpy as np

from pairforge.llm import language
from pairforge.llm.common import id_text_crc
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = (id_text_crc(F.col("doc_id")) % 3) == 1
    model = language.learn_profiles(docs.filter(~held))
    got = language.identify(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn_profiles(docs)
    by = {r.lang: r.text for r in docs.filter("n_chars between 2000 and 4000").select("lang", "text").collect()}
    got = language.infer(by["en"][:1800] + " " + by["de"][:600], model)
    assert list(got)[:2] == ["en", "de"] and 0.6 < got["en"] < 0.9
    assert list(language.infer(by["es"], model)) == ["es"]


def test_odd_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "x"), ("de", None)], "lang string, text string")
    model = language.learn_profiles(docs)
    assert model.languages == ["en", "fr"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd_docs, model).collect()]
    assert len(got) == odd_docs.count()
    assert (0, "und", 0.0) in got and (1, "und", 0.0) in got and (2, "und", 0.0) in got
    assert language.identify(no_docs, model).count() == 0
    none = language.learn_profiles(docs.filter("lang = 'xx'"))
    assert {r.lang_pred for r in language.identify(odd_docs, none).collect()} == {"und"}
    kept = language.keep_identified(odd_docs, model)
    assert kept.schema == odd_docs.schema and 0 not in {r.doc_id for r in kept.collect()}


def plain_grams(text):
    """Bucket counts of byte trigrams, byte by byte."""
    raw, out = b" ", {}
    for byte in text.lower().encode():
        letter = byte >= 0x80 or 97 <= byte <= 122
        if letter:
            raw += bytes([byte])
        elif not raw.endswith(b" "):
            raw += b" "
    raw = raw.strip() and b" " + raw.strip() + b" "
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
        h = (h ^ (h >> 15)) & (language.BUCKETS - 1)
        out[h] = out.get(h, 0) + 1
    return out


def plain_model(rows):
    counts = {}
    for lang, text in rows:
        if lang is not None and text is not None:
            mine = counts.setdefault(lang, {})
            for g, n in plain_grams(text).items():
                mine[g] = mine.get(g, 0) + n
    names = sorted(counts)
    total = [sum(counts[x].values()) + 0.5 * language.BUCKETS for x in names]
    return names, lambda g, i: (counts[names[i]].get(g, 0) + 0.5) / total[i]


def plain_em(c, p, mix):
    total, last = sum(c.values()), -math.inf
    like = lambda m: sum(n * math.log(sum(a * b for a, b in zip(m, p[g]))) for g, n in c.items())
    for _ in range(language.ROUNDS):
        now = like(mix)
        if now - last < 1e-4 * total:
            break
        last = now
        mix = [m * sum(n * p[g][i] / sum(a * b for a, b in zip(mix, p[g])) for g, n in c.items()) / total for i, m in enumerate(mix)]
    return mix, like(mix)


def plain_sets(text, names, prob):
    """Penalised likelihood and proportions of every set of languages."""
    c = plain_grams(text)
    out = {}
    for k in range(1, len(names) + 1):
        for chosen in itertools.combinations(range(len(names)), k):
            p = {g: [prob(g, i) for i in chosen] for g in c}
            mix, like = plain_em(c, p, [1 / k] * k)
            out[chosen] = like - language.PENALTY * math.log(sum(c.values())) * (k - 1), dict(zip((names[i] for i in chosen), mix))
    return out


def test_every_set_of_languages_by_hand(spark):
    """On whole texts of one and of two languages, the selected set is the best of all sets by penalised likelihood (or as good as it),
    with the proportions that plain expectation-maximisation finds for it; the pipeline's stage keeps what these say."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    model, (names, prob) = language.learn_profiles(docs), plain_model(rows)
    assert model.languages == names
    for lang, text in rows[:8]:
        for g in list(plain_grams(text))[:50]:
            assert all(abs(model.p[g, i] - prob(g, i)) < 1e-12 for i in range(len(names)))
    short = [t for _, t in rows if t and 60 < len(t) < 900]
    texts = short[:14] + [a + " " + b for a, b in zip(short[:10], short[10:20])]
    same = 0
    for t in texts:
        got, sets = language.infer(t, model), plain_sets(t, names, prob)
        best = max(sets.values(), key=lambda s: s[0])
        mine = next(s for s in sets.values() if set(s[1]) == set(got))
        assert all(abs(mine[1][x] - v) < 0.05 for x, v in got.items())
        same += best[0] - mine[0] < 1e-6 * abs(best[0]) + 2
    assert same >= 0.9 * len(texts)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in language.keep_identified(table, model, least=0.7).collect()}
    plain = {i for i, t in enumerate(texts) if max(language.infer(t, model).values()) >= 0.7}
    assert kept == plain
