import random
import re

import numpy as np

from pairforge.llm import repetition as rep


def plain(words, window=8, least=5):
    n = len(words)
    where = {}
    for i in range(n - window + 1):
        where.setdefault(tuple(words[i:i + window]), []).append(i)
    rep8 = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + window)}
    covered, longest = set(), 0
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                if k >= least:
                    covered |= set(range(i, i + k))
                    longest = max(longest, k)
    return len(rep8), len(covered), longest


def test_random_documents():
    rng = random.Random(0)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice(b"abcd") for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5 and w:
                s = rng.randrange(len(w))
                w += w[s:s + rng.randint(1, 30)]
            if rng.random() < 0.2:
                w = [97] * rng.randint(1, 70)
            docs.append([bytes([c]) for c in w])
        assert rep.repetition(docs) == [plain(d) for d in docs]


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, 200)
    ends = np.full(200, 200)
    rank, levels = rep.prefix_ranks(keys, ends)
    order = np.argsort(rank)
    assert [tuple(keys[i:]) for i in order] == sorted(tuple(keys[i:]) for i in range(200))
    lcp = rep.neighbour_lcp(order, levels, ends)
    for x, (a, b) in zip(lcp, zip(order, order[1:])):
        k = 0
        while max(a, b) + k < 200 and keys[a + k] == keys[b + k]:
            k += 1
        assert x == k


def test_rules(odd_docs, no_docs, documents):
    for df in (documents, odd_docs):
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.base_failed) for r in rep.repetition_rules(df).collect())
        want = []
        for r in df.select("doc_id", "text").collect():
            t = r.text or ""
            w = re.findall("[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
            twice = rep.repetition([rep.words_of(t)])[0][0]
            want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                         len(w) < 20 or 100 * twice > 30 * len(w)))
        assert got == sorted(want)
        assert all(not r.kept or not r.base_failed for r in rep.repetition_rules(df).collect())
    assert rep.repetition_rules(no_docs).count() == 0
