import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def transducer():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Transducer(f.read())


def ids(t, s):
    return np.frombuffer(t.encode(s), np.int32).tolist()


def test_random_texts(library, transducer):
    rng = random.Random(1)
    pool = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", " ", "é", "ß", "漢", "🙂", "1", "23", "'s", "'ll",
            "<|endoftext|>", "<|endof", "!", "́", "​", "﻿", "᠎", "٣", "Ⅷ", "\x00", "\x0b", "ſ", "İ"]
    for _ in range(1500):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        want = library.encode(s, add_special_tokens=False).ids
        assert ids(transducer, s) == want
        assert transducer.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 4000, "=-" * 3000, " " * 4000, "the" * 3000, "あい" * 3000,
                                  "".join(random.Random(2).choice("etaoinshrdlu") for _ in range(6000))])
def test_streams_longer_than_the_lookahead(library, transducer, text):
    assert len(text.encode()) > transducer.lookahead + bpe.STEP
    assert ids(transducer, text) == library.encode(text, add_special_tokens=False).ids


def test_tokens_leave_once_stable(library, transducer, monkeypatch):
    """Streams of all lengths that advance together, by small steps: no window is larger than lookahead and step, and ids are the library's."""
    monkeypatch.setattr(bpe, "STEP", 16)
    seen, merge = [], transducer._merge_windows
    monkeypatch.setattr(transducer, "_merge_windows", lambda w: (seen.append(max(map(len, w))), merge(w))[1])
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.choice([1, 5, 40, 400, 1500]))) for _ in range(60)] + ["a" * 2000, "the" * 700]
    got = transducer.stream_many([w.encode() for w in words])
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert len(seen) > 50 and max(seen) <= transducer.lookahead + 2 * bpe.STEP


def test_any_ids_decode_like_the_library(library, transducer):
    rng = random.Random(4)
    for _ in range(300):
        some = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        assert transducer.decode(some, block=3) == library.decode(some, skip_special_tokens=False)
    assert transducer.decode([-1, 60_000_000]) == ""


def test_tables(spark, library, documents, odd_docs, no_docs):
    for df in (documents, odd_docs):
        got = bpe.digests(bpe.decode(bpe.encode(df, PATH), PATH))
        want = []
        for r in df.select("doc_id", "text").collect():
            i = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((str(r.doc_id), len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                         hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    assert bpe.digests(bpe.decode(bpe.encode(no_docs, PATH), PATH)).count() == 0
    none = spark.createDataFrame([(1, None), (2, [None, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(none, PATH).collect()} == {1: "", 2: "a"}
