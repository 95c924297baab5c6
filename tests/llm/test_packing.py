import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairforge.llm import common, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, cap):
    """Sequences are gapless from 0 and at most ``cap`` long; returns their number."""
    seqs = collections.defaultdict(list)
    for sequence, offset, length in rows:
        seqs[sequence].append((offset, length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= cap
    return len(seqs)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([64, 512, 4096])
    lengths = [min(cap, max(1, int(rng.lognormvariate(np.log(cap) - 2, 1)))) for _ in range(rng.choice([1, 40, 3000]))]
    counts = collections.Counter(lengths)
    placed, rows = collections.Counter(), []
    for length, r0, r1, first, per, offset in packing.pack_histogram(dict(counts), cap):
        for r in range(r0, r1):
            placed[length, r] += 1
            rows.append((first + (r - r0) // per, offset + (r - r0) % per * length, length))
    assert placed == collections.Counter((x, r) for x, n in counts.items() for r in range(n))
    assert check(rows, cap) <= max(-(-sum(lengths) // cap) * 1.02 + 1, max(1, sum(x > cap // 2 for x in lengths)) + 1)


def test_nnls_and_patterns():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 6)), np.array([0, 2.0, 0, 1.0, 0.5, 0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert set(packing.patterns(4)) == {(4,), (3, 1), (2, 2), (2, 1, 1)}


def test_tables(spark, documents, odd_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    for df, cap in ((documents, 4096), (odd_docs, 4096), (odd_docs, 100)):
        got = packing.pack_documents(df, PATH, cap).collect()
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            i = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
            for k, s in enumerate(range(0, len(i), cap)):
                want[r.doc_id, k, s, len(i[s:s + cap]), zlib.crc32(np.array(i[s:s + cap], "<u4").tobytes())] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        n = check([(r.sequence_id, r.offset, r.length) for r in got], cap)
        assert n <= -(-sum(r.length for r in got) // cap) * 1.02 + 1
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_words_equal_the_whole_text():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    words, library = packing._WordIds(spec, most=50), Tokenizer.from_str(spec)
    rng = random.Random(3)
    pool = ["a", "The", "'s", "'S", "İ", "ΑΣ", "ſ", "é", "é", "́", "̈", " ", "  ", "\n", "\x1c", "\x85", "\xa0", " ", "<|endoftext|>",
            "<|START", "K", "!", "12", "٣", "字", "🙂", "\x00", "ﬁ"]
    for _ in range(1500):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(words.ids([s])[0], np.uint32).tolist() == library.encode(s, add_special_tokens=False).ids


def test_bad_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="from 1 to"):
        packing.pack(spark.createDataFrame([(1, 0, 0)], "doc_id long, piece int, length long"))


def test_memo_holds_two_generations_of_pre_tokens():
    """Whatever the spelling around them, words share their pre-tokens' ids, and a worker holds no more than two generations of these."""
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    words, library = packing._WordIds(spec, most=50), Tokenizer.from_str(spec)
    for i in range(0, 600, 3):
        t = f"Word{i}x, word{i}x; (é{i}X) ŁÓDŹ{i} x{'y' * 70}{i} ſ\xa0ª²"
        assert np.frombuffer(words.ids([t])[0], np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids
        assert sum(len(x) for v in vars(words).values() if isinstance(v, dict) for x in (v, getattr(v, "old", ()))) <= 2 * 50 + 256
    assert len(words._memo) <= 50 and len(words._memo.old) <= 50 and max(map(len, [*words._memo, *words._memo.old])) <= 64
    for c in map(chr, range(0x250)):
        t = f"A{c}b {c}{c}'S1{c}"
        assert np.frombuffer(words.ids([t])[0], np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, c


def test_the_next_operator_of_a_worker_gives_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "_STATE", {})
    monkeypatch.setattr(common, "_give_back", lambda: given.append(dict(common._STATE)))
    assert [common.worker_state(k, lambda k=k: k * 2) for k in ("a", "a", "b", "a")] == ["aa", "aa", "bb", "aa"]
    assert given == [{}, {}, {}]  # what was held is gone by then
