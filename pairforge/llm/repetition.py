"""Quality rules on repetition within a text, by suffix arrays over words.

The texts of a slice are ranked together by prefix doubling (each word's key holds its document, so no repeat
crosses documents). Positions whose rank is unique leave the work, so later rounds touch repeated text only. The
class of equal prefixes of 8 words, which the windows of the base rule need, is the rank after three rounds. The
longest common prefixes of neighbouring suffixes come from the stored rounds by binary descent. Maximal runs of
neighbours (LCP intervals) are the maximal repeated substrings; their spans are united and give the covered share
and the longest repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pairforge.llm.common import arrow_rows, words_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words ranked at once; a longer text is ranked alone.
SLICE_WORDS = 200_000


def prefix_ranks(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix ranks (a permutation, unique within the slice) and, per round k, the classes of equal prefixes of 2**k.

    ``keys`` are integers that differ between documents, ``ends[i]`` is the end of the document of position i.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    s = keys[order]
    new = np.r_[True, s[1:] != s[:-1]] if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    levels = [rank.copy()]
    size = np.bincount(start, minlength=n)
    todo = np.flatnonzero(size[rank] > 1)
    h = 1
    while len(todo):
        nxt = todo + h
        second = np.where(nxt < ends[todo], rank[np.minimum(nxt, n - 1)], -1)
        key = rank[todo] * np.int64(n + 1) + second + 1
        o = np.argsort(key)
        pos, k = todo[o], key[o]
        first = rank[pos]
        head = np.r_[True, first[1:] != first[:-1]]
        new = np.r_[True, k[1:] != k[:-1]]
        at = np.arange(len(pos))
        offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        rank[pos] = first + offset
        levels.append(rank.copy())
        group = np.cumsum(new) - 1
        todo = np.sort(pos[np.bincount(group)[group] > 1])
        h *= 2
    return rank, levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the next one in the suffix array."""
    a, b = order[:-1].copy(), order[1:].copy()
    n = len(order)
    lcp = np.zeros(len(a), np.int64)
    ea, eb = ends[a], ends[b]
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live], b[live]
        ok = (x < ea[live]) & (y < eb[live])
        same = ok & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        hit = live[same]
        lcp[hit] += 1 << k
        a[hit] += 1 << k
        b[hit] += 1 << k
    return lcp


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """For each position, whether one of the spans holds it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(docs: list[list[bytes]], window: int = 8, min_words: int = 5) -> list[tuple[int, int, int]]:
    """Per document: words in windows that occur twice or more, words in maximal repeats of at least ``min_words``
    words, and the words of the longest repeat (0 if shorter than ``min_words``). ``window`` is a power of two."""
    sizes = np.array([len(d) for d in docs], np.int64)
    n = int(sizes.sum())
    if not n:
        return [(0, 0, 0)] * len(docs)
    doc = np.repeat(np.arange(len(docs)), sizes)
    stops = np.cumsum(sizes)
    ends = stops[doc]
    seen: dict[bytes, int] = {}
    word = np.fromiter((seen.setdefault(w, len(seen)) for d in docs for w in d), np.int64, n)
    rank, levels = prefix_ranks(doc * np.int64(len(seen)) + word, ends)
    classes = levels[min(window.bit_length() - 1, len(levels) - 1)]
    twice = np.bincount(classes, minlength=n)[classes] > 1
    if len(levels) < window.bit_length():
        twice[:] = False  # every prefix was unique before reaching the window
    in_window = _covered(np.flatnonzero(twice), np.full(int(twice.sum()), window), n)
    order = np.argsort(rank)
    lcp = neighbour_lcp(order, levels, ends) if n > 1 else np.zeros(0, np.int64)
    longest = np.zeros(n, np.int64)  # by position: the longest repeat that starts there
    longest[order[:-1]] = lcp
    longest[order[1:]] = np.maximum(longest[order[1:]], lcp)
    at = np.flatnonzero(longest >= min_words)
    spans = _covered(at, longest[at], n)
    out_long = np.zeros(len(docs), np.int64)
    np.maximum.at(out_long, doc[at], longest[at])
    return list(zip(np.bincount(doc, in_window, len(docs)).astype(int).tolist(),
                    np.bincount(doc, spans, len(docs)).astype(int).tolist(), out_long.tolist(), strict=True))


def _duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8,
                     min_words: int = 5, max_covered: float = 0.4, max_longest: float = 0.3) -> DataFrame:
    """Score every whole text and decide whether to keep it.

    Base rule: fewer than 20 words, or more than 30 % of the words in repeated ``window``-word windows, fails. Method:
    a text also fails if maximal repeats of ``min_words`` words or more cover over ``max_covered`` of its words, or
    if the longest of them is over ``max_longest`` of its words. Null and empty texts have no words and fail the
    base rule. Every input row gives one row (also repeated rows and null ids); an empty table gives none; other
    columns are not read.

    Returns (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words,
    longest_repeat).
    """
    def run(cols: list[list]) -> dict[str, list]:
        ids, texts = cols
        texts = [t or "" for t in texts]
        words = [words_of(t) for t in texts]
        found: list[tuple[int, int, int]] = []
        s = 0
        while s < len(words):  # slices of bounded size; a text is never cut
            e, size = s + 1, len(words[s])
            while e < len(words) and size + len(words[e]) <= SLICE_WORDS:
                size += len(words[e])
                e += 1
            found += repetition(words[s:e], window, min_words)
            s = e
        n = [len(w) for w in words]
        failed = [k < 20 or 100 * r[0] > 30 * k for k, r in zip(n, found, strict=True)]
        kept = [not f and r[1] <= max_covered * k and r[2] <= max_longest * k
                for f, k, r in zip(failed, n, found, strict=True)]
        return {id_col: ids, "n_words": n,
                "word_chars": [len(t) - sum(t.count(c) for c in SPACES) for t in texts],
                "n_symbols": [sum(t.count(c) for c in SYMBOLS) for t in texts],
                "n_dup_lines": [_duplicate_lines(t) for t in texts], "n_repeat_words": [r[0] for r in found],
                "base_failed": failed, "kept": kept, "covered_words": [r[1] for r in found],
                "longest_repeat": [r[2] for r in found]}
    kind = dict(docs.dtypes)[id_col]
    return arrow_rows(docs.select(id_col, text_col), run,
                      f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                      "base_failed boolean, kept boolean, covered_words long, longest_repeat long", chunk=256)
