"""N-gram Jaccard join with signature trees, exact, up to connected classes.

Every text is a set of 64-bit hashes of its distinct word shingles; texts with equal sets are one vertex from the
start. Pairs that may link are brought together by a pigeonhole on the sets: sets with Jaccard similarity of at
least t differ in at most d = 2 r (1-t)/(1+t) elements, where r bounds their sizes, so of m > d parts into which a
hash divides all shingles they agree on m - d at least. One row per part and text is dealt out by the part's hash
(after each task has merged its own), which gives clusters of texts that may hang together. Shingles that a
sample shows in very many texts are left out of the parts: that can only make sets more alike, so nothing is
lost, and a line that a third of all texts share doesn't join them.

Texts that share a part often share little else. Every text has a parity signature: one bit a shingle or more, each the parity of the
shingles hashed to it. The bits in which two signatures differ are at most the shingles in which the sets differ, so texts that
differ in more bits than linked sets may differ in shingles are no candidates, whatever parts they share. The texts of one part are compared
by their signatures in a task; a part of more than ``PART_TEXTS`` texts joins them all, unseen.

Within a cluster a signature tree does the join: leaves hold few texts with bitmaps over the cluster's shared
shingles, nodes hold the union of their children's bitmaps and the range of their sizes. A dual traversal from the
root drops node pairs whose largest possible overlap, popcount(A & B), or whose sizes can't reach t; leaf pairs
are decided on the bitmaps, which are exact. Pairs within one class are skipped.

A cluster that is too large for a task is divided into groups of similar set sizes, and a large group into chunks.
Chunks are joined first, then one text per class so far, again and again while classes merge; at last every text
outside the group's largest class is joined with all chunks, so every pair of texts that isn't in one class already
has met.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import IntTable, giving_back, join_hot, staged, worker_state
from pairforge.llm.graph import components
from pairforge.session import ensure_checkpoint_dir

#: Texts and shingles that a task joins at once.
CHUNK_TEXTS, CHUNK_SHINGLES = 768, 1_000_000
LEAF, FANOUT = 16, 4
#: Ratio of the sizes that one division into parts serves.
SIZE_STEP = 1.6
SAMPLE_TEXTS, COMMON_SHARE, COMMON_LEAST = 4096, 0.0007, 3
BUCKETS = 1 << 20
#: Most texts of a part that are compared by their signatures, and most that one task's own rows of a part may hold.
PART_TEXTS, TASK_TEXTS = 128, 64

_RNG = np.random.default_rng(20_24)
_BYTE = _RNG.integers(0, 2 ** 64, 256, np.uint64)
_BASE = np.uint64(_RNG.integers(0, 2 ** 64, dtype=np.uint64) | np.uint64(1))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); ``seed`` may differ by element."""
    x = x + np.asarray(seed, np.uint64).reshape(-1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _POWERS


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, their text, words per text): each text's distinct shingles of ``k`` words, sorted by hash.

    Words are split at white space after lower-casing A-Z. A text of fewer than ``k`` words is one shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    n = len(raw)
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts_of = np.cumsum([0, *(len(x) + 1 for x in raw)])
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    none = np.zeros(0, np.uint64)
    if not len(begin):
        return none, np.zeros(0, np.int64), np.zeros(n, np.int64)
    at = np.flatnonzero(inside)
    lengths = end - begin
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    word = _mix(np.add.reduceat(_BYTE[b[at]] * _powers(int(lengths.max()))[place], first) + lengths.astype(np.uint64))
    text = np.searchsorted(starts_of, begin, "right") - 1
    words = np.bincount(text, minlength=n)
    # sum of position-mixed words over k consecutive words of a text
    hashes, owner = [], []
    if len(word) >= k:
        whole = text[:len(word) - k + 1] == text[k - 1:]
        h = np.zeros(int(whole.sum()), np.uint64)
        for j in range(k):
            h += _mix(word[j:len(word) - k + 1 + j][whole], j + 1)
        hashes.append(_mix(h, k))
        owner.append(text[:len(word) - k + 1][whole])
    few = (words > 0) & (words < k)
    if few.any():
        mine = few[text]
        place = np.arange(len(text)) - np.repeat(np.cumsum(words) - words, words)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, text[mine], _mix(word[mine], place[mine] + 1))
        hashes.append(_mix(sums[few], 1000 + words[few]))
        owner.append(np.flatnonzero(few))
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new].astype(np.int64), words


def vertices(h: np.ndarray, o: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, vertex, check) of each text's set: two independent 63-bit hashes of the whole set."""
    size = np.bincount(o, minlength=n)
    out = []
    for s in (seed + 101, seed + 202):
        total = np.zeros(n, np.uint64)
        np.add.at(total, o, _mix(h, s))
        out.append((_mix(total + size.astype(np.uint64), s) >> np.uint64(1)).astype(np.int64))
    return size, out[0], out[1]


def parities(h: np.ndarray, o: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity signature of each set: 64 * 2^j bits, at least one a shingle."""
    words = 1 << np.ceil(np.log2(np.maximum(1, size / 64))).astype(np.int64)
    first = np.cumsum(words) - words
    place = _mix(h, 23) & (words[o] * 64 - 1).astype(np.uint64)
    bits = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(bits, first[o] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return [bits[a:a + w].tobytes() for a, w in zip(first.tolist(), words.tolist(), strict=True)]


def alike(signatures: list[bytes], size: np.ndarray, part: int, whole: int) -> list[tuple[int, int]]:
    """Pairs (positions) that join all sets of which the signatures and sizes don't rule out a link; one is enough between
    two groups of sets."""
    words = min(len(x) for x in signatures) // 8
    bits = np.zeros((len(signatures), words), np.uint64)
    for i, x in enumerate(signatures):  # a longer signature folds to a shorter one
        np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0, out=bits[i])
    classes, links = Classes(len(size)), []
    for i in range(len(size) - 1):
        other = size[i + 1:]
        apart = np.bitwise_count(bits[i] ^ bits[i + 1:]).sum(axis=1, dtype=np.int64)
        ok = (apart * (whole + part) <= (size[i] + other) * (whole - part)) & (whole * np.minimum(size[i], other) >= part * np.maximum(size[i], other))
        links += [(i, j) for j in (np.flatnonzero(ok) + i + 1).tolist() if classes.join(i, j)]
    return links


def size_class(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class number of each set size and the largest size of its class."""
    tops = [1]
    while tops[-1] < max(1, int(size.max(initial=1))) * SIZE_STEP * 2:
        tops.append(max(tops[-1] + 1, int(tops[-1] * SIZE_STEP)))
    tops = np.array(tops)
    c = np.searchsorted(tops, size)
    return c, tops


def part_keys(h: np.ndarray, o: np.ndarray, size: np.ndarray, part: int, whole: int, common: IntTable | None) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of the parts of each set, for the threshold ``part / whole``.

    Sets of one division share m - d parts at least. A set with fewer empty parts than that shares one that isn't
    empty with each partner, so it sends its non-empty parts only. Common shingles are left out first; a set that
    has too many empty parts then also sends the parts of its whole set (and, if need be, the empty ones): of two
    partners either one has few empty parts, or both do this.
    """
    number, tops = size_class(size)
    live = size > 0
    keys, owners = [], []
    # pairs within a size class, and pairs of neighbouring classes: as the smaller set's side, and as the larger one's
    below = np.maximum(number - 1, 0)
    for c, use, cross in ((number, live, 0), (number, live & (size * whole > tops[number] * part), 1),
                          (below, live & (number > 0) & (size * part <= tops[below] * whole), 1)):
        top = tops[c]
        d = (whole - part) * top // part if cross else 2 * (whole - part) * top // (whole + part)
        m = d + 1 + np.maximum(1, d // 8)
        if common is not None:
            rare = common.find((h >> np.uint64(1)).astype(np.int64)) < 0
            key, owner, empty = _parts(h[rare], o[rare], np.where(use, m, 0), c, 1 + 2 * cross)
            keys.append(key[0])
            owners.append(owner[0])
            use = use & (empty >= m - d)
        key, owner, empty = _parts(h, o, np.where(use, m, 0), c, 2 + 2 * cross)
        bare = (empty >= m - d)[owner[1]]
        keys += [key[0], key[1][bare]]
        owners += [owner[0], owner[1][bare]]
    return np.concatenate(keys), np.concatenate(owners)


def _parts(h: np.ndarray, o: np.ndarray, m: np.ndarray, c: np.ndarray, kind: int) -> tuple[list, list, np.ndarray]:
    """Keys and texts of the non-empty and of the empty ones of ``m`` parts of each set, and the number of empty ones."""
    n = len(m)
    first = np.cumsum(m) - m
    total = int(m.sum())
    mine = m[o] > 0
    hh, oo = h[mine], o[mine]
    slot = first[oo] + (_mix(hh, 7) % np.maximum(m[oo], 1).astype(np.uint64)).astype(np.int64)
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, slot, _mix(hh, 9))
    full = np.zeros(total, bool)
    full[slot] = True
    owner = np.repeat(np.arange(n), m)
    place = np.arange(total) - np.repeat(first, m)
    key = (_mix(sums + _mix((c[owner] * (1 << 32) + place).astype(np.uint64), 11), 13 + kind) >> np.uint64(1)).astype(np.int64)
    return [key[full], key[~full]], [owner[full], owner[~full]], np.bincount(owner, ~full, n)


# --- signature tree ---------------------------------------------------------------------------------------------

class Classes:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


class SignatureTree:
    """Levels of nodes over sets, from leaves of ``LEAF`` sets up to one root. ``bits`` (levels) are unions of the
    sets' bitmaps, ``least`` and ``most`` the range of their sizes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.sets, self.sizes = bits, sizes
        self.bits, self.least, self.most = [], [], []
        b, lo, hi, step = bits, sizes, sizes, LEAF
        while True:
            cut = np.arange(0, len(b), step)
            b, lo, hi = np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.bits.append(b)
            self.least.append(lo)
            self.most.append(hi)
            step = FANOUT
            if len(b) == 1:
                return


def _overlaps(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """popcount(a[i] & b[j]) of each pair, in blocks of bounded size."""
    out = np.empty(len(i), np.int64)
    step = max(1, 1_000_000 // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        out[s:s + step] = np.bitwise_count(a[i[s:s + step]] & b[j[s:s + step]]).sum(axis=1)
    return out


def dual_join(left: SignatureTree, right: SignatureTree, classes: Classes, at_left: np.ndarray, at_right: np.ndarray,
              part: int, whole: int) -> list[tuple[int, int]]:
    """Links (positions) that merge classes, between the sets of two trees. ``at_*`` are the sets' positions."""
    same = left is right

    def can(x, lo_a, hi_a, lo_b, hi_b):
        """Whether sets of these size ranges with overlap ``x`` at most can reach the threshold."""
        return (whole * hi_a >= part * lo_b) & (whole * hi_b >= part * lo_a) & (x * (whole + part) >= part * (lo_a + lo_b))

    la, lb = len(left.bits) - 1, len(right.bits) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        x = _overlaps(left.bits[la], i, right.bits[lb], j)
        ok = can(x, left.least[la][i], left.most[la][i], right.least[lb][j], right.most[lb][j])
        i, j = i[ok], j[ok]
        if not len(i) or (la == 0 and lb == 0):
            break
        if la > 0:
            i, j = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(j, FANOUT)
            la -= 1
            ok = i < len(left.bits[la])
            i, j = i[ok], j[ok]
        if lb > la or (lb > 0 and la == 0):
            i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            lb -= 1
            ok = j < len(right.bits[lb])
            i, j = i[ok], j[ok]
        if same and la == lb:
            ok = i <= j
            i, j = i[ok], j[ok]
    links = []
    pa_, pb_ = np.arange(LEAF).repeat(LEAF), np.tile(np.arange(LEAF), LEAF)
    for s in range(0, len(i), 64):  # leaf pairs, a few at a time, so that classes found so far save work
        a = (i[s:s + 64, None] * LEAF + pa_).ravel()
        b = (j[s:s + 64, None] * LEAF + pb_).ravel()
        ok = (a < len(left.sets)) & (b < len(right.sets))
        if same:
            ok &= a < b
        a, b = a[ok], b[ok]
        sa, sb = left.sizes[a], right.sizes[b]
        ok = (whole * np.minimum(sa, sb) >= part * np.maximum(sa, sb))
        a, b = a[ok], b[ok]
        root = {}

        def of(p: int) -> int:
            if p not in root:
                root[p] = classes.find(p)
            return root[p]
        ok = np.array([of(p) != of(q) for p, q in zip(at_left[a].tolist(), at_right[b].tolist(), strict=True)], bool)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        x = _overlaps(left.sets, a, right.sets, b)
        hit = whole * x >= part * (left.sizes[a] + right.sizes[b] - x)
        for p, q in zip(at_left[a[hit]].tolist(), at_right[b[hit]].tolist(), strict=True):
            if classes.join(p, q):
                links.append((p, q))
    return links


def join_sets(sets: list[np.ndarray], part: int, whole: int, classes: Classes | None = None, second: int | None = None) -> list[tuple[int, int]]:
    """Links between ``sets`` that merge classes. With ``second``, only between the sets before and from that position."""
    n = len(sets)
    classes = classes or Classes(n)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    bit, of = number[inverse[keep]], owner[keep]
    bits = np.zeros((n, max(1, (int(shared.sum()) + 63) // 64)), np.uint64)
    np.bitwise_or.at(bits, (of, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    low = np.full(n, np.uint64(2 ** 64 - 1))
    np.minimum.at(low, owner, _mix(flat.astype(np.uint64), 17))
    links = []
    if second is None:
        order = np.lexsort((sizes, low))  # alike sets next to each other
        tree = SignatureTree(bits[order], sizes[order])
        return dual_join(tree, tree, classes, order, order, part, whole)
    sides = []
    for rows in (np.arange(second), np.arange(second, n)):
        order = rows[np.lexsort((sizes[rows], low[rows]))]
        sides.append((SignatureTree(bits[order], sizes[order]), order))
    links += dual_join(sides[0][0], sides[1][0], classes, sides[0][1], sides[1][1], part, whole)
    return links


# --- Spark ------------------------------------------------------------------------------------------------------

def _slices(b: pa.RecordBatch, col: int, rows: int = 256, chars: int = 700_000) -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of at most ``rows`` rows with about ``chars`` characters; a text is never cut."""
    for at in range(0, b.num_rows, rows):
        texts = b.column(col).slice(at, rows).to_pylist()
        s = 0
        while s < len(texts):
            e, size = s, 0
            while e < len(texts) and (e == s or size < chars):
                size += len(texts[e] or "")
                e += 1
            yield at + s, texts[s:e]
            s = e


def _common(docs: DataFrame, text_col: str, k: int) -> IntTable | None:
    """Shingles in at least ``COMMON_SHARE`` of a sample of at most ``SAMPLE_TEXTS`` texts."""
    got = (docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter("text is not null")
           .orderBy("h").limit(SAMPLE_TEXTS).select("text"))

    def hashes(batches):
        for b in batches:
            for _, texts in _slices(b, 0):
                h, _, _ = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(1)).astype(np.int64))], names=["h"])
    n = got.count()
    rows = (got.mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * n)).toArrow())
    h = rows.column("h").to_numpy()
    return IntTable(h, np.zeros(len(h), np.int64)) if len(h) else None


def _clusters(docs: DataFrame, text_col: str, k: int, part: int, whole: int, seed: int, sigs: DataFrame) -> DataFrame:
    """(v, root): vertices that may link with another vertex, and their cluster."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col, k))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, vertex, other): the vertices of a key (other -1). If a task has many of a key, only the least goes on (other -2),
        and the others are edges (other set)."""
        worker_state(None, lambda: None)  # nothing is kept from an operator before
        common = shared.value
        held_k, held_v, size = [], [], 0

        def out() -> pa.RecordBatch:
            key, v = np.concatenate(held_k), np.concatenate(held_v)
            order = np.lexsort((v, key))
            key, v = key[order], v[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (v[1:] != v[:-1])
            key, v = key[new], v[new]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            of = np.cumsum(head) - 1
            many = (np.bincount(of) > TASK_TEXTS)[of] if len(key) else head
            least = v[head][of] if len(key) else v
            edge = many & ~head
            pairs = np.unique(np.stack([v[edge], least[edge]]), axis=1) if edge.any() else np.zeros((2, 0), np.int64)
            on = np.flatnonzero(~edge)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[on], pairs[0]])), pa.array(np.concatenate([v[on], pairs[0]])),
                 pa.array(np.concatenate([np.where(many[on], -2, -1), pairs[1]]))], names=["key", "v", "other"])
        for b in batches:
            for _, texts in _slices(b, 0):
                h, o, _ = shingle_sets(texts, k)
                n, v, _ = vertices(h, o, len(texts), seed)
                once = np.unique(v, return_index=True)[1]  # equal sets send their parts once
                first = np.zeros(len(v), bool)
                first[once] = True
                mine = first[o]
                keys, owner = part_keys(h[mine], o[mine], np.where(first, n, 0), part, whole, common)
                held_k.append(keys)
                held_v.append(v[owner])
                size += len(keys)
                if size > 700_000:
                    yield out()
                    held_k, held_v, size = [], [], 0
        if held_k:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by key: the vertices of each key of few (vs; once for all keys that have the same), and edges
        (a, b) from every vertex of any other key to its least one. Rows that are edges pass."""
        star_key, star_least = -1, -1
        left = [np.zeros(0, np.int64)] * 3  # rows of the last key so far, of which more may come
        seen: set[bytes] = set()

        def told(key, v, other, last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            nonlocal star_key, star_least
            a, z, groups = [], [], []
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(head)
            stop = np.append(start[1:], len(key))
            rest = [x[:0] for x in (key, v, other)]
            if not last and len(start) and stop[-1] - start[-1] <= PART_TEXTS and key[-1] != star_key:
                rest = [x[start[-1]:] for x in (key, v, other)]
                start, stop = start[:-1], stop[:-1]
            merged = np.logical_or.reduceat(other == -2, start) if len(start) else np.zeros(0, bool)
            for s, e, all_in in zip(start.tolist(), stop.tolist(), merged.tolist(), strict=True):
                if e - s == 1 and key[s] != star_key:
                    continue
                if all_in or e - s > PART_TEXTS or key[s] == star_key:
                    star_least = star_least if key[s] == star_key else int(v[s])
                    star_key = int(key[s])
                    a.append(v[s:e])
                    z.append(np.full(e - s, star_least))
                    continue
                vs = np.unique(v[s:e])
                if len(vs) > 1 and (name := vs.tobytes()) not in seen:
                    if len(seen) >= 50_000:
                        seen.clear()
                    seen.add(name)
                    groups.append(vs.tolist())
            pairs = np.stack([np.concatenate(a), np.concatenate(z)]) if a else np.zeros((2, 0), np.int64)
            pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
            n, g = pairs.shape[1], len(groups)
            return pa.RecordBatch.from_arrays([pa.array([*pairs[0].tolist(), *[None] * g], pa.int64()), pa.array([*pairs[1].tolist(), *[None] * g], pa.int64()),
                                               pa.array([None] * n + groups, pa.list_(pa.int64()))], names=["a", "b", "vs"]), rest
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            edge = cols[2] >= 0
            if edge.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][edge]), pa.array(cols[2][edge]), pa.nulls(int(edge.sum()), pa.list_(pa.int64()))], names=["a", "b", "vs"])
            got, left = told(*(np.concatenate([x, c[~edge]]) for x, c in zip(left, cols, strict=True)), False)
            yield got
        yield told(*left, True)[0]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _grouped(batches, ["g"]):
            v, first = np.unique(t.column("v").to_numpy(), return_index=True)
            sig, n = t.column("sig").to_pylist(), t.column("n").to_numpy()[first]
            links = np.array(alike([sig[i] for i in first], n, part, whole), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(v[links[:, 0]]), pa.array(v[links[:, 1]])], names=["a", "b"])
    rows = docs.select(text_col).mapInArrow(giving_back(parts), "key long, v long, other long")
    met = staged(rows.repartition("key").sortWithinPartitions("key", "v").mapInArrow(giving_back(meet), "a long, b long, vs array<long>"), "parts")
    groups = met.filter("vs is not null").select("vs").distinct().select(F.xxhash64("vs").alias("g"), F.explode("vs").alias("v"))
    once = sigs.filter("n > 0").groupBy("v").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    seen = (groups.join(once, "v").repartition("g").sortWithinPartitions("g").mapInArrow(giving_back(compare), "a long, b long"))
    edges = met.filter("a is not null").select("a", "b").unionByName(seen).distinct()
    return components(staged(edges, "part-edges"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal ``keys`` of sorted batches."""
    now, held = None, []
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in itertools.pairwise(cut):
            key = tuple(c[s].item() for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.take(pa.array(np.arange(s, e))))  # a copy: a slice would keep the whole batch in memory
    if held:
        yield now, pa.Table.from_batches(held)


def _solve(rows: DataFrame, keys: list[str], part: int, whole: int, sides: bool = False) -> DataFrame:
    """Links (a, b) that merge classes in each group of (v, class, data[, side]) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _grouped(batches, keys):
            v, cls, data = t.column("v").to_numpy(), t.column("class").to_numpy(), t.column("data")
            side = t.column("side").to_numpy() if sides else np.zeros(len(v), np.int64)
            order = np.lexsort((v, side))
            _, once = np.unique(np.stack([side[order], v[order]]), axis=1, return_index=True)
            order = order[np.sort(once)]
            v, cls, side = v[order], cls[order], side[order]
            second = int((side == 0).sum()) if sides else None
            if len(v) < 2 or (second is not None and second in (0, len(v))):
                continue
            classes, seen = Classes(len(v)), {}
            for i, c in enumerate(cls.tolist()):
                classes.join(i, seen.setdefault(c, i))
            links = join_sets([np.frombuffer(data[int(i)].as_buffer(), np.uint64) for i in order], part, whole, classes, second)
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(v[at[:, 0]]), pa.array(v[at[:, 1]])], names=["a", "b"])
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(giving_back(run), "a long, b long")


def _relabel(v: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the classes of ``v`` (with a column class) that ``links`` (a, b) connect."""
    of = v.select("v", "class").distinct()
    e = join_hot(links, of.select(F.col("v").alias("a"), F.col("class").alias("ca")), "a")
    e = e.join(of.select(F.col("v").alias("b"), F.col("class").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a != b")
    roots = components(e).select(F.col("v").alias("class"), F.col("root").alias("new"))
    return join_hot(v, roots, "class", "left").withColumn("class", F.coalesce("new", "class")).drop("new")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, part: int = 80, whole: int = 100,
                 keep: dict[str, Column] | None = None) -> DataFrame:
    """Classes of texts that are linked by Jaccard similarities of at least ``part / whole`` of their shingle sets.

    Returns, for every input row, (id_col, *keep, n_shingles, component_id, class): the smallest id of the class (an integer
    id) and the class itself (null for empty sets); ``keep`` adds columns made from ``docs``. Null and empty texts have an empty set and are alone: their component_id is their
    own id. Null ids are ignored when the smallest is sought; a class without any id has a null one. Repeated rows give
    one row each; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    if not 0 < part <= whole or part * SIZE_STEP < whole:
        raise ValueError(f"the threshold must be from {1 / SIZE_STEP} to 1")
    keep = keep or {}
    extra = list(keep)
    given = docs.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"), *[c.alias(x) for x, c in keep.items()])
    kinds = dict(given.dtypes)
    for seed in range(3):
        def signatures(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            worker_state(None, lambda: None)  # nothing is kept from an operator before
            for b in batches:
                for s, texts in _slices(b, 0):
                    h, o, _ = shingle_sets(texts, k)
                    n, v, check = vertices(h, o, len(texts), seed)
                    yield pa.RecordBatch.from_arrays([*(c.slice(s, len(texts)) for c in b.columns[1:]), *(pa.array(x.astype(np.int64)) for x in (n, v, check)),
                                                      pa.array(parities(h, o, n), pa.binary())], names=["_id", *extra, "n", "v", "check", "sig"])
        sigs = staged(given.mapInArrow(giving_back(signatures), "_id long, " + "".join(f"`{x}` {kinds[x]}, " for x in extra) + "n long, v long, check long, sig binary"), "signatures")
        # two different sets with one identity: start over with another seed (all but impossible)
        if sigs.groupBy("v").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x != y").isEmpty():
            break
    else:
        raise RuntimeError("different sets have one hash under three seeds")
    clusters = _clusters(docs, text_col, k, part, whole, seed, sigs)
    sigs = sigs.drop("sig")

    # sets of the clusters' vertices: a bounded set of buckets lets tasks drop most others before the shuffle
    buckets = clusters.select(F.pmod("v", F.lit(BUCKETS)).alias("b")).distinct().toArrow().column("b").to_numpy()
    wanted = np.zeros(BUCKETS, bool)
    wanted[buckets] = True
    shared = spark.sparkContext.broadcast(np.packbits(wanted))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            for _, texts in _slices(b, 0):
                h, o, _ = shingle_sets(texts, k)
                n, v, _ = vertices(h, o, len(texts), seed)
                _, once = np.unique(v, return_index=True)
                once = once[ask[v[once] % BUCKETS] & (n[once] > 0)]
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(v[once]), pa.array(n[once].astype(np.int64)),
                                                  pa.array([h[ends[i] - n[i]:ends[i]].tobytes() for i in once], pa.binary())], names=["v", "n", "data"])
    groups = staged(_groups(staged(clusters.join(sigs.select("v", "n").distinct(), "v"), "clusters"), part, whole), "groups")
    found = docs.select(text_col).mapInArrow(giving_back(sets), "v long, n long, data binary").dropDuplicates(["v"])
    sets_at = staged(found.select("v", "data").join(groups.drop("n"), "v").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int")), "sets")

    first = staged(_solve(sets_at.withColumn("class", F.col("v")), ["root", "chunk"], part, whole), "links")
    members = staged(_relabel(groups.withColumn("class", F.col("v")), first), "members")
    if not members.filter("chunks > 1").isEmpty():
        members = _large(members, sets_at, part, whole)
    members = staged(members.select("v", "class").distinct(), "members")
    if not members.groupBy("v").count().filter("count > 1").isEmpty():
        raise RuntimeError("a text is in two classes")

    classes = staged(join_hot(sigs, members, "v", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("class", "v"))), "classes")
    least = classes.filter("class is not null").groupBy("class").agg(F.min("_id").alias("component_id"))
    return join_hot(classes, least, "class", "left").select(F.col("_id").alias(id_col), *extra, F.col("n").alias("n_shingles"),
                                                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"), "class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """``docs`` with one text of every class of near duplicates: the one with the smallest id (nulls last; then the
    smallest text hash, then one of equal rows). Texts without words all stay. Columns are those of ``docs``.

    Rows that can't be in a class of two rows pass without a shuffle: a table of at most ``BUCKETS`` id buckets, whatever the
    input, tells which rows have to be looked up.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = staged(near_classes(docs, id_col, text_col, k, part, whole, keep={"_hash": text_hash}).filter("class is not null"), "classes")
    many = rows.groupBy("class").agg(F.count("*").alias("rows"), F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_hash")).alias("first"))
    many = staged(many.filter("rows > 1"), "classes")
    first = many.select(F.col("first.id").alias("_id"), F.col("first._hash").alias("_first"))
    bucket = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(BUCKETS))
    own = join_hot(rows, many.select("class"), "class").select(F.col(id_col).alias("_id"), F.col("_hash").alias("_member")).distinct()
    ask = F.broadcast(own.select(bucket(F.col("_id")).alias("_b")).distinct())
    # the row as one value, so that its columns can't clash with those used here
    whole_rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_key"), text_hash.alias("_hash"),
                             bucket(F.col(id_col)).alias("_bucket"))
    in_bucket = F.col("_bucket") == F.col("_b")
    sure = whole_rows.join(ask, in_bucket, "left_anti")
    asked = whole_rows.join(ask, in_bucket, "left_semi")
    same = lambda x: F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col(x))
    single = asked.join(own, same("_member"), "left_anti")
    chosen = asked.join(first, same("_first"), "left_semi").dropDuplicates(["_key", "_hash"])
    return sure.unionByName(single).unionByName(chosen).select("_row.*")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (v, n, root) with the number of chunks of their group."""
    chunks = rows.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    return join_hot(rows, chunks, "root")


def _groups(clusters: DataFrame, part: int, whole: int) -> DataFrame:
    """(v, n, root, chunks) from (v, root, n): the groups in which texts are compared, and the number of their chunks.

    Small clusters are groups as they are. A cluster of more than one chunk is divided by size: bands of sizes within a
    factor whole / part, a group for each two neighbouring bands. Texts that may link are in one group still.
    """
    by = _sized(clusters)
    if part == whole:
        bands = F.array(F.col("n"))
    else:  # a little wider than the factor, so that rounding can't part two texts
        band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(whole / part)))
        bands = F.array(band - 1, band)
    large = by.filter("chunks > 1").select("v", "n", F.col("root").alias("of"), F.explode(bands).alias("band"))
    return by.filter("chunks = 1").select("v", "n", "root", "chunks").unionByName(
        _sized(large.select("v", "n", F.xxhash64("of", "band").alias("root"))).select("v", "n", "root", "chunks"))


def _deals(rows: DataFrame) -> DataFrame:
    """(root, k, deals): texts of each group, and into how many deals a task's texts and shingles divide them."""
    return rows.groupBy("root").agg(F.count("*").alias("k"), F.greatest(F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("deals"))


def _large(members: DataFrame, sets_at: DataFrame, part: int, whole: int) -> DataFrame:
    """Merge classes across the chunks of large clusters, until every pair of classes has been compared."""
    # a text of a large group may have a row in a small one too: all rows are relabelled, so a text keeps one class
    members = staged(members.select("v", "n", "root", "chunks", "class"), "members")
    data = sets_at.filter("chunks > 1").select("root", "v", "data", "chunk", "chunks")
    for turn in itertools.count(1):
        large = members.filter("chunks > 1").select("v", "n", "root", "class")
        # one text per class, the classes dealt out anew each time
        reps = large.groupBy("root", "class").agg(F.min_by(F.struct("v", "n"), F.xxhash64("v", F.lit(turn))).alias("rep")).select("root", "class", "rep.v", "rep.n")
        reps = staged(reps, "reps")
        before = reps.count()
        dealt = join_hot(reps, _deals(reps), "root").withColumn("deal", F.pmod(F.xxhash64("class", F.lit(turn)), "deals").cast("int"))
        links = staged(_solve(dealt.filter("k > 1").select("root", "class", "v", "deal").join(data, ["root", "v"]), ["root", "deal"], part, whole), "links")
        members = staged(_relabel(members, links), "members")
        large = members.filter("chunks > 1").select("v", "n", "root", "class")
        after = large.select("root", "class").distinct().count()
        if after > 0.9 * before:
            break
    # every text outside its group's largest class meets all chunks of the group
    counts = large.groupBy("root", "class").agg(F.count("*").alias("k"))
    biggest = counts.groupBy("root").agg(F.max_by("class", F.struct("k", "class")).alias("big"))
    rest = join_hot(large, biggest, "root").filter("class != big").select("v", "n", "root", "class")
    sizes = _deals(rest).select("root", "deals")
    left = (join_hot(rest, sizes, "root").withColumn("deal", F.pmod(F.xxhash64("v"), F.col("deals")).cast("int")).join(data, ["root", "v"])
            .select("root", "deal", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "v", "class", "data", F.lit(0).alias("side")))
    right = (join_hot(large, sizes, "root").join(data, ["root", "v"])
             .select("root", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "chunk", "v", "class", "data", F.lit(1).alias("side")))
    links = staged(_solve(left.unionByName(right), ["root", "deal", "chunk"], part, whole, sides=True), "links")
    return _relabel(members.select("v", "class").distinct(), links)
