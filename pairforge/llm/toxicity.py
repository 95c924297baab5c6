"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters as its embedding (words that several sampled documents hold; others share one) beside the mean embeddings of its hashed
character trigrams and of its beginnings. A GRU reads the text in both directions, attention weighs its states, and a
linear layer makes a logit of the weighted mean over each window of ``WINDOW`` words. All overlapping windows are
scored, at every word: a window's weighted mean is a ratio of two sliding sums, so the states of a word are computed once.
The text's logit is the largest of its windows.

A long text is read in pieces of ``PIECE`` windows; a piece's states are computed from ``CONTEXT`` words before and behind it, so
memory doesn't grow with the text, and a text's score doesn't depend on the texts beside it.

Training sees a bounded sample of labelled documents, with all windows of their whole texts; a document's loss is on a soft maximum
over its windows, since the label doesn't say where the toxic words stand. A scale and an offset, fitted on the
maxima over whole texts, turn the logit into a probability.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import giving_back, lower_words_of, worker_state
from pairforge.session import ensure_checkpoint_dir

WINDOW, PIECE, CONTEXT = 32, 448, 16
#: Windows of a piece in training: shorter pieces, more of them side by side.
TRAIN_PIECE = 128
GRAMS, EMBED, HIDDEN, ATTEND = 4096, 8, 12, 8
#: Lengths, in bytes, of the beginnings of a word that have an embedding.
BEGIN = (4, 5, 6, 7)
#: Most sampled documents of labels 0 and 1.
SAMPLE_DOCS = (3000, 1000)
EDGES = b".,;:!?\"'()[]{}*#|<>-_%$&"
MEMO = 120_000
#: Texts that are tokenized at once.
SLICE = 128


def pieces(n: int, piece: int = PIECE) -> list[tuple[int, int, int, int]]:
    """(first word, end of the words, first window, end of the windows) of the pieces of a text of ``n`` words. There is a window
    at every word up to the last that a whole window fits behind; a text shorter than a window is one window."""
    starts = max(1, n - WINDOW + 1)
    return [(max(0, s - CONTEXT), min(n, e + WINDOW - 1 + CONTEXT), s, e) for s in range(0, starts, piece) for e in (min(starts, s + piece),)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sum_rows(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by position ``at``."""
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        a = at[order]
        head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        out[a[head]] = np.add.reduceat(values[order], head, axis=0)
    return out


def starts_of(word: bytes) -> list[bytes]:
    """The beginnings of a word without edge marks; the shortest stands for a shorter word too."""
    return [word[:k] for k in BEGIN if k <= len(word)] or [word]


@dataclass
class Batch:
    """Pieces, longest first: ``idx`` (pieces, time) are rows of the word table, in text order and reversed, both from time 0 on;
    ``live[t]`` pieces have a word at time t. ``first`` and ``last`` are the windows of a piece, counted from its first word."""

    idx: np.ndarray
    back: np.ndarray
    size: np.ndarray
    live: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(docs: list[np.ndarray], piece: int = PIECE) -> Batch:
        rows = [(e - s, a, b, d, s) for d, x in enumerate(docs) for s, e, a, b in pieces(len(x), piece)]
        rows.sort(key=lambda r: -r[0])
        size = np.array([r[0] for r in rows], np.int64)
        idx, back = (np.zeros((len(rows), int(size[0])), np.int64) for _ in range(2))
        for i, (n, _, _, d, s) in enumerate(rows):
            idx[i, :n] = docs[d][s:s + n]
            back[i, :n] = idx[i, :n][::-1]
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")
        start = np.array([r[4] for r in rows])
        return Batch(idx, back, size, live, np.array([r[1] for r in rows]) - start, np.array([r[2] for r in rows]) - start, np.array([r[3] for r in rows]))

    def turned(self, x: np.ndarray) -> np.ndarray:
        """(time, pieces, ...) of reversed pieces in text order, and the other way round."""
        t = self.size[None, :] - 1 - np.arange(x.shape[0])[:, None]
        out = x[np.maximum(t, 0), np.arange(x.shape[1])[None, :]]
        out[t < 0] = 0
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all windows."""
        count = self.last - self.first
        piece = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + self.first[piece]
        return start, np.minimum(start + WINDOW, self.size[piece]), piece


class Network:
    """Parameters ``w`` (name -> float32 array), the words and beginnings that have embeddings, and the final scale and offset."""

    def __init__(self, words: list[bytes], starts: list[bytes], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.word_id = {x: i + 1 for i, x in enumerate(words)}  # 0: any other
        self.start_id = {x: i + 1 for i, x in enumerate(starts)}
        codes = {int.from_bytes(x, "little") | len(x) << 56: i for x, i in self.start_id.items() if 0 < len(x) < 8}
        self.start_codes = np.array(sorted(codes), np.uint64)
        self.start_rows = np.array([codes[c] for c in sorted(codes)], np.int64)
        d, h = 3 * EMBED, HIDDEN

        def init(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)
        self.w = {"word": init(len(words) + 1, EMBED, scale=0.1), "gram": init(GRAMS, EMBED, scale=0.1), "start": init(len(starts) + 1, EMBED, scale=0.1),
                  "in": init(d, 6 * h, scale=d ** -0.5), "in_b": np.zeros(6 * h, np.float32),
                  "fwd": init(h, 3 * h, scale=h ** -0.5), "bwd": init(h, 3 * h, scale=h ** -0.5),
                  "att": init(2 * h, ATTEND, scale=(2 * h) ** -0.5), "att_v": init(ATTEND, scale=ATTEND ** -0.5),
                  "out": init(2 * h, scale=(2 * h) ** -0.5), "out_b": np.zeros(1, np.float32)}
        self.scale, self.offset = 1.0, 0.0

    # words -> inputs
    def features(self, words: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Word ids, and (ids, counts) of the hashed character trigrams (with edge marks) and of the beginnings of all words, end to end."""
        bare = [x.strip(EDGES) or x or b" " for x in words]
        counts = np.fromiter(map(len, bare), np.int64, len(bare))
        raw = np.frombuffer(b"^" + b"$^".join(bare) + b"$", np.uint8).astype(np.uint32)
        h = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(13))) & np.uint32(GRAMS - 1)
        keep = np.ones(len(h), bool)  # a word of n bytes has n trigrams; the two after them reach into the next word
        ends = np.cumsum(counts + 2) - 2
        keep[ends[:-1]] = False
        keep[ends[:-1] + 1] = False
        # beginnings as numbers: up to seven bytes, and their length in the eighth
        text = np.frombuffer(b"".join(bare) + bytes(7), np.uint8)
        first = np.cumsum(counts) - counts
        head = np.zeros(len(bare), np.uint64)
        begin = np.zeros((len(bare), len(BEGIN)), np.int64)
        for at in range(BEGIN[-1]):
            head |= np.where(at < counts, text[first + at], 0).astype(np.uint64) << np.uint64(8 * at)
            if at + 1 in BEGIN:
                size = np.minimum(counts, at + 1) if at + 1 == BEGIN[0] else np.full(len(bare), at + 1)
                begin[:, BEGIN.index(at + 1)] = np.where(counts >= size, self._starts(head | size.astype(np.uint64) << np.uint64(56)), 0)
        known = begin > 0
        known[~known.any(axis=1), 0] = True
        return (np.fromiter((self.word_id.get(x, 0) for x in bare), np.int64, len(bare)), (h[keep].astype(np.int64), counts),
                (begin[known], known.sum(axis=1)))

    def _starts(self, codes: np.ndarray) -> np.ndarray:
        """Ids of beginnings, 0 if not known."""
        if not len(self.start_codes):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.start_codes, codes), len(self.start_codes) - 1)
        return np.where(self.start_codes[at] == codes, self.start_rows[at], 0)

    def inputs(self, feats) -> np.ndarray:
        ids, *sets = feats
        out = [self.w["word"][ids]]
        for name, (at, counts) in zip(("gram", "start"), sets, strict=True):
            sums = np.add.reduceat(self.w[name][at], np.cumsum(counts) - counts, axis=0) if len(ids) else np.zeros((0, EMBED), np.float32)
            out.append(sums / counts[:, None].astype(np.float32))
        return np.concatenate(out, axis=1)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input side of the gates, per word: forwards and backwards."""
        both = x @ self.w["in"] + self.w["in_b"]
        return np.ascontiguousarray(both[:, :3 * HIDDEN]), np.ascontiguousarray(both[:, 3 * HIDDEN:])

    # pieces -> logits of windows
    def _direction(self, side: np.ndarray, idx: np.ndarray, live: np.ndarray, name: str, tape: list | None) -> np.ndarray:
        """States (time, pieces, hidden) of one direction, in its own order; zero where a piece has no word."""
        h, u = HIDDEN, self.w[name]
        state = np.zeros((len(idx), h), np.float32)
        out = np.zeros((idx.shape[1], len(idx), h), np.float32)
        for t, k in enumerate(live.tolist()):
            x, prev = side[idx[:k, t]], state[:k]
            hu = prev @ u
            zr = _sigmoid(x[:, :2 * h] + hu[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h:] + r * hu[:, 2 * h:])
            if tape is not None:
                tape.append((prev, hu[:, 2 * h:], z, r, c))
            state = out[t, :k] = c + z * (prev - c)
        return out

    def _both(self, sides: tuple[np.ndarray, np.ndarray], b: Batch) -> np.ndarray:
        """States (time, pieces, 2 * hidden) of both directions, each in its own order, computed together; as :meth:`_direction` without a tape."""
        h = HIDDEN
        u = np.stack([self.w["fwd"], self.w["bwd"]])
        half = np.ones(3 * h, np.float32)
        half[:2 * h] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2; halves are exact
        u *= half
        fwd, bwd = b.idx.T.copy(), b.back.T.copy()
        state = np.zeros((2, len(b.idx), h), np.float32)
        out = np.zeros((b.idx.shape[1], len(b.idx), 2 * h), np.float32)
        for t, k in enumerate(b.live.tolist()):
            x = np.empty((2, k, 3 * h), sides[0].dtype)
            np.take(sides[0], fwd[t, :k], axis=0, out=x[0], mode="clip")
            np.take(sides[1], bwd[t, :k], axis=0, out=x[1], mode="clip")
            prev = state[:, :k]
            hu = np.matmul(prev, u)
            zr = x[:, :, :2 * h]
            zr *= np.float32(0.5)
            zr += hu[:, :, :2 * h]
            zr = np.tanh(zr)
            zr += np.float32(1)
            zr *= np.float32(0.5)
            c = hu[:, :, 2 * h:]
            c *= zr[:, :, h:]
            c += x[:, :, 2 * h:]
            c = np.tanh(c)
            new = prev - c
            new *= zr[:, :, :h]
            new += c
            state = new
            out[t, :k, :h], out[t, :k, h:] = new[0], new[1]
        return out

    def logits(self, sides: tuple[np.ndarray, np.ndarray], b: Batch, tape: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """One logit per window, and its piece; ``sides`` are the projected words."""
        tf, tb = ([], []) if tape is not None else (None, None)
        if tape is None:
            states = self._both(sides, b)
            states[:, :, HIDDEN:] = b.turned(states[:, :, HIDDEN:])
        else:
            states = np.concatenate([self._direction(sides[0], b.idx, b.live, "fwd", tf), b.turned(self._direction(sides[1], b.back, b.live, "bwd", tb))], axis=2)
        a = np.tanh(states @ self.w["att"])
        e = np.exp((a @ self.w["att_v"]).astype(np.float64))
        y = (states @ self.w["out"]).astype(np.float64)
        weight, value = (np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)]) for x in (e, e * y))
        start, end, piece = b.windows()
        below, above = weight[end, piece] - weight[start, piece], value[end, piece] - value[start, piece]
        if tape is not None:
            tape.update(f=tf, b=tb, states=states, a=a, e=e, y=y, below=below, above=above)
        return (above / below + self.w["out_b"][0]).astype(np.float32), piece

    def gradients(self, dlogit: np.ndarray, tape: dict, n_rows: int, b: Batch) -> tuple[dict, np.ndarray]:
        """Gradients of the weights above the projection, and of the projection."""
        w, h = self.w, HIDDEN
        states, a, e, y = tape["states"], tape["a"], tape["e"], tape["y"]
        start, end, piece = b.windows()
        shape = (e.shape[0] + 1, e.shape[1])

        def spread(g: np.ndarray) -> np.ndarray:
            """Sum, for each word, of the gradients of the windows that hold it."""
            d = np.zeros(shape)
            np.add.at(d, (start, piece), g)
            np.add.at(d, (end, piece), -g)
            return np.cumsum(d, axis=0)[:-1]
        dvalue = spread(dlogit / tape["below"])
        dweight = spread(-dlogit * tape["above"] / tape["below"] ** 2)
        dy = (dvalue * e).astype(np.float32)
        ds = ((dvalue * y + dweight) * e).astype(np.float32)
        g = {"out": np.einsum("tnh,tn->h", states, dy), "out_b": np.array([dlogit.sum()], np.float32), "att_v": np.einsum("tna,tn->a", a, ds)}
        da = ds[:, :, None] * w["att_v"] * (1 - a * a)
        g["att"] = np.tensordot(states, da, axes=((0, 1), (0, 1)))
        dstates = da @ w["att"].T + dy[:, :, None] * w["out"]
        halves = []
        for name, idx, d in (("fwd", b.idx, dstates[:, :, :h]), ("bwd", b.back, b.turned(dstates[:, :, h:]))):
            u = w[name]
            du = np.zeros_like(u)
            dproj = np.zeros((idx.shape[1], len(idx), 3 * h), np.float32)
            dh = np.zeros((len(idx), h), np.float32)
            for t in range(idx.shape[1] - 1, -1, -1):
                k = int(b.live[t])
                prev, hun, z, r, c = tape["f" if name == "fwd" else "b"][t]
                dn = dh[:k] + d[t, :k]
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (prev - c) * z * (1 - z)
                dr = dc * hun * r * (1 - r)
                dgate = np.concatenate([dz, dr, dc * r], axis=1)
                du += prev.T @ dgate
                dh[:k] = dn * z + dgate @ u.T
                dproj[t, :k, :2 * h], dproj[t, :k, 2 * h:] = dgate[:, :2 * h], dc
            g[name] = du
            held = (np.arange(idx.shape[1])[None, :] < b.size[:, None])
            halves.append(_sum_rows(idx[held], dproj.transpose(1, 0, 2)[held], n_rows))
        return g, np.concatenate(halves, axis=1)


def train(sample: list[tuple[int, list[bytes]]], share: tuple[float, float] = (1.0, 1.0), **how) -> Network | None:
    """A network fitted to (label, words) documents by :func:`fit` and calibrated on their whole texts; None without both labels. A
    document of label y stands for ``share[y]`` labelled ones when logits become probabilities."""
    sample = [(y, ws or [b""]) for y, ws in sample]
    if len({y for y, _ in sample}) < 2:
        return None
    net = fit(sample, **how)
    _calibrate(net, sample, share)
    return net


def fit(sample: list[tuple[int, list[bytes]]], epochs: int = 2, batch: int = 64, rate: float = 0.01, seed: int = 0, least: int = 5,
        decay: float = 2e-2, steps: int = 160, drop: float = 0.3) -> Network:
    """Words, and beginnings of words, of fewer than ``least`` documents share one embedding each; embeddings shrink by ``decay`` a step, and each kind
    of input of a word is left out of a step with chance ``drop``. There are at least ``epochs`` passes and ``steps`` steps."""
    bare = [{x.strip(EDGES) or x for x in ws} for _, ws in sample]
    known = [sorted(x for x, n in Counter(x for ws in sets for x in ws).items() if n >= least)
             for sets in (bare, [{b for x in ws for b in starts_of(x)} for ws in bare])]
    net = Network(*known, seed)
    rng = np.random.default_rng(seed + 1)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    batches = -(-len(sample) // batch)
    step, passes = 0, max(epochs, -(-steps // batches))
    total = passes * batches
    for _ in range(passes):
        order = rng.permutation(len(sample))
        for s in range(0, len(order), batch):
            part = [sample[i] for i in order[s:s + batch]]
            words = list(dict.fromkeys(x for _, ws in part for x in ws))
            at = {x: i for i, x in enumerate(words)}
            b = Batch.of([np.array([at[x] for x in ws]) for _, ws in part], TRAIN_PIECE)
            feats = net.features(words)
            part_of = np.repeat(rng.random((len(words), 3)) >= drop, EMBED, axis=1).astype(np.float32)  # a word's inputs fail now and then
            x = net.inputs(feats) * part_of
            tape: dict = {}
            logit, piece = net.logits(net.project(x), b, tape)
            doc = b.doc[piece]
            y = np.array([y for y, _ in part], np.float32)
            # soft maximum over a document's windows
            top = np.full(len(part), -np.inf, np.float32)
            np.maximum.at(top, doc, logit)
            e = np.exp(2 * (logit - top[doc]))
            share = (e / np.bincount(doc, e, len(part))[doc]).astype(np.float32)
            soft = np.bincount(doc, share * logit, len(part))
            grad = ((_sigmoid(soft) - y) / len(part)).astype(np.float32)
            g, dproj = net.gradients(grad[doc] * share, tape, len(x), b)
            g["in"], g["in_b"] = x.T @ dproj, dproj.sum(axis=0)
            dx = dproj @ net.w["in"].T * part_of
            g["word"] = _sum_rows(feats[0], dx[:, :EMBED], len(net.w["word"]))
            for j, name in ((1, "gram"), (2, "start")):
                rows, counts = feats[j]
                g[name] = _sum_rows(rows, np.repeat(dx[:, j * EMBED:(j + 1) * EMBED] / counts[:, None].astype(np.float32), counts, axis=0), len(net.w[name]))
            step += 1
            pace = rate * min(1.0, 2 * (1 - (step - 1) / total))  # falls over the second half
            for k in net.w:
                m[k] += 0.1 * (g[k] - m[k])
                v2[k] += 0.001 * (g[k] ** 2 - v2[k])
                if k in ("word", "gram", "start"):
                    net.w[k] *= np.float32(1 - decay)
                net.w[k] -= (pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def _calibrate(net: Network, sample: list[tuple[int, list[bytes]]], share: tuple[float, float]) -> None:
    """Logistic scale and offset on the maxima over whole texts."""
    scorer = Scorer(net)
    y = np.array([y for y, _ in sample], float)
    x = np.array([top for s in range(0, len(sample), 128) for top in scorer.maxima([ws for _, ws in sample[s:s + 128]])])
    weight = np.array([share[int(v)] for v in y])
    weight /= weight.mean()
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = _sigmoid(a * x + b)
        d = (p - y) * weight
        g = np.array([(d * x).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * b])
        q = p * (1 - p) * weight
        hess = np.array([[(q * x * x).sum() + 1e-2, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-2]])
        d = np.linalg.solve(hess, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    if a > 0:
        net.scale, net.offset = float(a), float(b)


class Scorer:
    """Scores documents with a table of word projections."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        """Only the empty word is known."""
        self._row: dict[bytes, int] = {b"": 0}
        self._sides = [np.concatenate([x, np.zeros((1023, 3 * HIDDEN), np.float32)])
                       for x in self.net.project(self.net.inputs(self.net.features([b""])))]

    def _rows(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        words = set().union(*docs)
        new = [x for x in words if x not in self._row]
        if len(self._row) + len(new) > MEMO and len(self._row) > 1:
            if len(new) < MEMO // 2 < len(self._row):  # the words that came first are the frequent ones
                self._row = {x: i for x, i in self._row.items() if i < MEMO // 2}
            else:
                self._reset()
            new = [x for x in words if x not in self._row]
            if len(self._row) + len(new) > MEMO and len(self._row) > 1:
                self._reset()
                new = [x for x in words if x]
        if new:
            n = len(self._row)
            for k, x in enumerate(self.net.project(self.net.inputs(self.net.features(new)))):
                if n + len(new) > len(self._sides[k]):
                    grown = np.zeros((max(2 * len(self._sides[k]), n + len(new)), 3 * HIDDEN), np.float32)
                    grown[:n] = self._sides[k][:n]
                    self._sides[k] = grown
                self._sides[k][n:n + len(new)] = x
            self._row.update(zip(new, range(n, n + len(new)), strict=True))
        row = self._row.__getitem__
        return [np.fromiter(map(row, d), np.int64, len(d)) if d else np.zeros(1, np.int64) for d in docs]

    def maxima(self, docs: list[list[bytes]], words: int = 150_000) -> list[float]:
        """Largest window logit of each document; documents are read together up to about ``words`` words."""
        rows = self._rows(docs)
        out = np.full(len(docs), -np.inf, np.float32)
        s = 0
        while s < len(rows):
            e, size = s, 0
            while e < len(rows) and (e == s or size + len(rows[e]) <= words):
                size += len(rows[e])
                e += 1
            b = Batch.of(rows[s:e])
            logit, piece = self.net.logits(self._sides, b)
            np.maximum.at(out[s:e], b.doc[piece], logit)
            s = e
        return out.tolist()

    def scores(self, texts: list[str | None]) -> list[float]:
        x = np.array(self.maxima([lower_words_of(t) for t in texts]), float)
        return _sigmoid(self.net.scale * x + self.net.offset).tolist()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_docs: tuple[int, int] = SAMPLE_DOCS) -> Network | None:
    """Train on the whole texts of at most ``sample_docs`` documents of labels 0 and 1 (lowest hash of the id), in one task, whose
    numpy has the threads that Spark gives a task; only the network reaches the driver.

    A document labelled twice counts as toxic if any label says so; null ids, labels and texts aren't learned from, and an id that
    several texts share counts once. Returns None if one of the labels has no document.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    total = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    picked = [r for y in (0, 1) for r in known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs[y]).collect()]
    local = docs.sparkSession.createDataFrame(picked, known.schema)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).dropna().join(F.broadcast(local), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).orderBy(F.col("_id").cast("string"), "_y")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(y, lower_words_of(t)) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        held = {y: sum(r[0] == y for r in sample) for y in (0, 1)}
        net = train(sample, share=tuple(total.get(y, 0) / max(1, held[y]) for y in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])
    got = rows.select("_y", "_text").coalesce(1).mapInArrow(fitted, "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else None


def _scorer(key: str, shared) -> Scorer | None:
    """One scorer (with its word table) per worker and network."""
    return worker_state(("toxicity", key), lambda: Scorer(shared.value) if shared.value is not None else None)


def keep_clean(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose whole text scores below ``least``; without a network all rows. A null or empty text is
    scored as one unknown word; each row is judged on its own, so repeated rows and null ids stay or go alike; an empty
    table stays empty."""
    ensure_checkpoint_dir(docs.sparkSession)
    shared, key, names = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex, docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, shared)
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                yield part.filter(pa.array([x < least for x in scorer.scores(part.column(at).to_pylist())], pa.bool_())) if scorer else part
    return docs.mapInArrow(giving_back(run), docs.schema)


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every whole text: the probability of label 1, and whether it is at least 0.5.

    Null and empty texts are scored as one unknown word; without a network every score is 0. Every row gives one row
    (repeated rows, null ids), an empty table none; other columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, shared)
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                got = scorer.scores(part.column(1).to_pylist()) if scorer else [0.0] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())],
                                                 names=[id_col, "score", "predicted"])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int")
