"""BPE encoding and decoding of byte-level vocabularies as a bounded-lookahead streaming transducer.

Text is cut by the vocabulary's pre-token pattern, and each pre-token is a byte stream for the transducer. From
the merge list alone it computes a sufficient lookahead L: text added on the right can move the leftmost changed
token border only by merges of rising rank whose right side begins at that border, so the longest such chain,
weighted by the left sides' lengths, bounds how far a change reaches back. A token that ends L bytes or more before
the end of what was read is therefore stable: it is emitted and forgotten, and what follows it is tokenised on its
own. Memory is one window of L plus a fixed step, however long the stream. Every pre-token is such a stream; those of a slice of
texts advance together, a window each, so that their windows merge in whole arrays.

Decoding turns ids into bytes and runs an incremental UTF-8 state machine over them, so a character may be spread
over any number of tokens; undecodable bytes become U+FFFD.

Space-separated pieces repeat, so a worker keeps a bounded memo from piece to ids; it changes no result.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import IntTable, worker_state
from pairforge.session import ensure_checkpoint_dir

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_PRE = regex.compile(PATTERN)
#: Pieces that the pattern never joins: a run of non-spaces with at most one space before it, or white space.
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python's \s also has these; texts with them are cut by the full pattern.
_ODD = "\x1c\x1d\x1e\x1f"
STEP = 256
MEMO = 400_000
NO_MERGE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for
    themselves, the others for U+0100 and on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Streaming encoder and decoder for one merge list."""

    def __init__(self, spec: str):
        got = json.loads(spec)
        alphabet = byte_alphabet()
        vocab = got["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in got["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in got["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in got["model"]["merges"]]
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.lookahead = self._lookahead()
        made = {rank: c for rank, c in self.merges.values()}
        self._pairs = IntTable([a << 32 | b for a, b in self.merges], [rank for rank, _ in self.merges.values()], NO_MERGE)
        self._made_at = np.array([made.get(r, -1) for r in range(len(pairs))], np.int64)
        self._byte_ids = np.array(self.byte_id, np.int64)
        self._lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._long: list[str] = []

    def _lookahead(self) -> int:
        made_from: dict[int, int] = {}  # token -> left part of the merge that makes it
        reach: dict[int, int] = {}  # left side of a merge -> longest chain that ends with such a merge
        for (a, b), (_, c) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            best, t = reach.get(b, 0), b
            while t in made_from:
                t = made_from[t]
                best = max(best, reach.get(t, 0))
            reach[a] = max(reach.get(a, 0), best + len(self.bytes_of[a]))
            made_from.setdefault(c, a)
        return max(reach.values(), default=0) + 1

    def stream_many(self, streams: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, whose streams advance together: each round every stream reads on, merges its window, and emits
        the tokens that end before its lookahead (all, at its end). A stream holds ``STEP`` and the lookahead of bytes at most."""
        out: list[list[bytes]] = [[] for _ in streams]
        done, read, live = [0] * len(streams), [0] * len(streams), [i for i, d in enumerate(streams) if d]
        while live:
            for i in live:
                read[i] = min(len(streams[i]), max(read[i], done[i] + self.lookahead) + STEP)
            rest = []
            for i, raw in zip(live, self._merge_windows([streams[i][done[i]:read[i]] for i in live]), strict=True):
                if read[i] < len(streams[i]):
                    ends = np.cumsum(self._lengths[np.frombuffer(raw, np.int32)])
                    k = int(np.searchsorted(ends, read[i] - done[i] - self.lookahead, side="right"))
                    raw = raw[:4 * k]
                    done[i] += int(ends[k - 1]) if k else 0
                    rest.append(i)
                out[i].append(raw)
            live = rest
        return [b"".join(x) for x in out]

    def _merge_windows(self, streams: list[bytes]) -> list[bytes]:
        """Ids of many windows, merged together: each round every window applies its lowest rank."""
        out_of = np.repeat(np.arange(len(streams)), list(map(len, streams)))
        ids = self._byte_ids[np.frombuffer(b"".join(streams), np.uint8)]
        done_of, done_ids = [], []
        while len(ids):
            rank = np.full(len(ids), NO_MERGE, np.int64)
            inner = np.flatnonzero(out_of[1:] == out_of[:-1])
            rank[inner] = self._pairs.find(ids[inner] << 32 | ids[inner + 1])
            starts = np.flatnonzero(np.r_[True, out_of[1:] != out_of[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            live = best < NO_MERGE
            done_of.append(out_of[~live])
            done_ids.append(ids[~live])
            ids, out_of, rank, best = ids[live], out_of[live], rank[live], best[live]
            hit = np.flatnonzero(rank == best)
            if not len(hit):
                break
            # of overlapping places (the same token three times and more) every second one, from the left
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (best[hit[1:]] != best[hit[:-1]])]
            at = np.arange(len(hit))
            hit = hit[(at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0]
            ids[hit] = self._made_at[best[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, out_of = ids[keep], out_of[keep]
        owner, flat = np.concatenate(done_of), np.concatenate(done_ids).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        raw, ends = flat[order].tobytes(), np.cumsum(np.bincount(owner, minlength=len(streams))) * 4
        return [raw[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, pieces: set[str]) -> None:
        """Afterwards the memo has all ``pieces``."""
        memo = self._memo
        for p in self._long:  # pieces over 64 characters are held for one call only
            memo.pop(p, None)
        self._long = [p for p in pieces if len(p) > 64]
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > MEMO:
            self._old, self._memo = memo, {}
            memo, new = self._memo, list(pieces)
        old, ask = self._old, {}
        for p in new:
            got = old.get(p)
            if got is not None:
                memo[p] = got
            else:
                ask[p] = [p] if (p[1:] if p[0] == " " else p).isalpha() else _PRE.findall(p)
        if ask:
            pres = list({x for pres in ask.values() for x in pres})
            ids = dict(zip(pres, self.stream_many([x.encode("utf-8", "surrogatepass") for x in pres]), strict=True))
            for p, pres in ask.items():
                memo[p] = ids[p] if len(pres) == 1 else b"".join([ids[x] for x in pres])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as native 32-bit integers; special tokens in a text get their own id."""
        segments = [self._segments(t) for t in texts]
        cut = [[p for s in segs if s not in self.special for p in self._pieces(s)] for segs in segments]
        self._learn(set().union(*cut))
        memo, out = self._memo, []
        for segs, pieces in zip(segments, cut, strict=True):
            if len(segs) == 1 and segs[0] not in self.special:
                out.append(b"".join([memo[p] for p in pieces]))
            else:
                out.append(b"".join([self.special[s].to_bytes(4, sys.byteorder) if s in self.special
                                     else b"".join([memo[p] for p in self._pieces(s)]) for s in segs]))
        return out

    def _segments(self, text: str) -> list[str]:
        """The text cut at its special tokens."""
        return self._split.split(text) if self._split and any(s in text for s in self.special) else [text]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        return _PRE.findall(text) if any(c in text for c in _ODD) else _PIECE.findall(text)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int], block: int = 65_536) -> str:
        """Text of ``ids``, by the incremental state machine, a block at a time; unknown ids give nothing."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table, n = self.bytes_of, len(self.bytes_of)
        out = [machine.decode(b"".join([table[i] for i in ids[s:s + block] if 0 <= i < n])) for s in range(0, len(ids), block)]
        return "".join(out) + machine.decode(b"", True)


def _transducer(key: int, spec) -> Transducer:
    """One transducer (with its memo) per worker and vocabulary."""
    return worker_state(("bpe", key), lambda: Transducer(spec.value))


def _shared(df: DataFrame, path: str):
    """The vocabulary file's text, read once on the driver; its size is that of the file, whatever the data."""
    ensure_checkpoint_dir(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return hash(text), df.sparkSession.sparkContext.broadcast(text)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: (id_col, ids array<int>).

    Null and empty texts give no ids. Rows keep their number (repeated rows, null ids); an empty table stays
    empty; other columns are not read.
    """
    key, spec = _shared(docs, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(key, spec)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                got = [np.frombuffer(x, np.int32) for x in t.encode_many([x or "" for x in part.column(1).to_pylist()])]
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode every row: (id_col, ids, text). Null or empty ids give an empty text; null elements and unknown ids nothing."""
    key, spec = _shared(encoded, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(key, spec)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                lists = part.column(1)
                flat, ends = lists.values, lists.offsets.to_numpy()
                text = []
                for i in range(part.num_rows):
                    ids = flat.slice(ends[i], ends[i + 1] - ends[i]).drop_null() if lists.is_valid()[i].as_py() else None
                    text.append(t.decode(ids.to_numpy(zero_copy_only=False).tolist()) if ids is not None else "")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=[id_col, "ids", "text"])
    return encoded.select(id_col, F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, ids array<int>, text string")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2(F.col("text"), 256).alias("decoded_sha256"))
