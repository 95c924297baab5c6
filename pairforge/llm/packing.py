"""Best-fit packing of token sequences by patterns from non-negative least squares.

Only the histogram of piece lengths (at most ``cap`` counts) reaches the driver. There, lengths are grouped into
bins, the patterns of up to three bins that fill a sequence are enumerated, and non-negative least squares fits how
often each pattern is repeated so that the patterns use up the histogram. Rounded down, the repeats are filled with
exact lengths: the longest of each bin, and in the last place the longest that still fits (a pattern whose last place
would leave a bin's width empty ends). The lengths left over go, longest first, into the fullest sequences that still
hold them, or open new ones. All of this works on counts: one step places all pieces of one length into all
equal sequences, so its cost depends on ``cap`` and not on the number of pieces.

The plan says for each length which ranks go where. In Spark every piece learns its rank among the pieces of its
length (counted within buckets, so that a length that a third of the pieces share is dealt out) and looks up its
place. The plan is broadcast: its rows are bounded by ``cap`` and the number of patterns.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.bpe import byte_alphabet
from pairforge.llm.common import staged, worker_state
from pairforge.session import ensure_checkpoint_dir

#: Pre-tokens that a worker's memo holds in each of its two generations.
MEMO = 100_000
#: Up to here normal form C changes nothing and lower case is that of each character, by any version of Unicode.
_LATIN_END = 0x180


# --- tokens -----------------------------------------------------------------------------------------------------

class _Memo(dict):
    """Ids of pre-tokens, asked for when they are missing. Full, it becomes the old generation, and what is used again comes back
    from there; pre-tokens over 64 characters aren't held."""

    def __init__(self, ask: Callable[[str], bytes], most: int):
        super().__init__()
        self._ask, self._most, self.old = ask, most, {}

    def __missing__(self, pre: str) -> bytes:
        got = self.old.get(pre)
        if got is None:
            got = self._ask(pre)
        if len(pre) <= 64:
            if len(self) >= self._most:
                self.old = dict(self)
                self.clear()
            self[pre] = got
        return got


class _WordIds:
    """Ids of whole texts by the tokenizers library, whose model is asked once for each pre-token that a worker's memo doesn't hold.

    A text is normalised, cut by the vocabulary's pre-token pattern, and looked up. Text below U+0180 is normalised and cut by
    Python alone; other text by the library's normaliser and the pattern with all of Unicode's classes. Texts with a special token are
    left to the whole library.
    """

    def __init__(self, spec: str, most: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_str(spec)
        self._library.no_padding()
        self._library.no_truncation()
        self._normal, self._model = self._library.normalizer, self._library.model
        pattern = json.loads(self._library.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"]["Regex"]
        self._pre = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        for name, kind in ((r"\s", r"\p{White_Space}"), (r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}")):
            pattern = pattern.replace(name, "".join(map(re.escape, regex.findall(kind, "".join(map(chr, range(_LATIN_END)))))))
        self._pre_latin = re.compile(pattern)
        self._beyond = re.compile(f"[^\0-{chr(_LATIN_END - 1)}]")
        self._byte_char = {b: c for c, b in byte_alphabet().items()}
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._memo = _Memo(self._ask, most)

    def _ask(self, pre: str) -> bytes:
        mapped = pre if pre.isascii() and pre.isprintable() else "".join([self._byte_char[b] for b in pre.encode("utf-8", "surrogatepass")])
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or not self._beyond.search(text):
            return self._pre_latin.findall(text.lower())
        return self._pre.findall(self._normal.normalize_str(text))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as native unsigned 32-bit integers."""
        get, special = self._memo.__getitem__, self._special
        return [array("I", self._library.encode(t, add_special_tokens=False).ids).tobytes() if any(s in t for s in special)
                else b"".join(map(get, self._cut(t))) for t in texts]


def tokenize_pieces(docs: DataFrame, vocab_path: str, cap: int = 4096, end_id: int | None = 1, id_col: str = "doc_id",
                    text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut every document's ids (null text: empty; ``end_id`` appended unless None) into pieces of ``cap`` tokens.

    Returns (id_col, piece, start, length, ids_crc32[, ids array<int>]), a row per piece; the last piece of a document may
    be shorter, and a document without any id has no piece.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    with open(vocab_path, encoding="utf-8") as f:
        text = f.read()
    key, spec = hash(text), docs.sparkSession.sparkContext.broadcast(text)
    tail = b"" if end_id is None else array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(("packing", key), lambda: _WordIds(spec.value))
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, got in enumerate(words.ids([t or "" for t in part.column(1).to_pylist()])):
                    got += tail
                    for k, o in enumerate(range(0, len(got), 4 * cap)):
                        cut = got[o:o + 4 * cap]
                        at.append(i)
                        piece.append(k)
                        start.append(o // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(np.frombuffer(cut, np.uint32).astype("<u4", copy=False).tobytes()))
                        if with_ids:
                            ids.append(np.frombuffer(cut, np.int32))
                cols = [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids,
                                                 names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# --- plan, on counts --------------------------------------------------------------------------------------------

def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        grad = atb - ata @ x
        grad[free] = -np.inf
        j = int(np.argmax(grad)) if n else 0
        if not n or grad[j] <= tol:
            break
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            z = np.linalg.lstsq(ata[np.ix_(idx, idx)], atb[idx], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[idx] = z
                break
            low = z <= 0
            step = np.min(x[idx][low] / np.maximum(x[idx][low] - z[low], 1e-300))
            x[idx] += step * (z - x[idx])
            drop = idx[(x[idx] <= 1e-12) & low]
            if not len(drop):
                drop = idx[low][:1]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


def patterns(bins: int, parts: int = 3) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``parts`` bin numbers 1..bins with the sum ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < parts:
            for k in range(min(most, left), 0, -1):
                if k * (parts - len(head)) < left:
                    break
                grow((*head, k), left - k, k)
    grow((), bins, bins)
    return out


def pack_histogram(counts: dict[int, int], cap: int, bins: int = 64) -> list[tuple[int, int, int, int, int, int]]:
    """Place all counted lengths: rows (length, first rank, last rank + 1, first sequence, pieces per sequence, offset).

    The pieces of that length with these ranks go, ``pieces per sequence`` at a time and end to end from ``offset``,
    into consecutive sequences.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    next_rank = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    spaces: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences)
    sizes: list[int] = []  # the keys of spaces, in order

    def place(length: int, n: int, first_seq: int, per: int, offset: int) -> None:
        r = next_rank[length]
        plan.append((length, r, r + n, first_seq, per, offset))
        next_rank[length] = r + n
        left[length] -= n

    def free(space: int, first_seq: int, n: int) -> None:
        if n and space:
            if space not in spaces:
                bisect.insort(sizes, space)
            spaces.setdefault(space, []).append((first_seq, n))

    # patterns over bins; a length belongs to the bin that it fits in, rounded up
    width = max(1, cap // bins)
    bins = cap // width
    bin_of = {length: min(bins, -(-length // width)) for length in left}
    per_bin = np.zeros(bins + 1)
    for length, n in left.items():
        per_bin[bin_of[length]] += n
    table = [p for p in patterns(bins) if all(per_bin[k] for k in p)]
    if table:
        a = np.zeros((bins, len(table)))
        for j, p in enumerate(table):
            for k in p:
                a[k - 1, j] += 1
        scale = max(1.0, per_bin.max())
        repeats = np.floor(nnls(a, per_bin[1:] / scale) * scale + 1e-9).astype(np.int64)
        stock = {k: sorted((x for x in left if bin_of[x] == k), reverse=True) for k in range(1, bins + 1)}
        lengths = sorted(left)  # with pieces left
        for j in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[j])
            while todo > 0:
                # the longest length left of each bin but the last, then the longest that still fits
                use: list[int] = []
                for k in table[j][:-1]:
                    x = next((x for x in stock[k] if left[x] > use.count(x)), None)
                    if x is None:
                        break
                    use.append(x)
                room = cap - sum(use)
                i = bisect.bisect_right(lengths, room) - 1
                while i >= 0 and left[lengths[i]] <= use.count(lengths[i]):
                    i -= 1
                if len(use) < len(table[j]) - 1 or i < 0 or room - lengths[i] >= width:
                    break  # what is left here goes with the rest
                use.append(lengths[i])
                n = min([todo, *(left[x] // use.count(x) for x in use)])
                offset = 0
                for x, same in itertools.groupby(sorted(use, reverse=True)):
                    per = len(list(same))
                    place(x, n * per, sequences, per, offset)
                    offset += per * x
                    if not left[x]:
                        del lengths[bisect.bisect_left(lengths, x)]
                free(cap - offset, sequences, n)
                sequences += n
                todo -= n
    # the rest, longest first, into the fullest sequence that holds it
    for length in sorted(left, reverse=True):
        while left[length]:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                space = sizes[i]
                first, n = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space], sizes[i]
            else:
                space, first = cap, sequences
                n = -(-left[length] // (cap // length))
                sequences += n
            per = min(space // length, left[length])
            full = min(n, left[length] // per)
            place(length, full * per, first, per, cap - space)
            free(space - per * length, first, full)
            rest = left[length] if full < n else 0  # fewer than per pieces, for one more sequence
            if rest:
                place(length, rest, first + full, rest, cap - space)
                free(space - rest * length, first + full, 1)
                full += 1
            free(space, first + full, n - full)
    return plan


def pack(pieces: DataFrame, cap: int = 4096, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to a table of pieces: sequences of at most ``cap`` tokens, gapless from 0.

    Lengths must be from 1 to ``cap`` (others raise); null lengths are refused too. Repeated rows are packed each.
    An empty table stays empty. ``pieces`` is read several times: pass a staged table.
    """
    spark = pieces.sparkSession
    ensure_checkpoint_dir(spark)
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count("*")).limit(cap + 2).collect()}
    if any(x is None or not 1 <= x <= cap for x in counts):
        raise ValueError(f"piece lengths must be from 1 to {cap}")
    plan = np.array(sorted(pack_histogram(counts, cap)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(plan)

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cols = list(order_cols)
    p = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    group = [length_col, "_bucket"]
    before = (p.groupBy(*group).agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
              .select(*group, F.coalesce("_before", F.lit(0)).alias("_before")))
    rest = [c for c in pieces.columns if c not in cols and dict(pieces.dtypes)[c] in ("bigint", "int", "string")]
    ranked = (p.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*cols, *rest)) - 1)
              .join(before, group).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_before", "_bucket"))
    names = [c for c in ranked.columns if c != "_rank"]
    kinds = dict(ranked.dtypes)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for b in batches:
            length = b.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            hit = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            j = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(hit[:, 3] + j // hit[:, 4]), pa.array(hit[:, 5] + j % hit[:, 4] * length)],
                names=[*names, "sequence_id", "offset"])
    return ranked.select(*names, "_rank").mapInArrow(look_up, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab_path: str, cap: int = 4096, end_id: int | None = 1, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Tokenise whole documents, cut those over ``cap`` tokens, and pack the pieces into as few sequences as it can.

    Null and empty texts are one piece with the end id; null ids and repeated rows are packed like others; an
    empty table gives no rows; other columns are not read. Returns (id_col, piece, start, length, ids_crc32,
    sequence_id, offset).
    """
    pieces = staged(tokenize_pieces(docs, vocab_path, cap, end_id, id_col, text_col), "pieces")
    got = pack(pieces, cap, order_cols=(id_col, "piece"))
    return got.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
