"""Ranked lexical search by presence masks.

The items' terms are the vocabulary of a search. One pass over the documents counts their document frequencies, the
documents and all terms; a second pass searches. A task of the second pass cuts its documents into blocks and holds, of
each block, the postings of the vocabulary. For an item, every term is a bit; setting the bits of the terms' postings groups the block's
documents by the mask of terms they hold. A mask's largest possible score is the sum, over its bits, of a term's largest
contribution in the block. Documents that hold only terms whose largest contributions together can't reach the item's k-th
score so far get no mask. Masks are evaluated from the largest bound down, document by document, until the next bound is below the
k-th score; bounds that equal it are evaluated, since ties go to the smaller id.

Each task returns the best k documents of every item; Spark merges them. Nothing but counts of the vocabulary reaches the driver. The
vocabulary and the items are broadcast in chunks of a bounded number of bytes, each with passes of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairforge.llm.common import arrow_rows, staged
from pairforge.session import ensure_checkpoint_dir

#: Most documents and terms of a block (a longer document is a block), and bytes of items broadcast at once.
BLOCK_DOCS, BLOCK_TERMS, CHUNK_BYTES = 16_384, 4_000_000, 32 << 20
#: Documents evaluated at a time, at least, while masks are taken from the largest bound down.
STEP = 64
#: 0-9, A-Z, a-z and all bytes of characters beyond ASCII make up terms; A-Z is lower-cased.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Items:
    """Terms of all items of a chunk: ``ids`` of the items, ``vocabulary`` (term -> number), ``terms`` (numbers of each item)."""

    def __init__(self, ids: list, terms: list[list[bytes]]):
        self.ids = ids
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [np.array(sorted(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in set(ts)), np.int64) for ts in terms]


class Block:
    """Postings of the vocabulary over some documents: of term t, ``docs[start[t]:start[t + 1]]`` with contributions ``gain``."""

    def __init__(self, ids: list[int], sizes: list[int], terms: list[np.ndarray], n_terms: int, docs_total: int, terms_total: int):
        self.ids = np.array(ids, np.int64)
        size = np.array(sizes, np.int64)
        if 90 * int(size.max(initial=0)) * docs_total < 1 << 63:
            m = 10 + 90 * size * docs_total // max(1, terms_total)
        else:
            m = np.array([10 + 90 * int(s) * docs_total // max(1, terms_total) for s in size], np.int64)
        doc = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        key = np.concatenate(terms) * len(ids) + doc if terms else np.zeros(0, np.int64)
        key, tf = np.unique(key, return_counts=True)
        term, self.docs = np.divmod(key, max(1, len(ids)))
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        self.gain = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.most = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gain, self.start[held])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the best ``k`` among ``best`` and this block."""
        most = weights[terms] * self.most[terms]
        use = np.flatnonzero(most)
        use = use[np.argsort(-most[use], kind="stable")]
        terms, most = terms[use], most[use]
        rest = np.cumsum(most[::-1])[::-1]  # no document whose first term is the i-th scores more
        floor = int(best[0][-1]) if len(best[0]) == k else 1
        leading = int(np.searchsorted(-rest, -floor, side="right"))
        if not leading:
            return best
        spans = [slice(self.start[t], self.start[t + 1]) for t in terms]
        mask = np.zeros((-(-len(terms) // 64), len(self.ids)), np.uint64)
        for i, s in enumerate(spans):
            mask[i >> 6, self.docs[s]] |= np.uint64(1 << (i & 63))
        lead = np.concatenate([self.docs[s] for s in spans[:leading]])
        held = np.zeros(len(self.ids), bool)
        held[lead] = True
        found = np.flatnonzero(held)
        if len(mask) == 1:
            kinds, kind = np.unique(mask[0][found], return_inverse=True)
            kinds = kinds[None]
        else:
            kinds, kind = np.unique(mask[:, found], axis=1, return_inverse=True)
        bit = np.arange(len(terms))
        bound = np.zeros(kinds.shape[1], np.int64)
        for i in bit:  # bounds of all distinct masks, a bit at a time
            bound += np.where(kinds[i >> 6] >> np.uint64(i & 63) & np.uint64(1), most[i], 0)
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_mask = np.argsort(place[kind.ravel()], kind="stable")
        found, ends = found[by_mask], np.cumsum(np.bincount(place[kind.ravel()], minlength=len(order)))
        done = group = 0
        while group < len(order) and bound[order[group]] >= floor:
            last = min(len(order) - 1, int(np.searchsorted(ends, done + STEP)))
            last = min(last, int(np.searchsorted(-bound[order], -floor, side="right")) - 1)
            docs = np.sort(found[done:ends[last]])
            total = np.zeros(len(docs), np.int64)
            for t, s in zip(terms, spans, strict=True):
                at = np.minimum(np.searchsorted(self.docs[s], docs), s.stop - s.start - 1)
                total += np.where(self.docs[s][at] == docs, self.gain[s][at] * weights[t], 0)
            scores, ids = np.concatenate([best[0], total]), np.concatenate([best[1], self.ids[docs]])
            top = np.lexsort((ids, -scores))[:k]
            best = scores[top], ids[top]
            floor = int(best[0][-1]) if len(top) == k else 1
            done, group = int(ends[last]), last + 1
        return best


def _counted(docs: DataFrame, shared) -> dict[int, int]:
    """Document frequency by term number; -1: documents with a term, -2: all terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.vocabulary.get
        seen, n, size = np.zeros(len(shared.value.vocabulary), np.int64), 0, 0
        for b in batches:
            for text in b.column(0):
                words = terms_of(text.as_py())
                n, size = n + bool(words), size + len(words)
                known = set(words)
                ids = np.fromiter(map(get, known, repeat(-1)), np.int64, len(known))
                seen[ids[ids >= 0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(seen[at], [n, size]))], names=["t", "n"])
    return {r["t"]: r["n"] for r in docs.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}


def _chunk(docs: DataFrame, items: DataFrame, k: int, out: str) -> DataFrame:
    """The best ``k`` rows (item, id, score) of each task and item; ``items`` (item, terms) are few enough to broadcast."""
    spark = docs.sparkSession
    got = items.collect()
    held = Items([r["item"] for r in got], [[bytes(t) for t in r["terms"]] for r in got])
    shared = spark.sparkContext.broadcast(held)
    counts = _counted(docs.select("text"), shared)
    n, size = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(held.vocabulary))], np.int64)
    weighed = spark.sparkContext.broadcast(weights)
    kind = to_arrow_type(items.schema["item"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value, weighed.value
        get = items.vocabulary.get
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.ids)
        ids, sizes, terms, total = [], [], [], 0

        def flush():
            block = Block(ids, sizes, terms, len(weights), n, size)
            for i, t in enumerate(items.terms):
                best[i] = block.search(t, weights, best[i], k)
            ids.clear(), sizes.clear(), terms.clear()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(text.as_py())
                if ids and (len(ids) >= BLOCK_DOCS or total + len(words) > BLOCK_TERMS):
                    flush()
                    total = 0
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                ids.append(doc)
                sizes.append(len(words))
                terms.append(at[at >= 0])
                total += len(words)
        if ids:
            flush()
        per = [len(s) for s, _ in best]
        cat = lambda j: np.concatenate([x[j] for x in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, c in zip(items.ids, per, strict=True) for _ in range(c)], kind),
                                          pa.array(cat(1)), pa.array(cat(0))], names=["item", "id", "score"])
    return docs.filter("id is not null").mapInArrow(search, out)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(item_col, rank, id_col, score): the ``k`` highest-scoring documents of each item with a score above 0, ties by ascending id.

    A document's term that occurs tf times adds w * ((10^9 * tf) div (1000 * tf + 8 * m)), once for each distinct term of the item,
    with w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L: N documents hold a term, L is the number of all
    their terms, n that of the document, df the documents that hold the term. A null text has no terms. Each row of ``docs`` is a
    document, so repeated rows rank one after the other; a row with a null id counts in N, L and df but isn't returned.
    Rows of one item id make up one item; a null item id gives no rows, nor does an item without terms. Empty tables give no rows.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = dict(items.dtypes)[item_col]
    asked = arrow_rows(items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("text")),
                       lambda cols: {"item": cols[0], "terms": [sorted(set(terms_of(t))) for t in cols[1]]}, f"item {kind}, terms array<binary>")
    asked = staged(asked.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")), "items")
    held = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 16) + 16)).collect()[0][0] or 0
    chunks = max(1, math.ceil(held / chunk_bytes))
    out = f"item {kind}, id long, score long"
    found = None
    for c in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c)
        got = _chunk(rows, part, k, out)
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
