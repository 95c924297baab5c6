"""Loss and retrieval metrics: D5 batch scores, L1 MNRL, L2 top-1, L3 evaluation, L4 MNRL with negatives,
L5 Matryoshka loss, D6 retrieval top-k, L6 IR metrics, L7 quality gate.

In-batch scoring never emits the B x B pairs as rows. A batch of up to ``TILE_ROWS`` rows is one ``applyInPandas`` group holding a
numpy matrix product. A larger one is a grid of cells of its score matrix, a group each, scored in tiles of some rows: a cell returns,
for its rows and columns, the largest score and a log-sum-exp, which merge by cell, so a batch may have any size.

Retrieval packs queries and corpus into blocks where they lie. Few queries are broadcast to the corpus; more of them form a grid of
cells with the corpus, of bounded bytes, a group each. Within a cell, products in single precision with a bound of their error tell
which pairs need the exact score. Only counts or one running top-k per cell and query leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pairforge.session import ship_package
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reference defaults.
DEFAULT_SCALE = 20.0
GATE_MIN_TOP1 = 0.85
GATE_MAX_LOSS = 0.45
IR_KS = (1, 3, 5, 10)
QUERY_BLOCK = 2048
# Rows of one in-batch score matrix: 2,048 x 2,048 doubles are 32 MB.
TILE_ROWS = 2048
# Rows that are scored at a time against a tile's rows, corpus rows of a pack, and bytes of packed queries that are broadcast.
TILE_COLUMNS, PACK_ROWS, BROADCAST_BYTES = 4096, 1024, 32 << 20
# Queries whose running results a task keeps at a time; rows on the other side of a cell, and bytes of a side's vectors at most.
HELD_QUERIES, CELL_ROWS, CELL_BYTES = 8192, 32768, 16 << 20
# Partitions that cells are dealt to, at most (or the shuffle partitions, if more).
CELL_PARTITIONS = 8192
MATRYOSHKA_DIMS = (1024, 768, 512, 256, 128, 64)
# Retrieval scores are compared at 1e-9 resolution, so duplicate documents tie (then doc id decides) whatever
# the summation order of the engine.
SCORE_DECIMALS = 9

_ROW_SCHEMA = T.StructType([
    T.StructField("group_key", T.StringType()), T.StructField("batch_id", T.LongType()),
    T.StructField("pair_id", T.LongType()), T.StructField("diag", T.DoubleType()),
    T.StructField("row_max", T.DoubleType()), T.StructField("argmax_pair", T.LongType()),
    T.StructField("row_lse", T.DoubleType()), T.StructField("col_lse", T.DoubleType()),
    T.StructField("hit", T.IntegerType())])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    return (m + np.log(np.sum(np.exp(x - m), axis=axis, keepdims=True))).squeeze(axis)


def _stack(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _in_batch(scale: float, use_negative: bool, cosine: bool, dims: Sequence[int] | None):
    def rows(pdf: pd.DataFrame, dim: int | None) -> pd.DataFrame:
        a, p = _stack(pdf["q"])[:, :dim], _stack(pdf["p"])[:, :dim]
        if cosine:
            a, p = _unit(a), _unit(p)
        s = a @ p.T * scale
        if use_negative:
            n = _stack(pdf["n"])[:, :dim]
            if cosine:
                n = _unit(n)
            cand = np.hstack([s, a @ n.T * scale])
        else:
            cand = s
        diag = np.diag(s)
        best = np.argmax(cand, axis=1)  # first index wins ties
        ids = pdf["pair_id"].to_numpy()
        cand_ids = np.concatenate([ids, ids]) if use_negative else ids
        return pd.DataFrame({
            "group_key": "" if dim is None else str(dim), "batch_id": pdf["batch_id"].to_numpy(), "pair_id": ids,
            "diag": diag, "row_max": cand.max(axis=1), "argmax_pair": cand_ids[best],
            "row_lse": _lse(cand, 1), "col_lse": _lse(s, 0), "hit": (best == np.arange(len(ids))).astype("int32")})

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pair_id")
        return pd.concat([rows(pdf, d) for d in (dims or [None])], ignore_index=True)
    return fn


def _cell(scale: float, use_negative: bool, cosine: bool, dims: Sequence[int] | None, tile_rows: int):
    """One cell: queries of one part of a batch against the candidates of another, ``tile_rows`` queries and ``TILE_COLUMNS`` candidates at
    a time. A row per query and a row per candidate."""
    def prepared(x: np.ndarray, dim: int | None) -> np.ndarray:
        x = x[:, :dim]
        return _unit(x) if cosine else x

    def add(top: np.ndarray, total: np.ndarray, at: slice, high: np.ndarray, part: np.ndarray) -> None:
        """Adds ``part``, a sum of exponentials less ``high``, to the running sums less ``top``."""
        new = np.maximum(top[at], high)
        with np.errstate(invalid="ignore"):
            total[at] = np.where(np.isneginf(top[at]), 0.0, total[at] * np.exp(top[at] - new)) + part * np.exp(high - new)
        top[at] = new

    def score(q, sides, a_ids, c_ids):
        n, m = len(a_ids), len(c_ids)
        diag = np.full(n, np.nan)
        best, first = np.full((2, n), -np.inf), np.zeros((2, n), np.int64)
        row_top, row_sum, col_top, col_sum = np.full(n, -np.inf), np.zeros(n), np.full(m, -np.inf), np.zeros(m)
        at = np.searchsorted(c_ids, a_ids)
        own = np.append(c_ids, 0)[at] == a_ids
        own &= at < m
        for s in range(0, n, tile_rows):
            rows = slice(s, s + tile_rows)
            for c in range(0, m, TILE_COLUMNS):
                cols = slice(c, c + TILE_COLUMNS)
                for kind, p in enumerate(sides):
                    x = q[rows] @ p[cols].T * scale
                    high, wide = x.max(axis=1), x.max(axis=0)
                    more = np.flatnonzero(~(high <= best[kind, rows]))  # the first index wins ties; not a number wins, as in argmax
                    if len(more):
                        best[kind, s + more], first[kind, s + more] = high[more], c_ids[c + x[more].argmax(axis=1)]
                    if kind == 0:
                        mine = np.flatnonzero(own[rows] & (at[rows] >= c) & (at[rows] < c + TILE_COLUMNS))
                        diag[s + mine] = x[mine, at[s + mine] - c]
                    top = high.max()
                    if kind == 0 and not top - min(high.min(), wide.min()) < 500:  # far apart: exponentials less one maximum would vanish
                        add(col_top, col_sum, cols, wide, np.exp(x - wide).sum(axis=0))
                        add(row_top, row_sum, rows, high, np.exp(x - high[:, None]).sum(axis=1))
                    elif kind == 0:
                        e = np.exp(np.subtract(x, top, out=x), out=x)
                        add(col_top, col_sum, cols, np.full(e.shape[1], top), e.sum(axis=0))
                        add(row_top, row_sum, rows, np.full(len(e), top), e.sum(axis=1))
                    else:
                        x -= high[:, None]
                        add(row_top, row_sum, rows, high, np.exp(x, out=x).sum(axis=1))
        kind = (~(best[0] >= best[1])).astype(np.int32) & (len(sides) > 1)
        kind &= ~np.isnan(best[0])
        take = np.arange(n)
        return diag, best[kind, take], kind, first[kind, take], row_top + np.log(row_sum), col_top + np.log(col_sum)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, holds = pdf[pdf["side"] == 0].sort_values("pair_id"), pdf[pdf["side"] == 1].sort_values("pair_id")
        out = []
        if not len(asks) or not len(holds):
            return pd.DataFrame({f.name: [] for f in _CELL_SCHEMA})
        a_ids, c_ids = asks["pair_id"].to_numpy(), holds["pair_id"].to_numpy()
        q, sides = _stack(asks["a"]), [_stack(holds[x]) for x in (("a", "b") if use_negative else ("a",))]
        for dim in dims or [None]:
            key = {"group_key": "" if dim is None else str(dim), "batch_id": pdf["batch_id"].iloc[0]}
            diag, high, kind, pair, row_lse, col_lse = score(prepared(q, dim), [prepared(x, dim) for x in sides], a_ids, c_ids)
            out.append(pd.DataFrame({**key, "pair_id": a_ids, "diag": diag, "row_max": high, "best_kind": kind, "best_pair": pair, "row_lse": row_lse, "col_lse": np.nan}))
            out.append(pd.DataFrame({**key, "pair_id": c_ids, "diag": np.nan, "row_max": np.nan, "best_kind": 0, "best_pair": 0, "row_lse": np.nan, "col_lse": col_lse}))
        return pd.concat(out, ignore_index=True)
    return fn


_CELL_SCHEMA = T.StructType([T.StructField("group_key", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("pair_id", T.LongType()),
                             T.StructField("diag", T.DoubleType()), T.StructField("row_max", T.DoubleType()), T.StructField("best_kind", T.IntegerType()),
                             T.StructField("best_pair", T.LongType()), T.StructField("row_lse", T.DoubleType()), T.StructField("col_lse", T.DoubleType())])


def _merged_lse(name: str):
    """Log-sum-exp of the cells' log-sum-exps: their number is the batch's size over a cell's."""
    parts = F.collect_list(name)
    top = F.array_max(parts)
    return top + F.log(F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def _cell_partitions(spark, cells: int) -> int:
    """Partitions for so many cells: few of them would meet in one partition of as many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * cells, CELL_PARTITIONS))


def _cell_sides(dim: int) -> tuple[int, int]:
    """Queries and other rows of a cell, of vectors of so many doubles."""
    fit = max(1, CELL_BYTES // (8 * max(1, dim)))
    return max(1, min(HELD_QUERIES, fit)), max(1, min(CELL_ROWS, fit))


def _tiled(pairs: DataFrame, counts: DataFrame, cols: list[str], fn, size: int, dim: int) -> DataFrame:
    """Rows of batches of any size: each part of a batch as queries meets each part of it as candidates in a cell; then cells merge.
    Batches of up to ``size`` rows are one cell."""
    from pairforge.operators.joins import join_bounded
    tall, wide = (max(size, x) for x in _cell_sides(dim))
    parts = lambda x: F.ceil(F.col("_pf_n") / x).cast("int")
    cells = int(counts.agg(F.sum(parts(tall).cast("long") * parts(wide))).collect()[0][0])
    many = counts.where(F.col("_pf_n") > size).select("batch_id", parts(tall).alias("_pf_i"), parts(wide).alias("_pf_j"))
    one = F.lit(1)
    rows = join_bounded(pairs.select(*cols), many, ["batch_id"], "left").select(*cols, F.coalesce("_pf_i", one).alias("_pf_i"), F.coalesce("_pf_j", one).alias("_pf_j"))
    code, void = F.xxhash64("pair_id"), F.lit(None)
    i, j = F.pmod(code, "_pf_i").cast("int"), F.pmod(code, "_pf_j").cast("int")
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # a: a query's vector, or a candidate's with its negative's b
    asks = F.transform(up_to("_pf_j"), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(0).alias("side")))
    holds = F.transform(up_to("_pf_i"), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(1).alias("side")))
    sent = rows.select("*", F.explode(F.concat(asks, holds)).alias("_pf_t"))
    asked = F.col("_pf_t.side") == 0
    sent = sent.select("batch_id", "pair_id", F.col("_pf_t.i").alias("i"), F.col("_pf_t.j").alias("j"), F.col("_pf_t.side").alias("side"),
                       F.when(asked, F.col("q")).otherwise(F.col("p")).alias("a"), *([F.when(~asked, F.col("n")).otherwise(void).alias("b")] if "n" in cols else []))
    sent = sent.repartition(_cell_partitions(pairs.sparkSession, cells), "batch_id", "i", "j")
    found = sent.groupBy("batch_id", "i", "j").applyInPandas(fn, _CELL_SCHEMA)
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    found = found.select("group_key", "batch_id", "pair_id", *[real(c).alias(c) for c in ("diag", "row_max", "row_lse", "col_lse")], "best_kind", "best_pair")
    best = F.max(F.when(F.col("row_max").isNotNull(), F.struct("row_max", (-F.col("best_kind")).alias("k"), (-F.col("best_pair")).alias("p"))))
    got = found.groupBy("group_key", "batch_id", "pair_id").agg(F.max("diag").alias("diag"), best.alias("_b"), _merged_lse("row_lse").alias("row_lse"), _merged_lse("col_lse").alias("col_lse"))
    hit = (F.col("_b.k") == 0) & (-F.col("_b.p") == F.col("pair_id"))
    return got.select("group_key", "batch_id", "pair_id", "diag", F.col("_b.row_max").alias("row_max"), (-F.col("_b.p")).alias("argmax_pair"),
                      "row_lse", "col_lse", hit.cast("int").alias("hit"))


def batch_scores(pairs: DataFrame, scale: float = DEFAULT_SCALE, use_negative: bool = False,
                 cosine: bool = False, dims: Sequence[int] | None = None, batch_rows: int | None = None,
                 tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per query row of each batch: diagonal score, best score and its pair, row/column log-sum-exp.

    Input: ``batch_id``, ``pair_id`` (unique in its batch), ``q``, ``p`` (and ``n`` with ``use_negative``). With ``dims`` each batch is
    scored once per dimension on truncated vectors (``group_key`` = the dimension), from one shuffle of the whole vectors.
    Scores = q . p * scale (cosine when asked); of equal best scores the first positive, then the first negative counts.
    ``batch_rows`` is a bound on a batch's rows that the caller knows; without it batches are counted. Beyond ``tile_rows`` rows
    the score matrix is cut into cells, each scored by ``tile_rows`` rows at a time."""
    ship_package(pairs.sparkSession)
    cols = ["batch_id", "pair_id", "q", "p"] + (["n"] if use_negative else [])
    if batch_rows is None or batch_rows > tile_rows:
        counts = pairs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_pf_n"), F.max(F.size("q")).alias("_pf_dim"))
        most, dim = counts.agg(F.max("_pf_n"), F.max("_pf_dim")).collect()[0]
        if (most or 0) > tile_rows:
            return _tiled(pairs, counts, cols, _cell(scale, use_negative, cosine, dims, tile_rows), tile_rows, dim * (2 if use_negative else 1))
    return pairs.select(*cols).groupBy("batch_id").applyInPandas(_in_batch(scale, use_negative, cosine, dims), _ROW_SCHEMA)


def batch_mnrl(pairs: DataFrame, scale: float = DEFAULT_SCALE, batch_rows: int | None = None) -> DataFrame:
    """L1 + L2 per batch: loss = (mean row CE + mean column CE) / 2 with the diagonal as label; top-1 = share
    of rows whose argmax is the diagonal."""
    rows = batch_scores(pairs, scale, batch_rows=batch_rows)
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        (0.5 * (F.avg(F.col("row_lse") - F.col("diag")) + F.avg(F.col("col_lse") - F.col("diag")))).alias("loss"),
        F.avg(F.col("row_lse") - F.col("diag")).alias("row_ce"),
        F.avg("hit").alias("top1"))


def evaluate_pairs(pairs: DataFrame, scale: float = DEFAULT_SCALE, max_samples: int | None = None,
                   batch_rows: int | None = None) -> DataFrame:
    """L3: unweighted mean over batches of the per-batch loss and top-1 (short last batch counts fully).
    ``max_samples`` evaluates only the first so many pairs by (batch_id, pair_id)."""
    if max_samples is not None:
        if max_samples <= 0:
            raise ValueError("max_samples must be positive")
        pairs = pairs.orderBy("batch_id", "pair_id").limit(max_samples)
    per = batch_mnrl(pairs, scale, batch_rows)
    return per.agg(F.avg("loss").alias("eval_loss"), F.avg("top1").alias("eval_top1"),
                   F.count(F.lit(1)).alias("num_batches"))


def mnrl_with_negatives(triples: DataFrame, scale: float = DEFAULT_SCALE, dims: Sequence[int] | None = None,
                        batch_rows: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """L4: per batch (and dimension), one-directional CE of each query against batch positives and batch negatives, cosine."""
    rows = batch_scores(triples, scale, use_negative=True, cosine=True, dims=dims, batch_rows=batch_rows, tile_rows=tile_rows)
    return rows.groupBy("group_key", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("row_lse") - F.col("diag")).alias("loss"), F.avg("hit").alias("top1"))


def matryoshka_loss(triples: DataFrame, dims: Sequence[int] = MATRYOSHKA_DIMS,
                    scale: float = DEFAULT_SCALE, batch_rows: int | None = None) -> DataFrame:
    """Per batch, sum over dims (weight 1 each) of L4 on vectors truncated to the first d dimensions
    (a dim at or above the vector length uses the whole vector). The vectors are shuffled once, not once per dim."""
    per = mnrl_with_negatives(triples, scale, [int(d) for d in dims], batch_rows)
    return per.groupBy("batch_id").agg(F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("num_dims"))


def _packed(rows: DataFrame, ids: Sequence[str], vec: str, size: int) -> DataFrame:
    """Packs of at most ``size`` rows: arrays of the long columns ``ids`` and the unit vectors as bytes; rows stay where they are."""
    def pack(batches):
        for pdf in batches:
            for s in range(0, len(pdf), size):
                part = pdf.iloc[s:s + size]
                yield pd.DataFrame({**{c: [part[c].to_numpy(dtype=np.int64)] for c in ids}, "vecs": [_unit(_stack(part[vec])).tobytes()]})
    return rows.select(*ids, vec).mapInPandas(pack, ", ".join(f"{c} array<long>" for c in ids) + ", vecs binary")


def _cells(asked: DataFrame, ids: Sequence[str], corpus: DataFrame, block: int, broadcast_bytes: int, start, add, end, schema: str) -> DataFrame:
    """What ``end`` makes of every block of ``asked`` (``ids``, vec) after ``add`` has met it with all rows of the corpus (doc_id, vec) of a cell.

    ``held = start(ids, vectors)`` of at most ``block`` queries; ``add(held, doc_ids, doc_vectors)``; ``end(held)``: a pandas frame.
    If the queries are few and their counted size is within ``broadcast_bytes``, they are broadcast and a cell is what a task reads of
    the corpus. Else packs of both are dealt into parts, and a cell is a part of the queries with a part of the corpus."""
    spark = asked.sparkSession
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("vec"))).collect()[0]
    tall, wide = _cell_sides(dim or 1)
    packs = _packed(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "vec"), ["doc_id"], "vec", PACK_ROWS)

    def vectors(data: bytes, rows: int) -> np.ndarray:
        return np.frombuffer(data, np.float64).reshape(rows, -1)

    if n <= tall and n * (dim or 0) * 8 <= broadcast_bytes:
        blocks = _packed(asked, ids, "vec", block).withColumn("_pf_block", F.monotonically_increasing_id())
        both = (packs.withColumnsRenamed({"doc_id": "doc_ids", "vecs": "doc_vecs"}).withColumn("_pf_key", F.lit(0))
                .join(F.broadcast(blocks.withColumn("_pf_key", F.lit(0))), "_pf_key").drop("_pf_key"))

        def part(batches):
            held: dict = {}
            for pdf in batches:
                for name, *own, vecs, docs, doc_vecs in zip(pdf["_pf_block"], *(pdf[c] for c in ids), pdf["vecs"], pdf["doc_ids"], pdf["doc_vecs"]):
                    if name not in held:
                        held[name] = start(own, vectors(vecs, len(own[0])))
                    add(held[name], docs, vectors(doc_vecs, len(docs)))
            for x in held.values():
                yield end(x)
        return both.mapInPandas(part, schema)

    many, names = corpus.count(), T.StructType.fromDDL(schema).names
    rows, cols = -(-n // tall), max(1, -(-many // wide))
    code = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    empty = F.array().cast("array<long>")
    left = (_packed(asked, ids, "vec", min(PACK_ROWS, max(1, tall // 8))).withColumn("i", code("vecs", rows)).withColumn("j", every(cols))
            .select("i", "j", *ids, empty.alias("doc_id"), "vecs"))
    right = (packs.withColumn("j", code("vecs", cols)).withColumn("i", every(rows))
             .select("i", "j", *[empty.alias(c) for c in ids], "doc_id", "vecs"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf["doc_id"].map(len) == 0
        asks, holds = pdf[of], pdf[~of]
        if not len(asks) or not len(holds):
            return pd.DataFrame({c: [] for c in names})
        own = [np.concatenate(asks[c].to_list()) for c in ids]
        q = np.concatenate([vectors(v, len(x)) for v, x in zip(asks["vecs"], asks[ids[0]])])
        docs, d = np.concatenate(holds["doc_id"].to_list()), np.concatenate([vectors(v, len(x)) for v, x in zip(holds["vecs"], holds["doc_id"])])
        order = np.argsort(docs, kind="stable")
        docs, d = docs[order], d[order]
        out = []
        for s in range(0, len(q), block):
            held = start([x[s:s + block] for x in own], q[s:s + block])
            add(held, docs, d)
            out.append(end(held))
        return pd.concat(out, ignore_index=True)
    return (left.unionByName(right).repartition(_cell_partitions(spark, rows * cols), "i", "j").groupBy("i", "j")
            .applyInPandas(cell, schema))


def _dots(q: np.ndarray, d: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores of the pairs (row of ``q``, row of ``d``), a part of them at a time."""
    out = np.empty(len(rows))
    for s in range(0, len(rows), 1 << 16):
        at = slice(s, s + (1 << 16))
        out[at] = np.einsum("ij,ij->i", q[rows[at]], d[cols[at]])
    return np.round(out, SCORE_DECIMALS)


def _slack(dim: int) -> float:
    """More than a product of two unit vectors in single precision, and its rounding, can be off."""
    return (dim + 8) * 2.0 ** -23 + 10.0 ** -SCORE_DECIMALS


def _merge_top(best: tuple | None, n: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple:
    """The running top ``k`` (ids, scores) of ``n`` queries with more (query, id, score): score desc, id asc; not a number comes last."""
    if best is not None:
        rows = np.concatenate([np.repeat(np.arange(n), best[0].shape[1]), rows])
        ids, scores = np.concatenate([best[0].reshape(-1), ids]), np.concatenate([best[1].reshape(-1), scores])
    order = np.lexsort((ids, -scores, rows))
    size = np.bincount(rows, minlength=n)
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    order = order[place < k]
    return ids[order].reshape(n, -1), scores[order].reshape(n, -1)


def retrieval_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, block: int = QUERY_BLOCK,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Top-k corpus docs per query by cosine, ties by doc id. Input: queries (query_id, vec), corpus
    (doc_id, vec). Blocks of queries meet the corpus in cells; a task keeps a running top-k per query of its cell and emits it once;
    a per-query window keeps the final k."""
    ship_package(queries.sparkSession)

    def start(ids, q):
        return {"ids": ids[0], "q": q, "q32": q.astype(np.float32), "best": None}

    def add(held, docs, d):
        q, n, s = held["q"], len(held["q"]), 0
        d32, slack = d.astype(np.float32), _slack(d.shape[1])
        while s < len(docs):
            best = held["best"]
            full = best is not None and best[0].shape[1] >= k
            e = s + (TILE_COLUMNS if full else max(128, k))  # until there are k, all pairs of a tile are merged
            part, ids = d[s:e], docs[s:e]
            if not full:
                scores = np.round(q @ part.T, SCORE_DECIMALS)
                rows, cols = (x.reshape(-1) for x in np.indices(scores.shape))
                scores = scores.reshape(-1)
            else:
                kth, last = best[1][:, -1], best[0][:, -1]
                low = np.where(np.isnan(kth), -np.inf, kth - slack).astype(np.float32)
                hit = np.flatnonzero(~((held["q32"] @ d32[s:e].T) < np.nextafter(low, np.float32(-np.inf))[:, None]))
                rows, cols = np.divmod(hit, len(ids))
                scores = _dots(q, part, rows, cols)
                with np.errstate(invalid="ignore"):  # one that is not a number ranks behind all that are
                    beats = (scores > kth[rows]) | ((scores == kth[rows]) & (ids[cols] < last[rows])) | (np.isnan(kth[rows]) & (~np.isnan(scores) | (ids[cols] < last[rows])))
                rows, cols, scores = rows[beats], cols[beats], scores[beats]
            if len(rows):
                held["best"] = _merge_top(best, n, rows, ids[cols], scores, k)
            s = e

    def end(held):
        ids, scores = held["best"]
        return pd.DataFrame({"query_id": np.repeat(held["ids"], ids.shape[1]), "doc_id": ids.reshape(-1), "score": scores.reshape(-1)})
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vec")
    found = _cells(asked, ["query_id"], corpus, block, broadcast_bytes, start, add, end, "query_id long, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relevant_ranks(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, block: int = QUERY_BLOCK,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, doc_id, rank) of every relevant pair: rank 1-based, cosine desc, ties by doc id: 1 + number of corpus
    docs that beat it; null if the doc isn't in the corpus. Pairs whose query is missing are left out. Blocks of pairs
    meet the corpus in cells; a task counts, and counts are summed, so no score row leaves a task."""
    ship_package(queries.sparkSession)
    pairs = (qrels.select("query_id", "doc_id").distinct().join(queries.select("query_id", "vec"), "query_id")
             .join(corpus.select("doc_id", F.col("vec").alias("dvec")), "doc_id", "left").select("query_id", "doc_id", "vec", "dvec"))

    def own(batches):  # the relevant doc's score, rounded like all others
        for pdf in batches:
            if len(pdf):
                q, d = _unit(_stack(pdf["vec"])), _unit(_stack(pdf["dvec"]))
                s = _dots(q, d, np.arange(len(q)), np.arange(len(q)))
                yield pd.DataFrame({"query_id": pdf["query_id"], "rel_id": pdf["doc_id"], "bits": s.view(np.int64), "vec": pdf["vec"]})

    def start(ids, q):
        asked, rel, bits = ids
        mine, slack = np.asarray(bits, np.int64).view(np.float64), np.float64(_slack(q.shape[1]))
        low, high = (mine + x for x in (-slack, slack))
        return {"ids": asked, "rel": rel, "q": q, "q32": q.astype(np.float32), "mine": mine, "beaten": np.zeros(len(q), np.int64),
                "low": np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None], "high": np.nextafter(high.astype(np.float32), np.float32(np.inf))[:, None]}

    def add(held, docs, d):
        order = np.argsort(docs, kind="stable")
        docs, d = docs[order], d[order]
        rel, mine, d32 = held["rel"], held["mine"], d.astype(np.float32)
        for s in range(0, len(docs), TILE_COLUMNS):
            ids, part = docs[s:s + TILE_COLUMNS], d[s:s + TILE_COLUMNS]
            scores = held["q32"] @ d32[s:s + TILE_COLUMNS].T
            sure = scores > held["high"]
            held["beaten"] += np.count_nonzero(sure, axis=1)
            first, last = np.searchsorted(ids, rel, "left"), np.searchsorted(ids, rel, "right")
            while len(at := np.flatnonzero(first < last)):  # rows of the relevant doc itself don't count
                held["beaten"][at] -= sure[at, first[at]]
                first[at] += 1
            near = scores >= held["low"]
            near &= ~sure
            rows, cols = np.divmod(np.flatnonzero(near), len(ids))
            exact = _dots(held["q"], part, rows, cols)
            better = ((exact > mine[rows]) | ((exact == mine[rows]) & (ids[cols] < rel[rows]))) & (ids[cols] != rel[rows])
            held["beaten"] += np.bincount(rows[better], minlength=len(rel))

    def end(held):
        return pd.DataFrame({"query_id": held["ids"], "doc_id": held["rel"], "beaten": held["beaten"]})
    kind = dict(queries.dtypes)["vec"]
    here = (pairs.where(F.col("dvec").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), "vec", "dvec")
            .mapInPandas(own, f"query_id long, rel_id long, bits long, vec {kind}"))
    counted = _cells(here, ["query_id", "rel_id", "bits"], corpus, block, broadcast_bytes, start, add, end, "query_id long, doc_id long, beaten long")
    absent = pairs.where(F.col("dvec").isNull()).select("query_id", "doc_id", F.lit(None).cast("long").alias("beaten"))
    return absent.unionByName(counted).groupBy("query_id", "doc_id").agg((F.sum("beaten") + 1).alias("rank"))


def ir_metrics(ranks: DataFrame, ks: Sequence[int] = IR_KS) -> DataFrame:
    """L6 from the ranks of each query's relevant docs (null: not in the corpus, so never found): accuracy@k,
    precision@k, recall@k, MRR@10, NDCG@10, MAP@100 (cosine), averaged over queries."""
    per = ranks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("rank")).alias("r"))

    def hits(k):
        return F.size(F.filter("r", lambda x: x <= k))
    cols, aggs = [], []
    for k in ks:
        cols += [F.when(hits(k) > 0, 1.0).otherwise(0.0).alias(f"accuracy_at_{k}"), (hits(k) / F.lit(float(k))).alias(f"precision_at_{k}"),
                 (hits(k) / F.col("n")).alias(f"recall_at_{k}")]
    zero = F.lit(0.0)
    best = F.array_min("r")
    gain = F.aggregate(F.filter("r", lambda x: x <= 10), zero, lambda a, x: a + 1.0 / F.log2(x + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), zero, lambda a, i: a + 1.0 / F.log2(i + 1.0))
    precisions = F.transform(F.filter("r", lambda x: x <= 100), lambda x, i: (i + 1.0) / x)
    cols += [F.when(best <= 10, 1.0 / best).otherwise(0.0).alias("mrr_at_10"), (gain / ideal).alias("ndcg_at_10"),
             (F.aggregate(precisions, zero, lambda a, x: a + x) / F.least(F.col("n"), F.lit(100))).alias("map_at_100")]
    scored = per.select("query_id", *cols)
    aggs = [F.avg(c).alias(c) for c in scored.columns if c != "query_id"]
    return scored.agg(*aggs, F.count(F.lit(1)).alias("num_queries"))


def quality_gate(metrics: DataFrame, min_top1: float | None = GATE_MIN_TOP1,
                 max_loss: float | None = GATE_MAX_LOSS) -> DataFrame:
    """Refuse when top-1 < min (missing = -inf) or loss > max (missing = +inf); unset bound = no check."""
    top1 = F.coalesce(F.col("eval_top1"), F.lit(-math.inf))
    loss = F.coalesce(F.col("eval_loss"), F.lit(math.inf))
    low = top1 < F.lit(min_top1) if min_top1 is not None else F.lit(False)
    high = loss > F.lit(max_loss) if max_loss is not None else F.lit(False)
    reason = (F.when(low, F.concat(F.lit("eval_top1="), F.col("eval_top1").cast("string"),
                                   F.lit(f" is below required {min_top1}")))
               .when(high, F.concat(F.lit("eval_loss="), F.col("eval_loss").cast("string"),
                                    F.lit(f" exceeds allowed {max_loss}"))))
    code = F.when(low, F.lit("low_top1")).when(high, F.lit("high_loss"))
    return metrics.withColumn("passed", ~(low | high)).withColumn("reason_code", code).withColumn("reason", reason)
