"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are merged first: one row per distinct vector with its few smallest ids, which is all that a result
can need of a group of copies. Each of several curves rotates the vectors onto a few random directions, shifts
them, and orders them by their Hilbert key. Spark range-partitions all (curve, key) rows, which gives every row its
rank on each curve. A curve is cut into blocks of a fixed number of ranks, and a query is sent to the blocks that its
window (ranks within ``window`` of its own) meets; a block's task measures true distances within the window
and returns the best few per query. The curves' results are merged and ranked again.

The rotation is random and the shift and scale come from a bounded sample, but every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import staged
from pairforge.session import ensure_checkpoint_dir

CURVES, AXES, BITS = 16, 6, 8
BLOCK = 4096
QUERY_CHUNK = 2048
FIT_ROWS = 10_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows) with ``bits`` bits per axis.

    Gray-code transform from the most significant bit down, all points at once.
    """
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(axes):
            up = (x[i] >> bit & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vec, lambda v: v != 0)


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distinct_vectors(rows: DataFrame, id_col: str, vec_col: str, is_query: Column, keep: int) -> DataFrame:
    """(rep, ids: the ``keep`` smallest, vec, query): a row per distinct usable vector; staged. Each task sends the
    ``keep`` smallest ids of a group of copies only, so a hot vector doesn't meet in one task."""
    v = (rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"),
                     F.coalesce(is_query, F.lit(False)).alias("query"))
         .filter(usable(F.col("vec")) & F.col("id").isNotNull()))
    sizes = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    v = v.filter(F.size("vec") == (sizes[0]["d"] if sizes else 0))
    key = F.xxhash64("vec")  # sorts cheaply; equal hashes of different vectors are told apart by the vector itself
    w = Window.partitionBy("key", "vec").orderBy("id")
    few = v.withColumn("key", key).withColumn("n", F.dense_rank().over(w)).filter(F.col("n") <= keep)  # a repeated id counts once
    # whether any of the copies is a query: one bit per task and group
    asked = v.filter("query").select(key.alias("key"), "vec").distinct().withColumn("query", F.lit(True))
    got = few.groupBy("key", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return staged(got.join(asked, ["key", "vec"], "left").select(F.element_at("ids", 1).alias("rep"), "ids", "vec",
                                                                F.coalesce("query", F.lit(False)).alias("query")), "vectors")


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES,
           window: int | None = None, window_share: float = 0.04, least_window: int = 512, seed: int = 11) -> DataFrame:
    """The ``k`` nearest rows found for each query row, by Euclidean distance in double precision.

    ``window`` is the number of ranks looked at on each side on every curve; by default ``window_share`` of the distinct
    vectors, at least ``least_window``. Vectors that are null, empty, zero, or hold null or non-finite components, rows
    with a null id, and vectors of another length than most take no part. Equal distances go to the smaller id.
    A row isn't its own neighbour; a repeated row (same id and vector) counts once, as does an id that two
    rows share. Fewer than ``k`` other rows give fewer results; an empty table gives none. Only the named
    columns are read.

    Returns (query_id, rank from 1, id_col, score: the distance).
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    vectors = distinct_vectors(rows, id_col, vec_col, is_query, k + 1)
    n, asked = vectors.agg(F.count("*"), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0))).collect()[0]
    width = window if window is not None else max(least_window, math.ceil(window_share * n))
    sample = vectors.select("vec").orderBy(F.xxhash64("rep")).limit(FIT_ROWS).toArrow()
    dim = len(sample.column("vec")[0]) if n else 1
    fit = _matrix(sample.column("vec"), dim)
    rng = np.random.default_rng(seed)
    axes = min(AXES, dim)
    turn = np.stack([np.linalg.qr(rng.normal(size=(dim, axes)))[0] for _ in range(curves)])
    shift = rng.random((curves, axes))
    seen = np.einsum("nd,cda->cna", fit, turn) if n else np.zeros((curves, 1, axes))
    low, high = seen.mean(axis=1) - 3 * seen.std(axis=1), seen.mean(axis=1) + 3 * seen.std(axis=1)

    def keyed(batches):
        for b in batches:
            x = _matrix(b.column("vec"), dim)
            for c in range(curves):
                at = (x @ turn[c] - low[c]) / np.maximum(high[c] - low[c], 1e-300)
                cell = np.clip((0.5 * (np.clip(at, 0, 1) + shift[c])) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_keys(cell, BITS)),
                                                  b.column("rep"), b.column("query"), b.column("vec")], names=["curve", "key", "rep", "query", "vec"])
    parts = max(curves, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    kinds = "curve int, key long, rep long, query boolean, vec array<double>"
    ordered = (vectors.select("rep", "query", "vec").mapInArrow(keyed, kinds)
               .repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
               .withColumn("mono", F.monotonically_increasing_id()))
    ordered = staged(ordered, "curves")
    # ranks: one count per (partition, curve) reaches the driver
    part = F.shiftright("mono", 33)
    counts = ordered.groupBy(part.alias("part"), "curve").agg(F.count("*").alias("n"), F.min("mono").alias("first")).collect()
    start, seen_of = [], dict.fromkeys(range(curves), 0)
    for r in sorted(counts, key=lambda r: (r["curve"], r["part"])):
        start.append((r["part"], r["curve"], seen_of[r["curve"]] - r["first"]))
        seen_of[r["curve"]] += r["n"]
    offsets = F.broadcast(spark.createDataFrame(start, "part long, curve int, off long"))
    ranked = ordered.withColumn("part", part).join(offsets, ["part", "curve"]).withColumn("at", F.col("mono") + F.col("off"))

    chunks = max(1, math.ceil((2 * width + BLOCK) * (asked / max(1, n)) / QUERY_CHUNK))
    data = ranked.select("curve", F.floor(F.col("at") / BLOCK).cast("long").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
                         F.lit(False).alias("asks"), "at", "rep", "vec")
    top_block = F.lit(max(0, (n - 1) // BLOCK))
    sent = ranked.filter("query").select(
        "curve", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - width) / BLOCK)).cast("long"),
                                      F.least(top_block, F.floor((F.col("at") + width) / BLOCK)).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("asks"), "at", "rep", "vec")
    best = k + 1

    def measure(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        at, rep, x = t.column("at").to_numpy(), t.column("rep").to_numpy(), _matrix(t.column("vec"), dim)
        mine = np.flatnonzero(~asks)
        mine = mine[np.argsort(at[mine])]
        where, reps, vecs = at[mine], rep[mine], x[mine]
        out_q, out_c, out_d = [], [], []
        for i in np.flatnonzero(asks):
            s, e = np.searchsorted(where, (at[i] - width, at[i] + width + 1))
            diff = vecs[s:e] - x[i]
            d = np.sqrt(np.einsum("nd,nd->n", diff, diff))
            cut = np.partition(d, best - 1)[best - 1] if len(d) > best else np.inf
            near = np.flatnonzero(d <= cut)
            near = near[np.lexsort((reps[s:e][near], d[near]))][:best]
            out_q.append(np.full(len(near), rep[i]))
            out_c.append(reps[s:e][near])
            out_d.append(d[near])
        cat = lambda a, kind: np.concatenate(a) if a else np.zeros(0, kind)
        return pa.table({"q": pa.array(cat(out_q, np.int64), pa.int64()), "c": pa.array(cat(out_c, np.int64), pa.int64()),
                         "d": pa.array(cat(out_d, np.float64), pa.float64())})
    found = data.unionByName(sent).groupBy("curve", "block", "chunk").applyInArrow(measure, "q long, c long, d double")
    found = found.groupBy("q", "c").agg(F.min("d").alias("d"))
    found = (found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).filter(F.col("n") <= best)
             .join(vectors.select(F.col("rep").alias("c"), "ids"), "c").select("q", "d", F.explode("ids").alias("_id")))
    # of each distinct query vector the k + 1 nearest ids; each of its rows leaves itself out
    found = found.groupBy("q", "_id").agg(F.min("d").alias("d"))
    few = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "_id"))).filter(F.col("n") <= best)
    lists = few.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "_id"))).alias("near"))
    queries = rows.select(F.col(id_col).cast("long").alias("query_id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"), is_query.alias("_ask"))
    queries = queries.filter("_ask").filter(usable(F.col("vec")) & F.col("query_id").isNotNull()).select("query_id", "vec").distinct()
    lists = lists.join(vectors.select(F.col("rep").alias("q"), "vec"), "q")
    out = queries.join(lists, "vec").select("query_id", F.filter("near", lambda x: x["_id"] != F.col("query_id")).alias("near"))
    return out.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit._id").alias(id_col), F.col("hit.d").alias("score"))
