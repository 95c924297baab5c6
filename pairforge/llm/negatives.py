"""Hard-negative mining with an STR-packed R-tree.

Rows are packed by sort-tile-recursive: Spark orders them by label and one coordinate and cuts the order into slabs, orders each
slab by label and another coordinate and cuts it into tiles of a fixed number of rows (both orders are exact ranks over all rows,
so a hot label is many tiles), and each tile sorts and cuts its rows along further coordinates into leaves. The coordinates are
those of largest variance in a bounded sample; every row is indexed.

The box of a node gives an interval for the inner product with a query, coordinate by coordinate: q * low and q * high in either
order. Anchors are packed into blocks along the same order. A block meets a tile only if the interval of their two boxes reaches one of the
block's score windows and isn't strictly below all its k-th scores so far; a first round with the tile of highest
bound gives those scores. Within a tile every anchor keeps a best-first queue of nodes, and drops nodes whose interval misses
all windows or ends strictly below the window's k-th score.

Positives are one window without limits over rows of the same label, negatives one window a positive over the other labels.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import staged
from pairforge.operators.index import global_index
from pairforge.session import ensure_checkpoint_dir

#: Rows of a tile and of a leaf, children of a node, anchors of a block, rows that choose the coordinates to sort by.
TILE, LEAF, FANOUT, BLOCK, FIT_ROWS = 4096, 256, 4, 256, 10_000
#: Inner products below this bound are exact in doubles; beyond it they are computed in Python's integers.
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vec: Column) -> Column:
    """Not null, not empty, and all components finite."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(False))


def str_order(x: np.ndarray, axes: list[int], leaf: int) -> np.ndarray:
    """Order of the rows of ``x`` in which runs of ``leaf`` rows are the leaves of a sort-tile-recursive packing along ``axes``."""
    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        rows = rows[np.argsort(x[rows, axes[depth]], kind="stable")]
        leaves = -(-len(rows) // leaf)
        if leaves == 1 or depth == len(axes) - 1:
            return [rows]
        slab = leaf * math.ceil(leaves ** (1 - 1 / (len(axes) - depth)))
        return [r for s in range(0, len(rows), slab) for r in cut(rows[s:s + slab], depth + 1)]
    return np.concatenate(cut(np.arange(len(x)), 0)) if len(x) else np.zeros(0, np.int64)


class Tree:
    """R-tree over the rows of a tile, in their order: ``low`` and ``high`` of its nodes, root first, and their children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        starts = np.arange(0, len(x), leaf)
        levels = [(np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0))]
        while len(levels[-1][0]) > 1:
            up = np.arange(0, len(levels[-1][0]), fanout)
            levels.append((np.minimum.reduceat(levels[-1][0], up, axis=0), np.maximum.reduceat(levels[-1][1], up, axis=0)))
        levels.reverse()
        self.low, self.high = (np.concatenate([lv[j] for lv in levels]) for j in (0, 1))
        first = np.cumsum([0] + [len(lv[0]) for lv in levels])
        self.children: list[range] = []
        for d, lv in enumerate(levels[:-1]):
            below = len(levels[d + 1][0])
            self.children += [range(first[d + 1] + i * fanout, first[d + 1] + min(below, (i + 1) * fanout)) for i in range(len(lv[0]))]
        self.rows = [slice(s, min(len(x), s + leaf)) for s in starts]
        self.inner = len(self.children)

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible inner product of every query (row of ``q``) with the rows of every node."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


def best_first(tree: Tree, x: np.ndarray, ids: np.ndarray, fits: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray,
               windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (least, most) the ``k`` best (score, id) of the tile: scores of rows that
    ``fits`` admits within the window, highest first, ties to the smaller id. ``low`` and ``high`` are the nodes' intervals."""
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    floor = [least for least, _ in windows]
    queue = [(-high[0], 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        if not any(-bound >= floor[w] and low[node] <= windows[w][1] for w in range(len(windows))):
            continue
        if node < tree.inner:
            for child in tree.children[node]:
                if any(high[child] >= floor[w] and low[child] <= windows[w][1] for w in range(len(windows))):
                    heapq.heappush(queue, (-high[child], child))
            continue
        at = tree.rows[node - tree.inner]
        ok = np.flatnonzero(fits[at])
        score = x[at] @ q
        score, mine = score[ok], ids[at][ok]
        for w, (_, most) in enumerate(windows):
            hit = np.flatnonzero((score >= floor[w]) & (score <= most))
            if len(hit):
                if len(hit) > k:
                    hit = hit[score[hit] >= np.sort(score[hit])[-k]]
                both = found[w] + [(int(score[i]), int(mine[i])) for i in hit]
                both.sort(key=lambda r: (-r[0], r[1]))
                found[w] = both[:k]
                if len(found[w]) == k:
                    floor[w] = max(floor[w], found[w][-1][0])
    return found


def _ints(x: np.ndarray, exact: bool) -> np.ndarray:
    return x if exact else np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)


def _vectors(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack_tiles(ordered: DataFrame, axes: list[int], dim: int) -> DataFrame:
    """A row per tile: ids, labels and vectors in the order of the leaves, the box and the range of labels."""
    def pack(t: pa.Table) -> pa.Table:
        x = _vectors(t.column("vec"), dim)
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        first = np.lexsort((ids, labels))  # leaves hold one label where they can
        x, ids, labels = x[first], ids[first], labels[first]
        ends = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)]
        at = np.concatenate([a + str_order(x[a:b], axes, LEAF) for a, b in zip(ends, ends[1:], strict=False)])
        x, ids, labels = x[at], ids[at], labels[at]
        return pa.table({"tile": t.column("tile").slice(0, 1), "t_first": pa.array([int(labels.min())]), "t_last": pa.array([int(labels.max())]),
                         "t_low": pa.array([x.min(axis=0).tolist()]), "t_high": pa.array([x.max(axis=0).tolist()]),
                         "t_ids": pa.array([ids.tobytes()]), "t_labels": pa.array([labels.tobytes()]), "t_x": pa.array([x.tobytes()])})
    return staged(ordered.select("tile", "id", "label", "vec").groupBy("tile").applyInArrow(
        pack, "tile long, t_first long, t_last long, t_low array<double>, t_high array<double>, t_ids binary, t_labels binary, t_x binary"), "tiles")


def _pack_anchors(anchors: DataFrame, dim: int) -> DataFrame:
    """A row per block of anchors that have windows: ids, labels, vectors, windows, the box, the ranges of labels and windows."""
    def pack(t: pa.Table) -> pa.Table:
        x = _vectors(t.column("vec"), dim)
        labels = t.column("label").to_numpy()
        lows, highs = t.column("lows").to_pylist(), t.column("highs").to_pylist()
        return pa.table({"block": t.column("block").slice(0, 1), "a_first": pa.array([int(labels.min())]), "a_last": pa.array([int(labels.max())]),
                         "a_low": pa.array([x.min(axis=0).tolist()]), "a_high": pa.array([x.max(axis=0).tolist()]),
                         "a_least": pa.array([min(v for w in lows for v in w)]), "a_most": pa.array([max(v for w in highs for v in w)]),
                         "a_ids": pa.array([t.column("id").to_pylist()]), "a_labels": pa.array([labels.tolist()]), "a_x": pa.array([x.tobytes()]),
                         "a_lows": pa.array([lows]), "a_highs": pa.array([highs])})
    return staged(anchors.filter(F.size("lows") > 0).select("block", "id", "label", "vec", "lows", "highs").groupBy("block").applyInArrow(
        pack, "block long, a_first long, a_last long, a_low array<double>, a_high array<double>, a_least long, a_most long, a_ids array<long>, "
              "a_labels array<long>, a_x binary, a_lows array<array<long>>, a_highs array<array<long>>"), "anchors")


def _end(pick) -> Column:
    """Least or largest sum of products over an anchors' box and a tile's, in doubles."""
    products = F.zip_with(F.arrays_zip("a_low", "a_high"), F.arrays_zip("t_low", "t_high"), lambda a, t: pick(
        a["a_low"] * t["t_low"], a["a_low"] * t["t_high"], a["a_high"] * t["t_low"], a["a_high"] * t["t_high"]))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def _pairs(blocks: DataFrame, tiles: DataFrame, n_tiles: int, same: bool, exact: bool) -> DataFrame:
    """(block, tile, bound) of the blocks and tiles whose boxes don't exclude a result: boxes only, no rows."""
    left = blocks.select("block", "a_first", "a_last", "a_low", "a_high", "a_least", "a_most", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_tiles - 1)).cast("long"))).alias("tile"))
    both = left.join(tiles.select("tile", "t_first", "t_last", "t_low", "t_high"), "tile")
    if same:
        both = both.filter((F.col("a_first") <= F.col("t_last")) & (F.col("t_first") <= F.col("a_last")))
    else:
        both = both.filter(~((F.col("a_first") == F.col("a_last")) & (F.col("t_first") == F.col("t_last")) & (F.col("a_first") == F.col("t_first"))))
    both = both.withColumn("bound", _end(F.greatest)).withColumn("under", _end(F.least))
    if exact:
        both = both.filter((F.col("bound") >= F.col("a_least")) & (F.col("under") <= F.col("a_most")))
    return both.select("block", "tile", "bound")


def _search(pairs: DataFrame, blocks: DataFrame, tiles: DataFrame, same: bool, k: int, dim: int, exact: bool) -> DataFrame:
    """(id, w, other, score): the best ``k`` of each tile, anchor and window."""
    work = (pairs.select("block", "tile").join(blocks.select("block", "a_ids", "a_labels", "a_x", "a_lows", "a_highs"), "block")
            .join(tiles.select("tile", "t_ids", "t_labels", "t_x"), "tile").drop("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree, x, ids, labels = None, None, None, None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(name)[r] for name in b.schema.names}
                if row["tile"].as_py() != last:
                    last = row["tile"].as_py()
                    ids, labels = (np.frombuffer(row[c].as_py(), np.int64) for c in ("t_ids", "t_labels"))
                    x = _ints(np.frombuffer(row["t_x"].as_py(), np.float64).reshape(-1, dim), exact)
                    tree = Tree(x)
                anchors, kinds = row["a_ids"].as_py(), row["a_labels"].as_py()
                q = _ints(np.frombuffer(row["a_x"].as_py(), np.float64).reshape(-1, dim), exact)
                low, high = tree.intervals(q)
                out: list[tuple[int, int, int, int]] = []
                for i, (lows, highs) in enumerate(zip(row["a_lows"].as_py(), row["a_highs"].as_py(), strict=True)):
                    fits = (labels == kinds[i]) & (ids != anchors[i]) if same else labels != kinds[i]
                    if fits.any():
                        for w, hits in enumerate(best_first(tree, x, ids, fits, q[i], low[i], high[i], list(zip(lows, highs, strict=True)), k)):
                            out += [(anchors[i], w, other, min(MOST, max(LEAST, score))) for score, other in hits]
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "w", "other", "score"), o, strict=True)) for o in out],
                                                 schema=pa.schema([("id", pa.int64()), ("w", pa.int32()), ("other", pa.int64()), ("score", pa.int64())]))
    return work.mapInArrow(run, "id long, w int, other long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id", "w").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(anchors: DataFrame, tiles: DataFrame, n_tiles: int, same: bool, k: int, dim: int, exact: bool) -> DataFrame:
    """(id, w, other, score, rank): the best ``k`` rows of each anchor and window, over all tiles; staged."""
    blocks = _pack_anchors(anchors, dim)
    pairs = _pairs(blocks, tiles, n_tiles, same, exact)
    order = Window.partitionBy("block").orderBy(F.desc("bound"), "tile")
    seeds = staged(pairs.withColumn("n", F.row_number().over(order)).filter("n = 1").select("block", "tile"), "seeds")
    first = staged(_top(_search(seeds, blocks, tiles, same, k, dim, exact), k), "first")
    reached = (first.filter(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth")))
    held = anchors.join(reached, "id", "left").withColumn("lows", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(
        F.transform("lows", lambda v, i: F.greatest(v, F.coalesce(F.element_at("kth", i), F.lit(LEAST))))))
    blocks = _pack_anchors(held, dim)
    rest = _pairs(blocks, tiles, n_tiles, same, exact).join(seeds, ["block", "tile"], "left_anti")
    found = first.drop("rank").unionByName(_search(rest, blocks, tiles, same, k, dim, exact))
    return staged(_top(found, k), "best")


def mine(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0,
         positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of every anchor and each of its first
    ``positives`` other rows of the same label, the first ``negatives`` rows of other labels whose score is between ``least_percent``
    and ``most_percent`` of the positive's. A score is the integer inner product of components floor(scale * x); higher ones come
    first, ties by the smaller id.

    Rows with a null id or label, a null or empty vector, or null or non-finite components take no part, nor do vectors of
    another length than most. Zero vectors do. Rows that share an id count once: the smallest (label, vector), an anchor if
    any of them is. Labels are integers. Scaled components and scores beyond the range of a long are cut to it.
    Anchors without positives, and positives without rows in their window, give no rows; an empty table gives none.
    Only the named columns are read.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    scaled = F.transform(vec_col, lambda x: F.greatest(F.lit(float(LEAST)), F.least(F.lit(float(MOST - 1023)), F.floor(F.lit(scale) * x.cast("double")).cast("double") + F.lit(0.0))))
    clean = rows.filter(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("vec"),
                                                       F.coalesce(is_anchor, F.lit(False)).alias("asks")).filter("id is not null and label is not null")
    sizes = clean.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1
    held = (clean.filter(F.size("vec") == dim).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"), F.max("asks").alias("asks"))
            .select("id", "r.label", "r.vec", "asks"))
    held = staged(held, "vectors")
    n, top = held.agg(F.count("*"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).collect()[0]
    exact = (top or 0.0) ** 2 * dim < EXACT
    fit = held.select("vec").orderBy(F.xxhash64("id")).limit(FIT_ROWS).toArrow()
    spread = _vectors(fit.column("vec"), dim).var(axis=0) if n else np.zeros(dim)
    axes = [int(a) for a in np.argsort(-spread, kind="stable")[:4]]
    n_tiles = math.ceil(n / TILE)
    slab = TILE * max(1, math.ceil(math.sqrt(n_tiles)))
    along = [F.element_at("vec", axes[j % len(axes)] + 1) for j in (0, 1)]
    slabs = global_index(held, ["label", along[0], "id"], "at").df.withColumn("slab", F.floor(F.col("at") / slab)).drop("at")
    ordered = global_index(slabs, ["slab", "label", along[1], "id"], "at").df.withColumn("tile", F.floor(F.col("at") / TILE))
    tiles = _pack_tiles(ordered, axes[2:] or axes, dim)
    anchors = (global_index(ordered.filter("asks").select("at", "id", "label", "vec"), ["label", "at"], "nth").df
               .withColumn("block", F.floor(F.col("nth") / BLOCK)).select("block", "id", "label", "vec"))
    open_end = anchors.withColumn("lows", F.array(F.lit(LEAST))).withColumn("highs", F.array(F.lit(MOST)))
    near = _best(open_end, tiles, n_tiles, True, positives, dim, exact).select(
        "id", (F.col("rank") - 1).alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    window = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w", "positive_score"))).alias("s"))

    def end(percent: int, whole) -> Column:
        return F.transform("s", lambda s: whole(s["positive_score"].cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")).cast("long"))
    hard = _best(anchors.join(window, "id").select("block", "id", "label", "vec", end(least_percent, F.ceil).alias("lows"), end(most_percent, F.floor).alias("highs")),
                 tiles, n_tiles, False, negatives, dim, exact)
    return hard.join(near, ["id", "w"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"),
                                               "positive_score", F.col("score").alias("negative_score"))
