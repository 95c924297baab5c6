"""Dense, deterministic 0-based global position of each row in a total order.

Order is data in this domain (ring negatives, interleave, split, shard number, rank slice, batch pattern),
so every positional operator sits on this primitive. A global ``row_number()`` without a partition runs in
one task; instead:

1. range-partition on the order key (Spark samples the full composite key, so a hot first column is split
   by the next one) and sort within partitions;
2. stamp ``monotonically_increasing_id()`` (partition << 33 | position) and write a reliable
   ``checkpoint()`` into ``spark.checkpoint.dir`` - this freezes partition membership and in-partition
   order, and survives executor loss;
3. count rows per partition (one small row per partition reaches the driver), turn the counts into
   offsets, and add the offset of the row's partition as an array literal lookup.

The order key must be unique (callers append a tie-break); the result is then independent of how the
range boundaries fell.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.operators.joins import fits
from pairforge.session import ensure_checkpoint_dir

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1
_MONO = "_pf_mono"
# Largest per-group table (rows) joined back by broadcast, if its bytes fit too.
BROADCAST_GROUPS = 200_000


class Indexed(NamedTuple):
    df: DataFrame
    total: int


def per_partition(values: Sequence[int], part: Column) -> Column:
    """The value of the partition ``part`` from 0 (null beyond the list). All values are one text that the optimizer splits into one
    literal array, so neither the plan nor the driver's work grows by an expression a partition."""
    if not values:
        return F.lit(None).cast("bigint")
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), part)


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _range(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    """Range-partition on ``keys``. With an explicit count (argument or ``pairforge.index.partitions``) exactly that
    many ranges; otherwise ``spark.sql.shuffle.partitions`` ranges that AQE may coalesce at runtime (it merges
    adjacent ranges, so order stays contiguous)."""
    spark = df.sparkSession
    n = num_partitions
    if n is None:
        conf = spark.conf.get("pairforge.index.partitions", None)
        n = int(conf) if conf else None
    return df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)


def global_index(df: DataFrame, order: Sequence[str | Column], idx_col: str = "idx",
                 num_partitions: int | None = None) -> Indexed:
    """Add ``idx_col`` = 0-based rank of the row in ``order``; also return the row count."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = _cols(order)
    staged = (_range(df, keys, num_partitions)
                .sortWithinPartitions(*keys)
                .withColumn(_MONO, F.monotonically_increasing_id())
                .checkpoint(eager=True))
    part = F.shiftright(F.col(_MONO), _POS_BITS).cast("int")
    counts = sorted(tuple(r) for r in staged.groupBy(part.alias("p")).count().collect())
    offsets = [0] * ((counts[-1][0] + 1) if counts else 1)
    running = 0
    for p, c in counts:
        offsets[p] = running
        running += c
    out = staged.withColumn(idx_col, per_partition(offsets, part) + F.col(_MONO).bitwiseAND(F.lit(_POS_MASK))).drop(_MONO)
    return Indexed(out, running)


def with_global_index(df: DataFrame, order: Sequence[str | Column], idx_col: str = "idx") -> DataFrame:
    return global_index(df, order, idx_col).df


def group_index(df: DataFrame, group_cols: Sequence[str], order: Sequence[str | Column], pos_col: str = "pos",
                size_col: str | None = "group_size", gidx_col: str | None = None,
                start_col: str | None = None) -> DataFrame:
    """0-based position of each row inside its group (``group_cols``, NULL is a group) in ``order``."""
    return group_index_stats(df, group_cols, order, pos_col, size_col, gidx_col, start_col)[0]


def group_index_stats(df: DataFrame, group_cols: Sequence[str], order: Sequence[str | Column], pos_col: str = "pos",
                      size_col: str | None = "group_size", gidx_col: str | None = None,
                      start_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``group_index``, also returning the per-group table (group cols, ``start``, ``size``).

    One global index over (group, order) plus a per-group (start, size) aggregate (partial/final, skew-safe)
    joined back. Without group columns the start is 0 and the size is the total: no join at all.
    """
    gidx = gidx_col or "_pf_gidx"
    spark = df.sparkSession
    ix = global_index(df, [*group_cols, *order], gidx)
    g = ix.df
    if not group_cols:
        out = g.withColumn(pos_col, F.col(gidx))
        if size_col:
            out = out.withColumn(size_col, F.lit(ix.total).cast("bigint"))
        if start_col:
            out = out.withColumn(start_col, F.lit(0).cast("bigint"))
        public = spark.createDataFrame([(0, ix.total)], "start long, size long")
        return (out if gidx_col else out.drop(gidx)), public
    stats = g.groupBy(*group_cols).agg(F.min(gidx).alias("_pf_st0"), F.count(F.lit(1)).alias("_pf_sz0"))
    # One row per group. When the row count is under the bound, the collected rows become a local table that is
    # broadcast (no shuffle of the data by a possibly skewed group key, no second pass over the stats);
    # otherwise a regular join that AQE may split on skew.
    rows = stats.limit(BROADCAST_GROUPS + 1).collect()
    small = len(rows) <= BROADCAST_GROUPS and fits(rows)
    if small:
        stats = spark.createDataFrame(rows, stats.schema)
    public = stats.select(*group_cols, F.col("_pf_st0").alias("start"), F.col("_pf_sz0").alias("size"))
    stats = stats.select(*[F.col(c).alias(f"_pf_g_{c}") for c in group_cols], "_pf_st0", "_pf_sz0")
    cond = [g[c].eqNullSafe(stats[f"_pf_g_{c}"]) for c in group_cols]
    out = g.join(F.broadcast(stats) if small else stats, cond, "inner").drop(*[f"_pf_g_{c}" for c in group_cols])
    out = out.withColumn(pos_col, F.col(gidx) - F.col("_pf_st0"))
    if size_col:
        out = out.withColumn(size_col, F.col("_pf_sz0"))
    if start_col:
        out = out.withColumn(start_col, F.col("_pf_st0"))
    drop = ["_pf_st0", "_pf_sz0"] + ([] if gidx_col else [gidx])
    return out.drop(*drop), public


def take_first(df: DataFrame, n: int | None, order: Sequence[str | Column], zero_means_all: bool = True) -> DataFrame:
    """The first ``n`` rows in ``order``, a limit over a total order.

    Source limits use ``n <= 0`` = all; ``max_records`` uses ``None`` = all and rejects 0.
    """
    if n is None or (zero_means_all and n <= 0):
        return df
    if n <= 0:
        raise ValueError("max_records must be positive")
    return df.orderBy(*_cols(order)).limit(n)  # a top-k per partition, merged; large n become a sort


def running_sum(df: DataFrame, order: Sequence[str | Column], value_col: str, out_col: str = "running",
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value_col`` (null counts as 0) in ``order`` without a single-partition window.

    Same staging as P1 (range partition, sort, checkpoint); each partition's total is collected (one number
    per partition), and inside a partition the sum is a window over that partition."""
    from pyspark.sql import Window

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = _cols(order)
    staged = (_range(df, keys, num_partitions).sortWithinPartitions(*keys)
                .withColumn(_MONO, F.monotonically_increasing_id()).checkpoint(eager=True))
    part = F.shiftright(F.col(_MONO), _POS_BITS).cast("int")
    kind = staged.schema[value_col].dataType
    value = F.coalesce(F.col(value_col), F.lit(0))
    sums = sorted(tuple(r) for r in staged.groupBy(part.alias("p")).agg(F.sum(value)).collect())
    offsets = [0] * ((sums[-1][0] + 1) if sums else 1)
    run = 0
    for p, v in sums:
        offsets[p] = run
        run += v or 0
    here = F.sum(value).over(Window.partitionBy(part).orderBy(_MONO))
    if isinstance(kind, T.IntegralType):
        before = per_partition(offsets, part)
    else:  # decimals and floats, as text
        before = F.get(F.split(F.lit(",".join(map(str, offsets))), ",").cast(T.ArrayType(kind)), part)
    return staged.withColumn(out_col, (here + before).cast(kind)).drop(_MONO)
