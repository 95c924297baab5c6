"""Positional operators: ring negatives (C1), concatenation (B7), round-robin interleave (C2), split.

All positions come from the P1 index; everything after it is arithmetic on small per-source size tables, a look at the next row
where the index left it, or an equi-join on a unique long key, so no operator here sorts the data twice or shuffles on a skewable key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.operators.index import global_index, group_index, group_index_stats
from pairforge.operators.joins import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS
from pairforge.session import ship_package


def _shift(cols: Sequence[str], names: Sequence[str]):
    """For ``mapInArrow``: each row with ``cols`` of the next row of its partition as ``names``, and whether it is the last row."""
    import pyarrow as pa

    def out(b: pa.RecordBatch, following: pa.RecordBatch | None) -> pa.RecordBatch:
        last = pa.array([False] * (b.num_rows - 1) + [following is None])
        ahead = [pa.concat_arrays([b.column(c).slice(1), following.column(c).slice(0, 1) if following else pa.nulls(1, b.column(c).type)])
                 for c in cols]
        return pa.RecordBatch.from_arrays([*b.columns, *ahead, last], names=[*b.schema.names, *names, "_pf_last"])

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows:
                if held is not None:
                    yield out(held, b)
                held = b
        if held is not None:
            yield out(held, None)
    return run


def ring_join(df: DataFrame, gidx_col: str, start_col: str, pos_col: str, size_col: str,
              value_col: str | None = "positive_value", type_col: str = "positive_type",
              out_value: str = "negative_value", out_type: str = "negative_type") -> DataFrame:
    """D3: row i of a group takes the value of row (i+1) mod n; none when n <= 1.

    Rows that still lie in the order of the index (as P1 leaves them; checked) take the value of the next row where they are. Only
    the first rows of groups and of partitions are looked up by their global index: a table of one row a group and
    partition, broadcast if its rows and bytes are within the bounds of a broadcast. Else donor row j feeds row (j-1) mod n of
    its group by a join on the unique global index, which shuffles evenly whatever the group sizes are.
    """
    n, pos, gidx = F.col(size_col), F.col(pos_col), F.col(gidx_col)
    cols = {c: o for c, o in ((type_col, out_type), (value_col, out_value)) if c}
    donors = (df.where(n > 1)
                .select((F.col(start_col) + (pos - 1 + n) % n).alias("_pf_target"), *[F.col(c).alias(o) for c, o in cols.items()]))
    slow = df.join(donors, df[gidx_col] == donors["_pf_target"], "left").drop("_pf_target")
    if not cols:
        return slow
    gap = F.monotonically_increasing_id() - gidx  # the same for all rows of a partition that holds a run of the index in order
    runs = (df.select(gidx, F.spark_partition_id().alias("p"), gap.alias("gap")).groupBy("p")
              .agg(F.min(gidx_col).alias("first"), F.min("gap").alias("low"), F.max("gap").alias("high")).limit(MAX_BROADCAST_ROWS + 1).collect())
    if len(runs) > MAX_BROADCAST_ROWS or any(r["low"] != r["high"] for r in runs):
        return slow
    firsts = [r["first"] for r in runs]
    edges = df.where((n > 1) & ((pos == 0) | gidx.isin(firsts))).select(gidx.alias("_pf_target"), *[F.col(c).alias(f"_pf_e_{o}") for c, o in cols.items()])
    bytes_of = sum((F.coalesce(F.octet_length(F.to_json(F.struct(f"_pf_e_{o}"))), F.lit(0)) for o in cols.values()), F.lit(16))
    held = edges.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bytes_of), F.lit(0)).alias("bytes")).first()
    if held["rows"] > MAX_BROADCAST_ROWS or held["bytes"] > MAX_BROADCAST_BYTES:
        return slow
    ahead = [f"_pf_a_{o}" for o in cols.values()]
    schema = T.StructType([*df.schema.fields, *[T.StructField(a, df.schema[c].dataType) for a, c in zip(ahead, cols, strict=True)],
                           T.StructField("_pf_last", T.BooleanType())])
    ship_package(df.sparkSession)
    shifted = df.mapInArrow(_shift(list(cols), ahead), schema)
    here = (pos < n - 1) & ~F.col("_pf_last")
    shifted = shifted.withColumn("_pf_at", F.when((n > 1) & ~here, F.col(start_col) + (pos + 1) % n))
    out = shifted.join(F.broadcast(edges), F.col("_pf_at") == F.col("_pf_target"), "left")
    lost = F.when(F.col("_pf_at").isNotNull() & F.col("_pf_target").isNull(), F.raise_error(F.lit("ring: rows out of order")))
    for a, (c, o) in zip(ahead, cols.items(), strict=True):
        out = out.withColumn(o, F.when(here, F.col(a)).otherwise(F.coalesce(F.col(f"_pf_e_{o}"), lost.cast(df.schema[c].dataType))))
    return out.drop("_pf_at", "_pf_target", "_pf_last", *ahead, *[f"_pf_e_{o}" for o in cols.values()])


def ring_negatives(df: DataFrame, group_cols: Sequence[str], order: Sequence[str | Column],
                   value_col: str = "positive_value", type_col: str | None = "positive_type",
                   out_value: str = "negative_value", out_type: str = "negative_type") -> DataFrame:
    """Ring negatives within each group (a source), after any filter and limit."""
    ix = group_index(df, group_cols, order, pos_col="_pf_pos", size_col="_pf_n", gidx_col="_pf_gidx",
                     start_col="_pf_start")
    out = ring_join(ix, "_pf_gidx", "_pf_start", "_pf_pos", "_pf_n", value_col, type_col, out_value, out_type)
    return out.drop("_pf_pos", "_pf_n", "_pf_gidx", "_pf_start")


def interleave_index(pos: Column, group: Column, sizes: Sequence[int]) -> Column:
    """Round-robin position of the row at ``pos`` of group ``group`` (0-based) given all group sizes.

    idx = sum_g' min(pos, n_g') + #{g' < g : n_g' > pos}; exhausted groups drop out naturally.
    """
    base = None
    for n in sizes:
        term = F.least(pos, F.lit(n).cast("bigint"))
        base = term if base is None else base + term
    extra = F.lit(0).cast("bigint")
    branches = None
    for g in range(len(sizes)):
        earlier = F.lit(0).cast("bigint")
        for h in range(g):
            earlier = earlier + F.when(pos < sizes[h], 1).otherwise(0)
        branches = (F.when(group == g, earlier) if branches is None else branches.when(group == g, earlier))
    if branches is not None:
        extra = branches
    return base + extra


def interleave(groups: Sequence[DataFrame], order: Sequence[str | Column], idx_col: str = "idx",
               group_col: str = "group_ord") -> DataFrame:
    """One row from each group in turn, in group order; exhausted groups drop out.

    Each group is ordered by ``order``; all groups empty is an error.
    """
    if not groups:
        raise ValueError("interleave needs at least one group")
    tagged = [g.withColumn(group_col, F.lit(i)) for i, g in enumerate(groups)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    ix, stats = group_index_stats(union, [group_col], order, pos_col="_pf_pos", size_col=None)
    sizes = group_sizes(stats, group_col, len(groups))
    if sum(sizes) == 0:
        raise ValueError("interleave: all groups are empty")
    return ix.withColumn(idx_col, interleave_index(F.col("_pf_pos"), F.col(group_col), sizes)).drop("_pf_pos")


def group_sizes(stats: DataFrame, ord_col: str, count: int) -> list[int]:
    """Collect per-group sizes; the stats table has one row per input group (bounded by the caller)."""
    sizes = [0] * count
    for r in stats.select(ord_col, "size").collect():
        sizes[int(r[0])] = int(r[1])
    return sizes


def concat_sources(sources: Sequence[DataFrame], order: Sequence[str | Column], pos_col: str = "pos",
                   source_col: str = "source_ord") -> DataFrame:
    """Ordered concatenation; ``pos_col`` is the position in the concatenated list."""
    tagged = [s.withColumn(source_col, F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    return global_index(union, [source_col, *order], pos_col).df


def split_point(n: int, val_fraction: float) -> int:
    """C3 boundary: k = max(1, int(n * (1.0 - f))) in IEEE double, truncated."""
    return max(1, int(n * (1.0 - float(val_fraction))))


def positional_split(df: DataFrame, n: int, val_fraction: float, idx_col: str = "idx",
                     split_col: str = "split") -> DataFrame:
    """First k rows train, the rest val (val may be empty)."""
    k = split_point(n, val_fraction)
    return df.withColumn(split_col, F.when(F.col(idx_col) < k, F.lit("train")).otherwise(F.lit("val")))


def prefer_source(candidates: Sequence[DataFrame], source_col: str = "source", skip: bool = False) -> DataFrame:
    """Source precedence. With ``skip`` nothing is built: only the first candidate (the own cache) counts, and a
    source that it lacks is empty. ``candidates`` in priority order (own cache, legacy cache, build...); for each
    source keep the rows of the highest-priority candidate that has it. The per-source minimum is a
    partial/final aggregate (one row per source) joined back."""
    tagged = [c.withColumn("priority", F.lit(i)) for i, c in enumerate(candidates[:1] if skip else candidates)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    from pairforge.operators.joins import join_bounded
    best = union.groupBy(source_col).agg(F.min("priority").alias("_pf_best"))
    return join_bounded(union, best, [source_col]).where(F.col("priority") == F.col("_pf_best")).drop("_pf_best")
