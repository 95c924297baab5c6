"""Sources -> ring negatives per source -> ordered concat per group -> round-robin interleave -> split.

One P1 pass indexes every source at once (group key = (group, source)); everything else is arithmetic on
the per-source size table (one row per source passed in) plus one equi-join on the unique global index for
the ring negatives. The result is a manifest table:

``idx, group_name, source, k, query_type, query_value, positive_type, positive_value, negative_type,
negative_value, split``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.index import group_index_stats
from pairforge.operators.order import interleave_index, ring_join, split_point
from pairforge.sources.tables import RECORD_COLUMNS

MANIFEST_COLUMNS = ["idx", "group_name", "source", "k", "query_type", "query_value", "positive_type",
                    "positive_value", "negative_type", "negative_value", "split"]


class Manifest(NamedTuple):
    df: DataFrame
    num_rows: int
    num_train: int
    group_sizes: dict


def assemble(groups: Sequence[tuple[str, Sequence[DataFrame]]], val_fraction: float | None = 0.1,
             ring: bool = True, values: bool | str = True) -> Manifest:
    """Build the interleaved manifest from ``[(group_name, [source_df, ...]), ...]`` in order.

    Each source is a record table (``RECORD_COLUMNS``) ordered by ``k``; sources of a group are concatenated
    in the given order (e.g. captions then chat for images); ring negatives are per source. Instead of a DataFrame a
    source may be ``(DataFrame, names)``: one table of many sources, told apart by its ``source`` column and
    concatenated in the order of ``names``; it is scanned once, whatever their number.

    ``values=False`` builds the positional skeleton only (keys, types, negatives' presence, split): the value
    columns are NULL and never enter the P1 checkpoint, which Catalyst cannot prune through. Plans that need
    only positions and modalities (shards, ranks, batch plans, summaries) use it. ``values="media"`` keeps the paths of media
    items and leaves texts NULL, for plans that look at files.
    """
    keep = RECORD_COLUMNS if values else [c for c in RECORD_COLUMNS if not c.endswith("_value")]
    parts = []
    numbers = []  # sources per group
    for g, (_, sources) in enumerate(groups):
        s = 0
        for src in sources:
            df, names = src if isinstance(src, tuple) else (src, None)
            at = F.lit(s) if names is None else (F.array_position(F.lit(list(names)).cast("array<string>"), F.col("source")).cast("int") + F.lit(s - 1))
            if values == "media":
                df = df.withColumns({f"{r}_value": F.when(F.col(f"{r}_type") != "text", F.col(f"{r}_value")) for r in ("query", "positive")})
            parts.append(df.select(*keep).withColumn("_g", F.lit(g)).withColumn("_s", at))
            s += 1 if names is None else len(names)
        numbers.append(s)
    if not parts:
        raise ValueError("no sources")
    union = reduce(lambda a, b: a.unionByName(b), parts)
    ix, stats = group_index_stats(union, ["_g", "_s"], ["k"], pos_col="_pos", size_col="_n",
                                  gidx_col="_gidx", start_col="_start")
    src_sizes = {(int(r["_g"]), int(r["_s"])): int(r["size"]) for r in stats.collect()}
    if ring:
        ix = ring_join(ix, "_gidx", "_start", "_pos", "_n", "positive_value" if values else None)
    else:
        ix = ix.withColumn("negative_type", F.lit(None).cast("string")).withColumn(
            "negative_value", F.lit(None).cast("string"))
    # ordered concatenation inside each group: offset of the source + position in the source
    offset = F.lit(0).cast("bigint")
    group_sizes = []
    for g in range(len(groups)):
        run = 0
        for s in range(numbers[g]):
            if run:
                offset = F.when((F.col("_g") == g) & (F.col("_s") == s), F.lit(run)).otherwise(offset)
            run += src_sizes.get((g, s), 0)
        group_sizes.append(run)
    total = sum(group_sizes)
    if total == 0:
        raise ValueError("interleave: all groups are empty")
    gpos = F.col("_pos") + offset
    names = F.lit(None).cast("string")
    for g, (name, _) in enumerate(groups):
        names = F.when(F.col("_g") == g, F.lit(name)).otherwise(names)
    out = ix.withColumn("idx", interleave_index(gpos, F.col("_g"), group_sizes)).withColumn("group_name", names)
    for c in ("query_value", "positive_value", "negative_value"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    k = total if val_fraction is None else split_point(total, val_fraction)
    out = out.withColumn("split", F.when(F.col("idx") < k, F.lit("train")).otherwise(F.lit("val")))
    return Manifest(out.select(*MANIFEST_COLUMNS), total, k,
                    {name: group_sizes[g] for g, (name, _) in enumerate(groups)})


def dataset_summary(manifest: DataFrame) -> DataFrame:
    """Counts by split, by group (modality) and by (group, source), one GROUPING SETS aggregate.

    Output: ``dimension`` ('split' | 'group' | 'group_source'), ``split``, ``group_name``, ``source``, ``n``.
    """
    g = manifest.groupingSets([["split"], ["group_name"], ["group_name", "source"]], "split", "group_name", "source")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.grouping("split").alias("_gs"), F.grouping("source").alias("_gr"))
    dim = (F.when(F.col("_gs") == 0, F.lit("split"))
             .when(F.col("_gr") == 0, F.lit("group_source")).otherwise(F.lit("group")))
    return out.select(dim.alias("dimension"), "split", "group_name", "source", "n")
