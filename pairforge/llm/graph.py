"""Connected components of an edge table, by contraction.

Vertices are longs. Every round each vertex hooks to its least neighbour, if that is less than itself, and then to where that one
hooks; the edges are relabelled, and those within one vertex and repeated ones go. So the edges shrink from round to round, and what is
left of a component at the end is its least vertex. Tables are written to the shared folder, so lineage stays short. Neighbours are
reduced by ``min``, which Spark combines before the shuffle; where vertices are looked up, those with most rows are broadcast,
so neither a hub's edges nor a large component meet in one task.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import hot_keys, join_hot, staged


def _simple(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(v, root) of every vertex of ``edges`` (a, b): ``root`` is the least vertex of its component.

    Rounds go on until no edge is left; with a limit of ``rounds``, edges left raise. Null ends are ignored;
    loops and repeated edges do no harm; an empty table gives none.
    """
    e = staged(edges.select("a", "b").dropna().distinct(), "edges")
    labels = staged(e.select(F.col("a").alias("v")).union(e.select("b")).distinct().withColumn("root", F.col("v")), "labels")
    now = staged(e.select(*_simple("a", "b")).filter("a != b").distinct(), "edges")
    for done in itertools.count():
        if now.isEmpty():
            return labels
        if done == rounds:
            raise RuntimeError(f"components unfinished after {rounds} rounds")
        both = now.union(now.select("b", "a"))
        hooks = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "v"), "hooks")
        tops = hooks.select(F.col("v").alias("up"), F.col("up").alias("top"))
        hooks = staged(join_hot(hooks, tops, "up").select("v", "top"), "hooks")
        hot = hot_keys(now, "b")
        ends = join_hot(now, hooks.select(F.col("v").alias("a"), F.col("top").alias("ta")), "a")
        ends = join_hot(ends, hooks.select(F.col("v").alias("b"), F.col("top").alias("tb")), "b", hot=hot)
        labels = staged(join_hot(labels, hooks.select(F.col("v").alias("root"), "top"), "root", "left").select("v", F.coalesce("top", "root").alias("root")), "labels")
        now = staged(ends.select(*_simple("ta", "tb")).filter("a != b").distinct(), "edges")
