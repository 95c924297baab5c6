"""Media checks: first existing candidate (A7), anti/semi joins against an inventory (D1, D2), image count.

An inventory is a table with a ``path`` column (from ``sources.media.media_inventory`` on real storage, or
derived from tables). It is joined, never collected; AQE turns the join into a broadcast only when the
measured inventory is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.records import unpivot_items

# Image file suffixes counted by the readiness check (case-insensitive).
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")


def first_existing(df: DataFrame, cands_col: str, inventory: DataFrame, key: str, out_col: str = "path") -> DataFrame:
    """First path of an ordered candidate array that exists in ``inventory``; NULL if none.

    Empty or NULL candidates are skipped. ``key`` must identify rows of ``df``.
    """
    cands = (df.select(key, F.posexplode(cands_col).alias("_pos", "_cand"))
               .where(F.col("_cand").isNotNull() & (F.col("_cand") != "")))
    inv = inventory.select(F.col("path").alias("_cand")).distinct()
    hit = (cands.join(inv, "_cand", "left_semi")
                .groupBy(key).agg(F.min_by("_cand", "_pos").alias(out_col)))
    return df.join(hit, key, "left")


def keep_existing_media(df: DataFrame, inventory: DataFrame, path_col: str = "query_value") -> DataFrame:
    """Keep rows whose media path exists (left semi join)."""
    inv = inventory.select(F.col("path").alias(path_col)).distinct()
    return df.join(inv, path_col, "left_semi")


def missing_media(df: DataFrame, inventory: DataFrame, idx_col: str = "idx") -> DataFrame:
    """image/audio items (all roles) whose path is not in the inventory -> (idx, role, modality, path)."""
    items = unpivot_items(df, idx_col).where(F.col("modality").isin("image", "audio"))
    inv = inventory.select(F.col("path").alias("value")).distinct()
    missing = items.join(inv, "value", "left_anti")
    return missing.select(idx_col, "role", "modality", F.col("value").alias("path"))


def missing_media_report(df: DataFrame, inventory: DataFrame, idx_col: str = "idx", first: int = 20):
    """D1 report: the first ``first`` misses in record order and the total (the validator fails if any)."""
    miss = missing_media(df, inventory, idx_col)
    total = miss.count()
    head = miss.orderBy(idx_col, "role").limit(first).collect() if total else []
    return head, total


def count_images(inventory: DataFrame) -> DataFrame:
    """Number of inventory files with an image suffix, case-insensitively (0 for an empty inventory)."""
    low = F.lower(F.col("path"))
    cond = None
    for suf in IMAGE_SUFFIXES:
        c = low.endswith(suf)
        cond = c if cond is None else (cond | c)
    return inventory.agg(F.count_if(cond).alias("num_images"))
