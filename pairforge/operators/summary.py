"""Manifest summaries: E1 summarize_manifest, E2 summarize_sample, E7 unsupported_modalities.

Each is one partial/final aggregate over the records (map-side combine, skew-safe); the only extra pass is
the P1 index that E1 needs when a ``max_records`` cap is actually reached.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.index import global_index
from pairforge.operators.records import modality_filter, unpivot_items


def _modalities(cond=None):
    mods = F.array_compact(F.array(F.col("query_type"), F.col("positive_type"), F.col("negative_type")))
    if cond is not None:
        mods = F.when(cond, mods)
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(mods))))


def summarize_manifest(df: DataFrame, allowed=None, query=None, positive=None, negative=None,
                       max_records: int | None = None, idx_col: str = "idx") -> DataFrame:
    """One row (modalities, num_rows, has_uniform_negatives, num_negatives_present,
    num_negatives_missing, skipped_rows) over records in ``idx_col`` order.

    ``skipped_rows`` counts filtered-out records seen before the cap was reached (all of them when the cap
    is not reached). 0 matched rows raise, like the reference.
    """
    if max_records is not None and max_records <= 0:
        raise ValueError("max_records must be positive")
    m = modality_filter(allowed, query, positive, negative)
    data = df.withColumn("_pf_match", m)
    if max_records is not None:
        matched = data.where("_pf_match").select(idx_col)
        ix = global_index(matched, [idx_col], "_pf_rank")
        if ix.total > max_records:
            last = ix.df.where(F.col("_pf_rank") == max_records - 1).select(idx_col).collect()[0][0]
            data = data.where(F.col(idx_col) <= F.lit(last))
    ok = F.col("_pf_match")
    neg = F.col("negative_type").isNotNull()
    out = data.agg(_modalities(ok).alias("modalities"),
                   F.count_if(ok).alias("num_rows"),
                   F.count_if(ok & neg).alias("num_negatives_present"),
                   F.count_if(ok & ~neg).alias("num_negatives_missing"),
                   F.count_if(~ok).alias("skipped_rows"))
    out = out.withColumn("has_uniform_negatives",
                         (F.col("num_negatives_present") > 0) & (F.col("num_negatives_missing") == 0))
    # fixed value: the text of the error
    out = out.withColumn("_pf_chk", F.when(F.col("num_rows") == 0, F.raise_error(F.lit("No records loaded"))))
    return out.where(F.col("_pf_chk").isNull()).select(
        "modalities", "num_rows", "has_uniform_negatives", "num_negatives_present", "num_negatives_missing",
        "skipped_rows")


def sample_head(df: DataFrame, sample_size: int = 256, idx_col: str = "idx") -> DataFrame:
    """C0d: the first ``sample_size`` rows by ``idx_col``, a 0-based position (the sample is the feature)."""
    if sample_size <= 0:
        raise ValueError("sample_size must be positive")
    return df.where(F.col(idx_col) < sample_size)


def summarize_sample(df: DataFrame, sample_size: int = 256, idx_col: str = "idx") -> DataFrame:
    """Like E1 over the first ``sample_size`` rows (the sample is the feature), but ``num_rows`` is the full
    length and ``has_uniform_negatives`` = present == 0 OR missing == 0; adds ``sampled_rows``."""
    head = F.col(idx_col) < sample_size
    neg = F.col("negative_type").isNotNull()
    out = df.agg(F.count(F.lit(1)).alias("num_rows"), _modalities(head).alias("modalities"),
                 F.count_if(head & neg).alias("num_negatives_present"),
                 F.count_if(head & ~neg).alias("num_negatives_missing"),
                 F.count_if(head).alias("sampled_rows"))
    return out.withColumn("has_uniform_negatives",
                          (F.col("num_negatives_present") == 0) | (F.col("num_negatives_missing") == 0))


def unsupported_modalities(df: DataFrame, supported: Iterable[str] | None, idx_col: str = "idx") -> DataFrame:
    """(modality, n_items) of dataset modalities the model does not support; empty = pass.

    Unknown support (None/empty) passes. ``raise_unsupported`` turns a non-empty result into the error.
    """
    sup = sorted(set(supported or []))
    items = unpivot_items(df, idx_col)
    counts = items.groupBy("modality").agg(F.count(F.lit(1)).alias("n_items"))
    if not sup:
        return counts.where(F.lit(False))
    return counts.where(~F.col("modality").isin(*sup))


def raise_unsupported(df: DataFrame, supported: Iterable[str]) -> None:
    rows = sorted(r["modality"] for r in unsupported_modalities(df, supported).collect())
    if rows:
        raise ValueError(f"the model takes {', '.join(sorted(set(supported)))}, but the data also has {', '.join(rows)}")
