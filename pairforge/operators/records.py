"""Record-level projections and filters: B3-B6, C0a, C0b.

A record row is flat: ``query_type, query_value, positive_type, positive_value, negative_type,
negative_value`` (negative columns NULL when absent) plus lineage columns (``idx``, ``source``...).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("query", "positive", "negative")
# The modality domain of records.
SUPPORTED_MODALITIES = ("text", "image", "audio")


def unpivot_items(df: DataFrame, idx_col: str = "idx") -> DataFrame:
    """Record -> (idx, role, modality, value) rows; a missing negative yields no row."""
    items = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_type").alias("modality"),
                               F.col(f"{r}_value").alias("value")) for r in ROLES])
    return (df.select(idx_col, F.inline(items))
              .where(F.col("modality").isNotNull()))


def _resolve(modality: Column, value: Column, image_root: str | None, audio_root: str | None) -> Column:
    out = value
    for mod, root in (("image", image_root), ("audio", audio_root)):
        if root:
            # os.path.join semantics: add one separator unless the root already ends with one.
            joined = F.concat(F.lit(root if root.endswith("/") else root + "/"), value)
            out = F.when((modality == mod) & ~value.startswith("/"), joined).otherwise(out)
    return out


def resolve_media(df: DataFrame, image_root: str | None = None, audio_root: str | None = None) -> DataFrame:
    """Prefix relative image/audio paths with their root (all roles); absolute paths stay as they are."""
    if not image_root and not audio_root:
        return df
    for r in ROLES:
        if f"{r}_type" in df.columns:
            df = df.withColumn(f"{r}_value", _resolve(F.col(f"{r}_type"), F.col(f"{r}_value"), image_root, audio_root))
    return df


def payload(role: str) -> Column:
    """One-key payload struct(text, image, audio) with only the field of the item's modality set."""
    t, v = F.col(f"{role}_type"), F.col(f"{role}_value")
    return F.struct(*[F.when(t == m, v).alias(m) for m in SUPPORTED_MODALITIES])


def to_trainer_rows(df: DataFrame, include_negative: bool) -> DataFrame:
    """Columns ``query``, ``positive`` and, when asked, ``negative_0`` (column order matters)."""
    cols = [payload("query").alias("query"), payload("positive").alias("positive")]
    if include_negative:
        cols.append(F.when(F.col("negative_type").isNotNull(), payload("negative")).alias("negative_0"))
    keep = [c for c in ("idx",) if c in df.columns]
    return df.select(*keep, *cols)


def has_uniform_negatives(df: DataFrame) -> bool:
    """B6 flag: every kept row has a negative (and there is at least one)."""
    r = df.agg(F.count_if(F.col("negative_type").isNotNull()).alias("p"),
               F.count_if(F.col("negative_type").isNull()).alias("m")).collect()[0]
    return r["p"] > 0 and r["m"] == 0


def project_uniform_negative(df: DataFrame) -> DataFrame:
    """Trainer rows with ``negative_0`` only if every row has a negative."""
    return to_trainer_rows(df, has_uniform_negatives(df))


def _set(values: Iterable[str] | None) -> list[str]:
    return sorted(set(values or []))


def modality_filter(allowed: Iterable[str] | None = None, query: Iterable[str] | None = None,
                    positive: Iterable[str] | None = None, negative: Iterable[str] | None = None) -> Column:
    """C0a predicate. Empty/None = no constraint. ``allowed`` must contain every modality of the record
    (negative included when present); role filters apply per side; the negative filter only if one exists.
    """
    cond = F.lit(True)
    a, q, p, n = _set(allowed), _set(query), _set(positive), _set(negative)
    qt, pt, nt = F.col("query_type"), F.col("positive_type"), F.col("negative_type")
    if a:
        cond = cond & qt.isin(*a) & pt.isin(*a) & (nt.isNull() | nt.isin(*a))
    if q:
        cond = cond & qt.isin(*q)
    if p:
        cond = cond & pt.isin(*p)
    if n:
        cond = cond & (nt.isNull() | nt.isin(*n))
    return cond


def filter_modalities(df: DataFrame, allowed=None, query=None, positive=None, negative=None) -> DataFrame:
    """Keep records matching the modality filters."""
    return df.where(modality_filter(allowed, query, positive, negative))


def require_negative(df: DataFrame, mode: str = "filter", line_col: str = "line_no") -> DataFrame:
    """Records without a negative are dropped (``filter``) or fail the job naming the 1-based line."""
    if mode == "filter":
        return df.where(F.col("negative_type").isNotNull())
    line = F.col(line_col) if line_col in df.columns else F.col("idx") + 1
    check = F.when(F.col("negative_type").isNull(),
                   F.raise_error(F.concat(F.lit("Missing negative at line "), line.cast("string"))))
    return df.where(check.otherwise(F.lit(True)))
