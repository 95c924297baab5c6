"""Embedding operators K2 mean_pool, K3 project, K4/K5 per-row normalise and truncate.

K2 and K4/K5 are JVM higher-order functions. K3 multiplies by a small matrix held in the task: the matrix
is collected only after its row count is checked against ``max_rows`` and shipped as a broadcast variable;
the data side is processed partition by partition in ``mapInPandas`` with one numpy matmul per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pairforge.session import ship_package
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.vectors import as_double, l2_normalize, truncate_dims


def mean_pool(df: DataFrame, tokens_col: str, out_col: str = "pooled", skip_first: bool = False) -> DataFrame:
    """K2: mean over positions of ARRAY<ARRAY<num>>; with ``skip_first`` the first position is dropped when
    there is more than one (image towers drop the class token); audio/text pool all positions."""
    toks = F.col(tokens_col)
    if skip_first:
        toks = F.when(F.size(toks) > 1, F.slice(toks, 2, F.size(toks) - 1)).otherwise(toks)
    first = F.transform(as_double(F.try_element_at(toks, F.lit(1))), lambda x: x * 0.0)
    total = F.aggregate(toks, first, lambda acc, t: F.zip_with(acc, as_double(t), lambda a, b: a + b))
    n = F.size(toks).cast("double")
    return df.withColumn(out_col, F.transform(total, lambda x: x / n))


def normalize(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """K4."""
    return df.withColumn(out_col or col, l2_normalize(col))


def truncate_all(df: DataFrame, col: str, dims: Sequence[int], out_col: str = "vec") -> DataFrame:
    """K5 for every Matryoshka dim at once: explode the dims list, slice, re-normalise."""
    staged = df.withColumn("dim", F.explode(F.array(*[F.lit(int(d)) for d in dims])))
    return staged.withColumn(out_col, l2_normalize(F.slice(F.col(col), 1, F.col("dim"))))


def project(df: DataFrame, vec_col: str, weights: DataFrame, bias: float | Sequence[float] = 0.0,
            out_col: str = "projected", max_rows: int = 65536) -> DataFrame:
    """K3: y = W x + b. ``weights`` has (row INT, w ARRAY<num>) - one row per output dimension.

    W is bounded by ``max_rows`` output dimensions (checked before collecting); identity when absent is the
    caller's choice (skip the call)."""
    ship_package(df.sparkSession)
    n = weights.count()
    if n > max_rows:
        raise ValueError(f"projection has {n} output rows, above the broadcast bound {max_rows}")
    rows = sorted((int(r[0]), list(r[1])) for r in weights.select("row", "w").collect())
    w = np.asarray([r[1] for r in rows], dtype=np.float64)
    b = np.broadcast_to(np.asarray(bias, dtype=np.float64), (w.shape[0],)).copy()
    bw = df.sparkSession.sparkContext.broadcast((w, b))
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def apply(batches):
        wm, bv = bw.value
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]]) if len(pdf) else \
                np.zeros((0, wm.shape[1]))
            y = x @ wm.T + bv
            pdf = pdf.copy()
            pdf[out_col] = list(y)
            yield pdf
    return df.mapInPandas(apply, out_schema)


__all__ = ["mean_pool", "normalize", "truncate_all", "truncate_dims", "project"]
