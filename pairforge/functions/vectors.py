"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns (K4-K6), computed in double with higher-order
functions - JVM-side, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12  # Fixed value: normalisation floor of the reference's L2 normalise.


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """K6: sum_i a_i * b_i."""
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """K4: v / max(||v||_2, 1e-12)."""
    n = F.greatest(l2_norm(v), F.lit(EPS))
    return F.transform(as_double(v), lambda x: x / n)


def cosine(a, b) -> Column:
    """K6: cosine similarity (each side normalised with the eps floor)."""
    return dot(l2_normalize(a), l2_normalize(b))


def truncate_dims(v, d: int) -> Column:
    """K5: Matryoshka prefix of the first ``d`` dimensions, re-normalised."""
    return l2_normalize(F.slice(_c(v), 1, d))


def vector_sum(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x)
