"""Join helper for "one row per key" tables (per-source, per-shard, per-batch stats).

A table whose rows and bytes are checked under ``max_rows`` and ``MAX_BROADCAST_BYTES`` is collected and joined as a broadcast local table, so
the large side is never shuffled by a possibly hot key; above the bound it is a regular join that AQE may
split on skew. The check reads at most ``max_rows + 1`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 16 << 20


def fits(rows: list) -> bool:
    """Whether collected rows of numbers and short texts are within ``MAX_BROADCAST_BYTES``."""
    return sum(16 + (len(v) if isinstance(v, (str, bytes, bytearray)) else 0) for r in rows for v in r) <= MAX_BROADCAST_BYTES


def join_bounded(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                 max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    rows = small.limit(max_rows + 1).collect()
    if len(rows) <= max_rows and fits(rows):
        local = big.sparkSession.createDataFrame(rows, small.schema)
        return big.join(F.broadcast(local), list(on), how)
    return big.join(small, list(on), how)
