"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.session import ensure_checkpoint_dir, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.lower() and bytes.split() have exactly the contract's meaning on UTF-8: A-Z only, and the separators
#: 0x20 and 0x09-0x0D only, which never occur inside a multi-byte character.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_text_crc(c: Column) -> Column:
    """crc32 of an integer id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


def words_of(text: str | None) -> list[bytes]:
    """Whitespace-separated words of a whole text, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """Like :func:`words_of`, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def arrow_rows(df: DataFrame, fn: Callable[[list[list]], dict[str, list]], schema: str,
               chunk: int = 512) -> DataFrame:
    """Apply ``fn`` (columns as Python lists -> output columns) to slices of at most ``chunk`` rows of each Arrow batch, so
    a task holds the outputs of one slice at a time whatever the batch size is."""
    ensure_checkpoint_dir(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, chunk):
                part = b.slice(s, chunk)
                got = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], type=f.type)
                     for f in out], schema=out)
    return df.mapInArrow(run, schema)


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder in the shared checkpoint directory and read it back: work that several later
    plans need runs once, survives a lost executor, and has no lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Most keys that :func:`join_hot` broadcasts, and the fewest rows of such a key.
HOT_KEYS, HOT_ROWS = 1000, 200


def hot_keys(rows: DataFrame, key: str) -> list:
    """The at most ``HOT_KEYS`` keys with most rows, of those with ``HOT_ROWS`` or more: any other key has at most
    1 / ``HOT_KEYS`` of the rows, or fewer than ``HOT_ROWS``."""
    few = rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") >= HOT_ROWS).orderBy(F.desc("count"), key).limit(HOT_KEYS)
    return [r[key] for r in few.collect()]


def join_hot(rows: DataFrame, values: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows`` (written, or cheap to read again) joined with ``values`` (one row a key), when a key may hold many rows: the
    values of hot keys, bounded in number, are broadcast, so their rows aren't shuffled; the others join by shuffle."""
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(values, key, how)
    of = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (rows.filter(of).join(F.broadcast(values.filter(of)), key, how)
            .unionByName(rows.filter(~of).join(values.filter(~of), key, how)))


_STATE: dict = {}


def _give_back() -> None:
    """Return freed memory to the system: the workers of an executor share its limit with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def worker_state(key, make: Callable):
    """What an operator keeps in a Python worker between tasks (a memo, a table). A worker serves one operator after the
    other, so it holds the state of the latest only, and what the one before freed goes back to the system."""
    if key not in _STATE:
        _STATE.clear()
        _give_back()
        _STATE[key] = make()
    return _STATE[key]


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (batches -> batches), and when a task's batches end, what it freed goes back to the system: its worker waits beside the
    JVM's next stages, under one limit."""
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        _give_back()
    return whole


class IntTable:
    """Values by non-negative integer key, for whole arrays of keys: an open-addressed table of numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int = -1):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        self._missing = missing
        self._bits = max(10, (4 * len(keys)).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._values = np.full(1 << self._bits, missing, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # the first to reach a free slot gets it, the others move on
            cand = left[self._keys[at[left]] == -1]
            won = cand[np.unique(at[cand], return_index=True)[1]]
            self._keys[at[won]], self._values[at[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & (len(self._keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._values[at], self._missing)
        miss = np.flatnonzero((found != keys) & (found != -1))
        while len(miss):
            at[miss] = (at[miss] + 1) & (len(self._keys) - 1)
            found = self._keys[at[miss]]
            hit = found == keys[miss]
            out[miss[hit]] = self._values[at[miss[hit]]]
            miss = miss[~hit & (found != -1)]
        return out
