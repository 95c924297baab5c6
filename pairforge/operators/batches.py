"""Batch plans: H1 collate, H2 sequential, H3 shuffled, H4 interleave detection, H5 modality-homogeneous
batches, H6 no-duplicate batches.

A plan is a table ``(batch_id, pos_in_batch, idx)`` (plus group columns) - never Python lists. Permutations
use the key md5(concat_ws(':', seed + epoch, ...)) in place of a PRNG stream (same key in DuckDB).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pairforge.session import ship_package
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.operators.index import global_index, group_index

DEFAULT_SEED = 42


def perm_key(seed: int, epoch: int, *parts) -> F.Column:
    """Deterministic permutation key (hex md5 of 'seed+epoch:part:...')."""
    cols = [F.lit(str(seed + epoch))] + [p.cast("string") if isinstance(p, F.Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def sequential_batches(df: DataFrame, batch_size: int, drop_last: bool = True, idx_col: str = "idx",
                       within: Sequence[str] = ()) -> DataFrame:
    """H2: consecutive batches by ``idx_col`` (a 0-based position, per ``within`` group if given)."""
    if within:
        df = group_index(df, list(within), [idx_col], pos_col="_pf_pos", size_col="_pf_size")
        pos, n = F.col("_pf_pos"), F.col("_pf_size")
    else:
        pos, n = F.col(idx_col), F.lit(df.count() if drop_last else 0)
    out = df.withColumn("batch_id", F.floor(pos / batch_size).cast("bigint")) \
            .withColumn("pos_in_batch", (pos % batch_size).cast("int"))
    if drop_last:  # only the last batch can be short
        out = out.where((F.col("batch_id") + 1) * batch_size <= n)
    return out.drop("_pf_pos", "_pf_size") if within else out


def shuffled_batches(df: DataFrame, batch_size: int, seed: int = DEFAULT_SEED, epoch: int = 0,
                     drop_last: bool = True, idx_col: str = "idx", within: Sequence[str] = ()) -> DataFrame:
    """H3: permutation (by md5 key, per ``within`` group e.g. shard_id), then consecutive batches."""
    keyed = df.withColumn("_pf_key", perm_key(seed, epoch, F.col(idx_col)))
    if within:
        ix = group_index(keyed, list(within), ["_pf_key", idx_col], pos_col="perm_pos", size_col="_pf_size")
    else:
        one = global_index(keyed, ["_pf_key", idx_col], "perm_pos")
        ix = one.df.withColumn("_pf_size", F.lit(one.total))
    out = ix.drop("_pf_key").withColumn("batch_id", F.floor(F.col("perm_pos") / batch_size).cast("bigint")) \
            .withColumn("pos_in_batch", (F.col("perm_pos") % batch_size).cast("int"))
    if drop_last:
        out = out.where((F.col("batch_id") + 1) * batch_size <= F.col("_pf_size"))
    return out.drop("_pf_size")


def collate(plan: DataFrame, batch_cols: Sequence[str] = ("batch_id",), pos_col: str = "pos_in_batch") -> DataFrame:
    """H1: rows -> per-batch lists by role, in batch order. A batch is bounded by the batch size, so the
    per-group ``collect_list`` never gathers an unbounded group."""
    def role(r):
        return F.struct(F.col(f"{r}_type").alias("modality"), F.col(f"{r}_value").alias("value"))
    rows = F.struct(F.col(pos_col).alias("p"), role("query").alias("query"), role("positive").alias("positive"),
                    F.when(F.col("negative_type").isNotNull(), role("negative")).alias("negative"))
    g = plan.groupBy(*batch_cols).agg(F.array_sort(F.collect_list(rows)).alias("_pf_rows"))
    def field(name):
        return F.transform("_pf_rows", lambda x: x.getField(name)).alias(name)
    return g.select(*batch_cols, *[field(r) for r in ("query", "positive", "negative")])


def interleave_pattern(df: DataFrame, idx_col: str = "idx", modality_col: str = "query_type",
                       scan_rows: int = 18, max_period: int = 3) -> DataFrame:
    """H4 pattern table (slot, modality, first_idx): distinct query modalities in first-seen order over the
    first ``scan_rows`` rows, at most ``max_period`` of them (the scan window is the feature)."""
    first = (df.where(F.col(idx_col) < scan_rows).groupBy(modality_col)
               .agg(F.min(idx_col).alias("first_idx")))
    ranked = global_index(first, ["first_idx"], "slot").df
    return ranked.where(F.col("slot") < max_period).select("slot", F.col(modality_col).alias("modality"), "first_idx")


def detect_interleave(df: DataFrame, idx_col: str = "idx", modality_col: str = "query_type",
                      scan_rows: int = 18, max_period: int = 3, verify_per_slot: int = 64,
                      sample_size: int = 256, seed: int = DEFAULT_SEED, verify_all: bool = False) -> list[str]:
    """H4: query-modality pattern = distinct modalities in first-seen order over the first 18 rows (stop at
    3); fewer than 2 fail. Rows must follow pattern[i mod period] on the first min(n, 64 * period) rows and on
    up to ``sample_size`` sampled positions (the sample is the feature: the rows with the smallest
    md5(seed:idx) keys, a distributed top-k). ``verify_all`` checks every row instead. Returns the pattern."""
    first = interleave_pattern(df, idx_col, modality_col, scan_rows, max_period).orderBy("slot").collect()
    pattern = [r["modality"] for r in first]
    if not pattern:
        raise ValueError("no rows to detect an interleave pattern in")
    if len(pattern) < 2:
        raise ValueError("one query modality only: there is no interleave pattern")
    period = len(pattern)
    expected = F.element_at(F.array(*[F.lit(m) for m in pattern]), (F.col(idx_col) % period).cast("int") + 1)
    wrong = ~F.col(modality_col).eqNullSafe(expected)
    if verify_all:
        bad = df.where(wrong).limit(1).count()
    else:
        head = df.where(F.col(idx_col) < verify_per_slot * period).where(wrong).limit(1).count()
        sample = (df.select(idx_col, modality_col, perm_key(seed, 0, F.col(idx_col)).alias("_pf_key"))
                    .orderBy("_pf_key", idx_col).limit(sample_size))
        bad = head + sample.where(wrong).count()
    if bad:
        raise ValueError(f"query modalities are not interleaved as {'-'.join(pattern)} over the whole table")
    return pattern


def modality_batches(df: DataFrame, pattern: Sequence[str], batch_size: int, seed: int = DEFAULT_SEED,
                     epoch: int = 0, drop_last: bool = True, idx_col: str = "idx",
                     modality_col: str = "query_type") -> DataFrame:
    """H5: batches of one query modality each, whether or not the rows are interleaved (H4 tells). The rows of a
    modality of ``pattern`` are permuted and cut into batches; batch order is a permutation of all (modality, batch)
    descriptors. Rows of other modalities fail. Output: (batch_order, modality, batch_idx, pos_in_batch, idx)."""
    mod = F.col(modality_col)
    known = F.when(mod.isin(*pattern), mod).otherwise(F.raise_error(F.concat(F.lit("no batches for query modality "), F.coalesce(mod, F.lit("null")))))
    rows = df.select(idx_col, known.alias("modality"))
    rows = rows.withColumn("_pf_key", perm_key(seed, epoch, F.col("modality"), F.col(idx_col)))
    ix = group_index(rows, ["modality"], ["_pf_key", idx_col], pos_col="_pf_rank", size_col="_pf_n")
    ix = ix.withColumn("batch_idx", F.floor(F.col("_pf_rank") / batch_size).cast("bigint")) \
           .withColumn("pos_in_batch", (F.col("_pf_rank") % batch_size).cast("int"))
    if drop_last:
        ix = ix.where((F.col("batch_idx") + 1) * batch_size <= F.col("_pf_n"))
    batches = ix.select("modality", "batch_idx").distinct() \
                .withColumn("_pf_bkey", perm_key(seed, epoch, F.lit("batch"), F.col("modality"), F.col("batch_idx")))
    order = global_index(batches, ["_pf_bkey", "modality", "batch_idx"], "batch_order").df.drop("_pf_bkey")
    return ix.join(order, ["modality", "batch_idx"]).select("batch_order", "modality", "batch_idx",
                                                             "pos_in_batch", idx_col)


def _greedy_no_dup(batch_size: int, keep_partial: bool):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pf_rank")
        batches: list[list[int]] = []
        seen: list[set] = []
        for i, texts in zip(pdf["_pf_rank"].tolist(), pdf["_pf_texts"].tolist()):
            t = {x for x in (list(texts) if texts is not None else []) if x is not None}
            for b, s in zip(batches, seen):
                if len(b) < batch_size and not (t & s):
                    b.append(i)
                    s |= t
                    break
            else:
                batches.append([i])
                seen.append(set(t))
        block = int(pdf["_pf_block"].iloc[0])
        out = []
        for bno, b in enumerate(batches):
            if len(b) < batch_size and not keep_partial:
                out.extend((i, -1, -1, -1) for i in b)
            else:
                out.extend((i, block, bno, p) for p, i in enumerate(b))
        return pd.DataFrame(out, columns=["_pf_rank", "block", "block_batch", "pos_in_batch"])
    return fill


def no_duplicate_batches(df: DataFrame, batch_size: int, seed: int = DEFAULT_SEED, epoch: int = 0,
                         drop_last: bool = True, block_batches: int = 64, rounds: int | None = None,
                         idx_col: str = "idx") -> DataFrame:
    """H6: batches in which no text (query/positive/negative value) repeats.

    Rows are permuted (P1 over the md5 key), cut into blocks of ``block_batches * batch_size`` rows, and each
    block is filled greedily in ``applyInPandas`` (a bounded group, never the whole table). Rows that end in an
    incomplete batch are re-blocked and retried, until one block held all that was left or a round placed nothing
    (or after ``rounds`` retries); in that last round incomplete batches are kept (duplicate-free) unless
    ``drop_last``. Texts are compared by their 64-bit hash, so no text is shuffled; equal hashes of different texts
    would only keep two rows apart. Output: (idx, batch_id, pos_in_batch).
    """
    ship_package(df.sparkSession)
    texts = F.transform(F.array("query_value", "positive_value", "negative_value"), lambda t: F.when(t.isNotNull(), F.xxhash64(t)))
    work = df.select(idx_col, texts.alias("_pf_texts"), perm_key(seed, epoch, F.col(idx_col)).alias("_pf_key"))
    rows_per_block = block_batches * batch_size
    schema = T.StructType([T.StructField("_pf_rank", T.LongType()), T.StructField("block", T.LongType()),
                           T.StructField("block_batch", T.LongType()), T.StructField("pos_in_batch", T.LongType())])
    done, before = None, None
    for rnd in itertools.count():
        ix = global_index(work, ["_pf_key", idx_col], "_pf_rank")
        if ix.total == 0:
            break
        last = ix.total <= rows_per_block or ix.total == before or rnd == rounds
        before = ix.total
        staged = ix.df.withColumn("_pf_block", F.floor(F.col("_pf_rank") / rows_per_block))
        placed = staged.select("_pf_rank", "_pf_block", "_pf_texts").groupBy("_pf_block") \
                       .applyInPandas(_greedy_no_dup(batch_size, keep_partial=last and not drop_last), schema)
        # written once: the round's placements and the rows left for the next one
        res = ix.df.select("_pf_rank", idx_col, "_pf_key", "_pf_texts").join(placed, "_pf_rank").checkpoint(eager=True)
        good = res.where(F.col("block") >= 0).select(
            idx_col, F.lit(rnd).alias("round"), "block", "block_batch", "pos_in_batch")
        done = good if done is None else done.unionByName(good)
        if last:
            break
        work = res.where(F.col("block") < 0).select(idx_col, "_pf_texts", "_pf_key")
    if done is None:
        return df.sparkSession.createDataFrame([], f"{idx_col} long, batch_id long, pos_in_batch long")
    ids = done.select("round", "block", "block_batch").distinct()
    ids = global_index(ids, ["round", "block", "block_batch"], "batch_id").df
    return done.join(ids, ["round", "block", "block_batch"]).select(idx_col, "batch_id", "pos_in_batch")
