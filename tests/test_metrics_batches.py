"""L1/L2 known values (FX7), L7 gate (FX11), F3/F4/H5/H6 invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF0001
from pairforge.operators import batches as bat
from pairforge.operators import metrics as met
from pairforge.operators import shards as sh
from pairforge.plans import fixtures as fx
from pairforge.plans.manifests import training_manifest


def test_fx7_first_batch_known_values(spark):
    b = met.batch_mnrl(fx.fx_pairs(spark, SF001)).where("batch_id = 0").collect()[0]
    # Inputs are float32; products are taken in double here and in the DuckDB oracle (exact match there), while
    # the documented value accumulated differently, so agreement is at float32 resolution.
    assert abs(b.row_ce - 6.079049395578858) < 1e-6
    assert b.top1 == pytest.approx(0.03125)
    assert b.n == 32


def test_evaluation_is_unweighted_mean_over_batches(spark):
    per = met.batch_mnrl(fx.fx_pairs(spark, SF001)).collect()
    ev = met.evaluate_pairs(fx.fx_pairs(spark, SF001)).collect()[0]
    assert ev.num_batches == len(per) == 8
    assert ev.eval_loss == pytest.approx(sum(r.loss for r in per) / len(per))


def test_quality_gate_fx11(spark):
    runs = spark.createDataFrame([("a", .40, .90), ("b", .40, .80), ("c", .50, .90), ("d", None, .90), ("e", .45, .85)],
                                 "run string, eval_loss double, eval_top1 double")
    got = {r.run: (r.passed, r.reason_code) for r in met.quality_gate(runs).collect()}
    assert got == {"a": (True, None), "b": (False, "low_top1"), "c": (False, "high_loss"),
                   "d": (False, "high_loss"), "e": (True, None)}
    unset = {r.run: r.passed for r in met.quality_gate(runs, None, None).collect()}
    assert all(unset.values())


def test_rank_shards_every_rank_gets_ceil(spark):
    m = training_manifest(spark, SF0001)
    shards = sh.assign_shards(m.df, 16)
    s = math.ceil(m.num_rows / 16)
    for world in (1, 3, 8):
        plan = sh.rank_shards(shards, world).collect()
        per = {}
        for r in plan:
            per.setdefault(r.rank, []).append(r.local_pos)
        assert set(per) == set(range(world))
        assert all(sorted(v) == list(range(math.ceil(s / world))) for v in per.values())
    with pytest.raises(ValueError):
        sh.rank_shards(shards, s + 1)


def test_pad_shard_reaches_target(spark):
    shards = sh.assign_shards(training_manifest(spark, SF0001).df, 64)
    padded = sh.pad_shard(shards, 64).groupBy("shard_id").count().collect()
    assert {r["count"] for r in padded} == {64}


def test_modality_batches_are_homogeneous(spark):
    m = training_manifest(spark, SF0001).df
    # the shortest group runs out, so the pattern doesn't hold on every row
    with pytest.raises(ValueError, match="not interleaved"):
        bat.detect_interleave(m, verify_all=True)
    even = 3 * min(r["count"] for r in m.groupBy("group_name").count().collect())
    pattern = [r.modality for r in bat.interleave_pattern(m).orderBy("slot").collect()]
    assert pattern == ["text", "image", "audio"]
    assert bat.detect_interleave(m.where(f"idx < {even}"), verify_all=True) == pattern
    plan = bat.modality_batches(m, pattern, 8).join(m.select("idx", "query_type"), "idx")
    mixed = plan.groupBy("batch_order").agg(F.countDistinct("query_type").alias("k")).where("k > 1").count()
    assert mixed == 0
    with pytest.raises(Exception, match="no batches for query modality"):
        bat.modality_batches(m, ["text", "image"], 8).count()
    assert plan.groupBy("batch_order").count().where("count <> 8").count() == 0
    assert plan.where("modality <> query_type").count() == 0


def test_large_shards_stay_whole(spark):
    df = spark.range(7).selectExpr("cast(id div 5 as int) shard_id", "cast(id % 5 as int) shard_pos", "id")
    got = sorted((r.shard_id, r.padded_pos) for r in sh.pad_shard(df, 3).collect())
    assert got == [(0, i) for i in range(5)] + [(1, i) for i in range(3)]


def test_invalid_metadata_is_an_error(spark):
    shards = spark.range(5).selectExpr("cast(id div 3 as int) shard_id")
    meta = spark.createDataFrame([(5, 2, 8)], "num_records int, num_shards int, shard_size int")
    with pytest.raises(ValueError, match="Invalid shard metadata"):
        sh.resolve_shard_sizes(meta, shards)


def test_ir_metrics_with_several_relevant_docs(spark):
    """Hand values: ranks 1 and 3 of 3 relevant docs, the third not in the corpus; another query finds nothing."""
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vec array<double>")
    c = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.9, 0.1]), (12, [0.8, 0.2])], "doc_id long, vec array<double>")
    rel = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (2, 98)], "query_id long, doc_id long")
    ranks = met.relevant_ranks(q, c, rel, block=1)
    assert {(r.query_id, r.doc_id): r["rank"] for r in ranks.collect()} == {(1, 10): 1, (1, 12): 3, (1, 99): None, (2, 98): None}
    m = met.ir_metrics(ranks).first()
    assert m.num_queries == 2 and m.accuracy_at_1 == 0.5 and m.mrr_at_10 == 0.5
    assert abs(m.recall_at_3 - 2 / 3 / 2) < 1e-12 and abs(m.precision_at_3 - 2 / 3 / 2) < 1e-12
    assert abs(m.map_at_100 - (1 + 2 / 3) / 3 / 2) < 1e-12
    assert abs(m.ndcg_at_10 - (1 + 0.5) / (1 + 1 / 1.584962500721156 + 0.5) / 2) < 1e-9


def test_topk_in_blocks(spark):
    rng = np.random.default_rng(0)
    qv, cv = rng.normal(size=(25, 4)), rng.normal(size=(300, 4))
    cv[100:120] = cv[0]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "query_id long, vec array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cv)], "doc_id long, vec array<double>").repartition(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(qv) @ unit(cv).T, 9)
    got = {}
    for r in met.retrieval_topk(q, c, k=7, block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    for i in range(25):
        assert [got[i][k] for k in range(1, 8)] == np.lexsort((np.arange(300), -s[i]))[:7].tolist()


@pytest.mark.parametrize("options", [{}, {"use_negative": True, "cosine": True}, {"use_negative": True, "cosine": True, "dims": [2, 4]}])
def test_tiles_of_a_large_batch(spark, options):
    """A score matrix in tiles gives the rows of the whole one, ties included, beside a batch of one tile and one of one row."""
    rng = np.random.default_rng(3)
    rows = [(b, i * 7 % 101 + 1000 * b, *(rng.normal(size=4).round(1).tolist() for _ in range(3))) for b, n in ((0, 90), (1, 10), (2, 1)) for i in range(n)]
    rows[5] = (*rows[5][:2], rows[5][2], rows[6][3], rows[7][3])  # equal candidates
    df = spark.createDataFrame(rows, "batch_id long, pair_id long, q array<double>, p array<double>, n array<double>")
    cols = ["group_key", "batch_id", "pair_id", "argmax_pair", "hit", "diag", "row_max", "row_lse", "col_lse"]
    whole = sorted(tuple(r) for r in met.batch_scores(df, **options).select(*cols).collect())
    tiled = sorted(tuple(r) for r in met.batch_scores(df, tile_rows=16, **options).select(*cols).collect())
    assert len(whole) == len(tiled) == 101 * len(options.get("dims", [0]))
    for a, b in zip(whole, tiled):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=0, atol=1e-9)


def test_retrieval_plan_does_not_grow_with_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "query_id long, vec array<double>")
    corpus = vecs.withColumnRenamed("query_id", "doc_id")
    rels = vecs.select("query_id", ((F.col("query_id") + 1) % 60).alias("doc_id"))
    nodes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    top, ranks = met.retrieval_topk(vecs, corpus, k=3, block=30), met.relevant_ranks(vecs, corpus, rels, block=30)
    small = met.retrieval_topk(vecs, corpus, k=3, block=2), met.relevant_ranks(vecs, corpus, rels, block=2)
    assert nodes(small[0]) == nodes(top) and nodes(small[1]) == nodes(ranks)
    want = [sorted(tuple(r) for r in x.collect()) for x in (top, ranks)]
    monkeypatch.setattr(met, "HELD_QUERIES", 4)  # and tasks hand on results early
    got = met.retrieval_topk(vecs, corpus, k=3, block=2, broadcast_bytes=0), met.relevant_ranks(vecs, corpus, rels, block=2, broadcast_bytes=0)
    assert [sorted(tuple(r) for r in x.collect()) for x in got] == want


@pytest.mark.parametrize("tile", [4, 2048])
def test_many_cells_of_retrieval(spark, monkeypatch, tile):
    """Queries beyond a broadcast and a cell: no join repeats blocks; ties, repeated ids, near ties and rows that are no numbers rank as in plain scores."""
    monkeypatch.setattr(met, "HELD_QUERIES", 8)
    monkeypatch.setattr(met, "CELL_ROWS", 90)
    monkeypatch.setattr(met, "TILE_COLUMNS", 16)
    rng = np.random.default_rng(5)
    qv, cv = rng.normal(size=(45, 6)), rng.normal(size=(400, 6))
    cv[50:90] = cv[3]
    cv[90:95] = cv[3] + 1e-8 * rng.normal(size=(5, 6))
    cv[200] = np.nan
    qv[:5] = cv[[3, 60, 91, 300, 301]]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "query_id long, vec array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cv)], "doc_id long, vec array<double>").repartition(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.einsum("ij,kj->ik", unit(qv), unit(cv)), 9)
    top = met.retrieval_topk(q, c, k=7, block=tile, broadcast_bytes=0)
    assert "Join" not in top._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.query_id, r["rank"]): r.doc_id for r in top.collect()}
    assert got == {(i, k + 1): d for i in range(45) for k, d in enumerate(np.lexsort((np.arange(400), -s[i]))[:7].tolist())}
    rel = [(i, (i * 37 + j * 11) % 400) for i in range(45) for j in range(5) if (i * 37 + j * 11) % 400 != 200]
    ranks = met.relevant_ranks(q, c, spark.createDataFrame(rel, "query_id long, doc_id long"), block=tile, broadcast_bytes=0)
    place = lambda i, d: 1 + int(((s[i] > s[i, d]) | ((s[i] == s[i, d]) & (np.arange(400) < d))).sum())
    assert {(r.query_id, r.doc_id): r["rank"] for r in ranks.collect()} == {(i, d): place(i, d) for i, d in rel}


@pytest.mark.parametrize("options", [{}, {"use_negative": True, "cosine": True, "dims": [2, 4]}, {"scale": 3000.0}])
def test_many_cells_of_a_batch(spark, monkeypatch, options):
    """The cells of a batch don't grow in number as tiles get smaller; they merge to the rows of the whole matrix, also where scores are far apart."""
    rng = np.random.default_rng(4)
    rows = [(b, i * 7 % 101 + 1000 * b, *(rng.normal(size=4).round(1).tolist() for _ in range(3))) for b, n in ((0, 100), (1, 30), (2, 1)) for i in range(n)]
    rows[5] = (*rows[5][:2], rows[5][2], rows[6][3], rows[7][3])  # equal candidates
    df = spark.createDataFrame(rows, "batch_id long, pair_id long, q array<double>, p array<double>, n array<double>")
    cols = ["group_key", "batch_id", "pair_id", "argmax_pair", "hit", "diag", "row_max", "row_lse", "col_lse"]
    whole = sorted(tuple(r) for r in met.batch_scores(df, **options).select(*cols).collect())
    cells, dealt = [], met._cell_partitions
    monkeypatch.setattr(met, "_cell_partitions", lambda spark, n: cells.append(n) or dealt(spark, n))
    met.batch_scores(df, tile_rows=4, **options)
    assert cells == [3]
    monkeypatch.setattr(met, "HELD_QUERIES", 20)
    monkeypatch.setattr(met, "CELL_ROWS", 40)
    monkeypatch.setattr(met, "TILE_COLUMNS", 7)
    tiled = sorted(tuple(r) for r in met.batch_scores(df, tile_rows=4, **options).select(*cols).collect())
    assert cells == [3, 5 * 3 + 2 + 1] and len(whole) == len(tiled) == 131 * len(options.get("dims", [0]))
    for a, b in zip(whole, tiled):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-12, atol=1e-9)


def test_no_duplicate_batches_invariant(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("query_value"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("positive_value"),
        F.lit(None).cast("string").alias("negative_value"))
    plan = bat.no_duplicate_batches(d, 16, drop_last=False, block_batches=4)
    rows = plan.join(d, "idx").collect()
    assert len(rows) == d.count() and len({r.idx for r in rows}) == len(rows)  # every row once
    by = {}
    for r in rows:
        by.setdefault(r.batch_id, []).append(r)
    for b in by.values():
        texts = [t for r in b for t in (r.query_value, r.positive_value) if t is not None]
        seen = set()
        for r in b:
            t = {x for x in (r.query_value, r.positive_value) if x is not None}
            assert not (t & seen)
            seen |= t
        assert len(b) <= 16
        del texts
