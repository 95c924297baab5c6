"""Driver contract smoke test, DuckDB oracle on sf0.001 for a sample of queries, plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF0001
from pairforge.plans.manifests import training_manifest
from pairforge.plans.registry import ORACLE, QUERIES

TABLES = ["documents", "labels", "pages", "conversations", "embeddings", "events"]
SAMPLE = ["t1_manifest", "e3_dataset_summary", "b1_parse_records", "c1_ring_negatives", "h5_modality_batches",
          "l1_batch_mnrl", "f3_rank_shards", "e1_summarize_capped"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 342  # 76 text / 66 image / 200 audio (every document) at sf0.001
    assert df.columns[0] == "idx"


def test_every_query_has_oracle_or_is_documented():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(q)
    assert set(QUERIES) - set(ORACLE) == {"h6_no_duplicate_batches"}  # its invariants have a query of their own


def _norm(rows):
    def v(x):
        return round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(v(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF0001)
    res = con.sql(entry.oracle_sql()[name])
    cols = sorted(sdf.columns)
    assert cols == sorted(res.columns)
    a = _norm([tuple(r[c] for c in cols) for r in sdf.collect()])
    idx = [res.columns.index(c) for c in cols]
    b = _norm([tuple(r[i] for i in idx) for r in res.fetchall()])
    assert a == b


def test_manifest_plan_has_no_single_partition_exchange(spark):
    m = training_manifest(spark, SF0001).df
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


ROW_SCALE = ["t1_manifest", "c2_interleave", "h3_shuffled_batches", "h5_modality_batches", "f7_stratified_order",
             "d1_missing_media", "b1_parse_records", "d4_locate", "e6_shard_offsets", "d6_retrieval_topk"]


@pytest.mark.parametrize("name", ROW_SCALE)
def test_row_scale_plans_have_no_single_partition_exchange(spark, name):
    df = entry.queries()[name](spark, SF0001)
    df.count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan, name
