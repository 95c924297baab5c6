"""Spark operators against plain-Python simulations of the reference's sequential loops (sf0.001 manifest)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from pairforge.operators import media as media_ops
from pairforge.operators import records as rec
from pairforge.operators import shards as sh
from pairforge.operators.summary import summarize_manifest
from pairforge.plans.manifests import training_manifest

FILTERS = [
    dict(),
    dict(allowed=["text", "image"]),
    dict(query=["image"]),
    dict(allowed=["text", "audio"], negative=["text"]),
    dict(positive=["image"]),
]


@pytest.fixture(scope="module")
def manifest(spark):
    m = training_manifest(spark, SF0001).df
    rows = sorted(m.collect(), key=lambda r: r.idx)
    return m, rows


def matches(r, allowed=None, query=None, positive=None, negative=None):
    mods = {r.query_type, r.positive_type} | ({r.negative_type} if r.negative_type else set())
    if allowed and not mods <= set(allowed):
        return False
    if query and r.query_type not in query:
        return False
    if positive and r.positive_type not in positive:
        return False
    if r.negative_type and negative and r.negative_type not in negative:
        return False
    return True


def simulate_summary(rows, max_records=None, **flt):
    mods, present, missing, skipped, n = set(), 0, 0, 0, 0
    for r in rows:
        if not matches(r, **flt):
            skipped += 1
            continue
        mods |= {r.query_type, r.positive_type}
        if r.negative_type:
            mods.add(r.negative_type)
            present += 1
        else:
            missing += 1
        n += 1
        if max_records is not None and n >= max_records:
            break
    return sorted(mods), n, present > 0 and missing == 0, present, missing, skipped


@pytest.mark.parametrize("flt", FILTERS)
@pytest.mark.parametrize("cap", [None, 7, 10_000])
def test_summary_with_cap(spark, manifest, flt, cap):
    m, rows = manifest
    want = simulate_summary(rows, cap, **flt)
    if want[1] == 0:
        with pytest.raises(Exception):
            summarize_manifest(m, max_records=cap, **flt).collect()
        return
    got = summarize_manifest(m, max_records=cap, **flt).collect()[0]
    assert (list(got.modalities), got.num_rows, got.has_uniform_negatives, got.num_negatives_present,
            got.num_negatives_missing, got.skipped_rows) == want


@pytest.mark.parametrize("flt", FILTERS)
def test_modality_filter(manifest, flt):
    m, rows = manifest
    got = sorted(r.idx for r in rec.filter_modalities(m, **flt).select("idx").collect())
    assert got == [r.idx for r in rows if matches(r, **flt)]


def test_first_existing_and_semi_join(spark):
    df = spark.createDataFrame([(1, ["a.jpg", "images/a.jpg"]), (2, ["", None, "b.jpg"]), (3, ["x", "y"]), (4, [])],
                               "k long, cands array<string>")
    inv = spark.createDataFrame([("images/a.jpg",), ("a.jpg",), ("b.jpg",)], "path string")
    got = {r.k: r.path for r in media_ops.first_existing(df, "cands", inv, "k").collect()}
    assert got == {1: "a.jpg", 2: "b.jpg", 3: None, 4: None}


def test_locate_out_of_range_fails(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 5), (2, 1)], "shard_id int, size long")
    off = sh.shard_offsets(sizes)
    pos = spark.createDataFrame([(i,) for i in range(9)], "position long")
    got = {r.position: (r.shard_id, r.local_pos) for r in sh.locate(pos, off).collect()}
    assert got == {0: (0, 0), 2: (0, 2), 3: (1, 0), 7: (1, 4), 8: (2, 0), 1: (0, 1), 4: (1, 1), 5: (1, 2), 6: (1, 3)}
    with pytest.raises(Exception, match="out of range"):
        sh.locate(spark.createDataFrame([(9,)], "position long"), off).collect()


def test_locate_on_many_partitions(spark):
    """Starts are carried over 2,000 partitions by one literal: the plan has no branch a partition."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 12, 3000)
    end = np.cumsum(sizes)
    off = spark.createDataFrame([(i, int(n), int(e - n), int(e)) for i, (n, e) in enumerate(zip(sizes, end))], "shard_id int, size long, start long, end long")
    at = rng.integers(0, int(end[-1]), 4000)
    pos = spark.createDataFrame([(int(p),) for p in at], "position long")
    conf = {"spark.sql.shuffle.partitions": "2000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = sh.locate(pos, off)
        got = sorted((r.position, r.shard_id, r.local_pos) for r in found.collect())
        assert found._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") <= 4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    shard = np.searchsorted(end, at, side="right")
    assert got == sorted((int(p), int(s), int(p - end[s] + sizes[s])) for p, s in zip(at, shard))


def test_invalid_shard_metadata_fails(spark):
    meta = spark.createDataFrame([(100, 3, 64)], "num_records long, num_shards int, shard_size int")
    with pytest.raises(Exception, match="Invalid shard metadata"):
        sh.shard_sizes_from_metadata(meta).collect()
    ok = spark.createDataFrame([(100, 2, 64)], "num_records long, num_shards int, shard_size int")
    assert [(r.shard_id, r.size) for r in sh.shard_sizes_from_metadata(ok).orderBy("shard_id").collect()] == [(0, 64), (1, 36)]


def test_rank_shards_shuffle_is_deterministic_per_epoch(spark, manifest):
    m, _ = manifest
    shards = sh.assign_shards(m, 16)

    def plan(epoch):
        return sorted(tuple(r) for r in sh.rank_shards(shards, 3, epoch=epoch, shuffle=True).collect())
    assert plan(1) == plan(1)
    assert plan(1) != plan(2)


def test_step_budget_zero_steps_fails(spark):
    counts = spark.createDataFrame([("text", 5)], "group_name string, num_rows long")
    with pytest.raises(Exception, match="no full step"):
        sh.step_budget(counts, batch_size=12, world_size=1).collect()
    row = sh.step_budget(counts, batch_size=12, drop_last=False, epochs=2.5, warmup_ratio=0.1).collect()[0]
    assert (row.micro_steps_per_epoch, row.optimizer_steps_per_epoch, row.max_steps, row.warmup_steps) == (1, 1, 3, 1)


def test_caption_sources_shapes(spark):
    from pairforge.sources.tables import caption_pairs, chat_caption_pairs
    structs = spark.createDataFrame(
        [(0, "a.jpg", None, {"raw": "cap a"}), (1, "", "b.jpg", {"raw": "cap b"}), (2, "c.jpg", None, {"raw": ""}),
         (3, "/abs/d.jpg", None, {"raw": "cap d"})],
        "k long, filename string, filepath string, sentences struct<raw: string>")
    got = {r.k: (r.query_value, r.positive_value) for r in caption_pairs(structs, image_root="/img").collect()}
    assert got == {0: ("/img/a.jpg", "cap a"), 1: ("/img/b.jpg", "cap b"), 3: ("/abs/d.jpg", "cap d")}
    arrays = spark.createDataFrame([(0, "a.jpg", [{"raw": "first"}, {"raw": "second"}]), (1, "b.jpg", [])],
                                   "k long, filename string, sentences array<struct<raw: string>>")
    assert [(r.k, r.positive_value) for r in caption_pairs(arrays).collect()] == [(0, "first")]
    strings = spark.createDataFrame([(0, "a.jpg", ["s0", "s1"])], "k long, filename string, sentences array<string>")
    assert caption_pairs(strings).collect()[0].positive_value == "s0"
    # limit before the filter: the first two rows are taken, one of them has no caption
    assert caption_pairs(structs, limit=3).count() == 2
    chats = spark.createDataFrame(
        [(0, "x.jpg", [{"from": "human", "value": "q"}, {"from": "gpt", "value": ""}, {"from": "gpt", "value": "ans"}]),
         (1, "", [{"from": "gpt", "value": "no image"}]), (2, "z.jpg", [{"from": "human", "value": "only"}])],
        "k long, image string, conversations array<struct<from: string, value: string>>")
    got = [(r.k, r.query_value, r.positive_value) for r in chat_caption_pairs(chats).collect()]
    assert got == [(0, "x.jpg", "ans")]


def test_transcript_splits_concatenate(spark):
    from pairforge.sources.tables import transcript_pairs
    a = spark.createDataFrame([(0, "x"), (1, "")], "k long, text string")
    b = spark.createDataFrame([(0, "y"), (5, "z")], "k long, text string")
    got = [(r.query_value, r.positive_value) for r in transcript_pairs([a, b], "librispeech_clean").collect()]
    assert sorted(got) == [("librispeech_000000.wav", "x"), ("librispeech_000002.wav", "y"),
                           ("librispeech_000003.wav", "z")]
    limited = sorted(r.query_value for r in transcript_pairs([a, b], "librispeech_clean", limit=3).collect())
    assert limited == ["librispeech_000000.wav", "librispeech_000002.wav"]  # limit before the empty-text filter


def test_resolve_shard_sizes_fallback(spark, manifest):
    m, rows = manifest
    shards = sh.assign_shards(m, 64)
    n = len(rows)
    good = spark.createDataFrame([(n, -(-n // 64), 64)], "num_records long, num_shards long, shard_size long")
    bad = spark.createDataFrame([(n, 99, 64)], "num_records long, num_shards long, shard_size long")
    counted = sorted(tuple(r) for r in sh.shard_counts(shards).collect())
    assert sorted(tuple(r) for r in sh.resolve_shard_sizes(good, shards).collect()) == counted
    assert sorted(tuple(r) for r in sh.resolve_shard_sizes(bad, shards).collect()) == counted
    assert sh.resolve_shard_sizes(None, shards).count() == len(counted)


def test_pluggable_tokenizer_and_encoder(spark, manifest):
    import numpy as np
    from pairforge.operators import features as feat
    m, rows = manifest
    toks = feat.tokenize_with(m.select("idx", "query_value"), "query_value",
                              lambda texts: [[len(w) for w in t.split()] for t in texts], max_len=3)
    got = {r.idx: list(r.input_ids) for r in toks.collect()}
    assert got == {r.idx: [len(w) for w in r.query_value.split()][:3] for r in rows}
    emb = feat.encode_items(m, encoders={"image": lambda vals: np.ones((len(vals), 4))}, dim=8, missing="null")
    got = {(r.idx, r.role, r.modality): r.embedding for r in emb.collect()}
    assert all(abs(float(np.linalg.norm(v)) - 1.0) < 1e-9 for k, v in got.items() if k[2] == "image")
    audio = [v for k, v in got.items() if k[2] == "audio"]
    assert audio and all(v is None for v in audio)  # no audio encoder given: the items stay, without a vector


def test_locate_uniform_and_missing_report(spark, manifest):
    m, rows = manifest
    pos = spark.createDataFrame([(0,), (63,), (64,), (len(rows) - 1,)], "position long")
    got = {r.position: (r.shard_id, r.local_pos) for r in sh.locate_uniform(pos, 64, len(rows)).collect()}
    assert got == {0: (0, 0), 63: (0, 63), 64: (1, 0), len(rows) - 1: ((len(rows) - 1) // 64, (len(rows) - 1) % 64)}
    with pytest.raises(Exception, match="out of range"):
        sh.locate_uniform(spark.createDataFrame([(len(rows),)], "position long"), 64, len(rows)).collect()
    inv = spark.createDataFrame([(r.query_value,) for r in rows if r.query_type != "text"][::2], "path string")
    head, total = media_ops.missing_media_report(m, inv)
    media_items = [(r.idx, r.query_value) for r in rows if r.query_type != "text"]
    kept = {p for (p,) in [(r.query_value,) for r in rows if r.query_type != "text"][::2]}
    want = [(i, p) for i, p in media_items if p not in kept]
    assert total == len(want)
    assert [(r.idx, r.path) for r in head] == want[:20]
