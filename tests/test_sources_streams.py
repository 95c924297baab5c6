"""A6 inventory, B0b append, distributed running sum, S1/S2/S4 stream result = batch result."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF0001
from pairforge.operators.index import running_sum
from pairforge.operators.media import count_images
from pairforge.operators.summary import summarize_manifest
from pairforge.plans.manifests import training_manifest
from pairforge.sources.manifest import append_manifest, read_manifest, write_manifest
from pairforge.sources.media import media_inventory
from pairforge.streaming import jobs as stream

FIELDS = ["query_type", "query_value", "positive_type", "positive_value", "negative_type", "negative_value", "source"]


def _rows(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def test_media_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.JPG").write_bytes(b"x")
    (tmp_path / "sub" / "b.png").write_bytes(b"yy")
    (tmp_path / "c.wav").write_bytes(b"z")
    inv = media_inventory(spark, str(tmp_path), recursive=True)
    assert sorted((r.path, r.length) for r in inv.collect()) == [("a.JPG", 1), ("c.wav", 1), ("sub/b.png", 2)]
    assert count_images(inv).collect()[0].num_images == 2
    assert media_inventory(spark, str(tmp_path / "missing")).count() == 0
    assert sorted(r.path for r in media_inventory(spark, str(tmp_path)).collect()) == ["a.JPG", "c.wav"]  # one folder


def test_running_sum_matches_window(spark):
    d = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "n_chars")
    got = {r.doc_id: r.running for r in running_sum(d, ["doc_id"], "n_chars", num_partitions=5).collect()}
    want = {r.doc_id: r.c for r in d.select("doc_id", F.sum("n_chars").over(Window.orderBy("doc_id")).alias("c")).collect()}
    assert got == want


def test_append_is_noop_on_empty(spark, tmp_path):
    m = training_manifest(spark, SF0001).df
    path = str(tmp_path / "app")
    assert append_manifest(m.where(F.lit(False)), path) is False
    assert append_manifest(m.where("group_name = 'text'"), path)
    assert append_manifest(m.where("group_name <> 'text'"), path)
    assert _rows(read_manifest(spark, path).records) == _rows(m)


@pytest.mark.parametrize("name", ["a1_read_manifest", "b0b_append_manifest"])
def test_scratch_manifests_are_compressed(spark, tmp_path, monkeypatch, name):
    """The manifest that a query writes and reads back takes less than half the bytes of its lines, and no row changes."""
    from pairforge.plans import registry

    monkeypatch.setattr(registry, "scratch_path", lambda spark, name: str(tmp_path / name))
    records = registry.QUERIES[name](spark, SF0001)
    cols = records.columns
    want = training_manifest(spark, SF0001).df.select(*cols)
    assert sorted(map(repr, records.collect())) == sorted(map(repr, want.collect()))
    lines = spark.read.text(str(tmp_path / "*")).agg(F.count("value"), F.sum(F.octet_length("value"))).first()
    files = [f for d in tmp_path.iterdir() for f in d.glob("part-*")]
    assert lines[0] == records.count() and sum(f.stat().st_size for f in files) < 0.5 * lines[1]


def test_streams_equal_batch(spark, tmp_path):
    m = training_manifest(spark, SF0001).df
    src = tmp_path / "in"
    for i, g in enumerate(("text", "image", "audio")):
        write_manifest(m.where(F.col("group_name") == g), str(src / f"p{i}"))
    pattern = str(src / "*")
    s1 = spark.read.parquet(stream.stream_manifest(spark, pattern, str(tmp_path / "s1"), allowed=["text", "image"]))
    assert _rows(s1) == _rows(m.where("query_type <> 'audio'"))
    s2 = spark.read.parquet(stream.stream_append(spark, pattern, str(tmp_path / "s2"), files_per_trigger=1))
    assert _rows(s2) == _rows(m)
    s4 = stream.stream_summary(spark, pattern, str(tmp_path / "s4"), allowed=["text", "image"],
                               files_per_trigger=1).collect()[0]
    e1 = summarize_manifest(m, allowed=["text", "image"]).collect()[0]
    for c in ("num_rows", "num_negatives_present", "num_negatives_missing", "skipped_rows", "has_uniform_negatives"):
        assert s4[c] == e1[c], c
    assert list(s4.modalities) == list(e1.modalities)


def test_stream_append_resumes_from_checkpoint(spark, tmp_path):
    m = training_manifest(spark, SF0001).df
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    write_manifest(m.where("group_name = 'text'"), str(src / "p0"))
    stream.stream_append(spark, str(src / "*"), out, checkpoint=ckpt)
    first = spark.read.parquet(out).count()
    write_manifest(m.where("group_name <> 'text'"), str(src / "p1"))
    stream.stream_append(spark, str(src / "*"), out, checkpoint=ckpt)  # restart: only the new files
    res = spark.read.parquet(out)
    assert first == m.where("group_name = 'text'").count()
    assert _rows(res.drop("batch_id")) == _rows(m)
    assert res.select("batch_id").distinct().count() >= 2


def test_write_shards_rewrites_only_its_shards(spark, tmp_path):
    from pairforge.sources.shards_io import read_shard_metadata, read_shards, write_shards
    m = training_manifest(spark, SF0001).df
    path = str(tmp_path / "shards")
    n = m.count()
    assert write_shards(m, path, 64, total=n) == -(-n // 64)
    before = {r.shard_id: r["count"] for r in read_shards(spark, path).groupBy("shard_id").count().collect()}
    write_shards(m.where("idx < 64"), path, 64, total=n)  # a resumed job rewriting shard 0 only
    after = read_shards(spark, path)
    assert {r.shard_id: r["count"] for r in after.groupBy("shard_id").count().collect()} == before
    assert _rows(after) == _rows(m)
    assert read_shard_metadata(spark, path).collect()[0].num_shards == -(-n // 64)


def test_corrupt_shard_fails_and_is_skipped_only_on_request(spark, tmp_path):
    import glob

    from pairforge.sources.shards_io import read_shards, verify_shards, write_shards
    path = str(tmp_path / "shards")
    write_shards(spark.range(30).withColumnRenamed("id", "idx"), path, 10, pack_shards=1)
    assert {(r.shard_id, r.num_records, r.found, r.ok) for r in verify_shards(spark, path).collect()} == {(i, 10, 10, True) for i in range(3)}
    part = sorted(glob.glob(f"{path}/records/write=*/pack=1/*.parquet"))[0]
    with open(part, "wb") as f:
        f.write(b"damaged")
    with pytest.raises(Exception):  # noqa: B017 - the reader's own error
        read_shards(spark, path).collect()
    assert {r.shard_id for r in read_shards(spark, path, skip_unreadable=True).collect()} == {0, 2}
    assert {(r.shard_id, r.found, r.ok) for r in verify_shards(spark, path).collect()} == {(0, 10, True), (1, 0, False), (2, 10, True)}
    write_shards(spark.range(10, 20).withColumnRenamed("id", "idx"), path, 10, total=30)  # the bad shard again
    assert sorted(r.idx for r in read_shards(spark, path).where("shard_id = 1").collect()) == list(range(10, 20))
    write_shards(spark.range(10).withColumnRenamed("id", "idx"), path, 10)
    assert {r.shard_id for r in read_shards(spark, path).collect()} == {0}  # shards of the larger write are ignored


def test_shards_share_files_and_commit_by_their_log(spark, tmp_path):
    """Folders and files don't follow the number of shards; a changed value is found by checksum; records without a log aren't seen."""
    import glob
    import shutil

    from pairforge.sources.shards_io import read_shards, shard_log, verify_shards, write_shards
    path = str(tmp_path / "shards")
    with pytest.raises(FileNotFoundError):
        read_shards(spark, path)
    rows = spark.range(500).select(F.col("id").alias("idx"), F.concat(F.lit("v"), "id").alias("v"), F.create_map(F.lit("k"), "id").alias("m"))
    assert write_shards(rows, path, 5) == 100
    assert len(glob.glob(f"{path}/records/write=*/pack=*")) == 1 and len(glob.glob(f"{path}/records/write=*/pack=*/*.parquet")) <= 8
    assert {(r.shard_id, r.num_records) for r in shard_log(spark, path).collect()} == {(i, 5) for i in range(100)}
    assert sorted((r.idx, r.v, r.shard_pos) for r in read_shards(spark, path).where("shard_id = 7").collect()) == [(i, f"v{i}", i % 5) for i in range(35, 40)]
    # another value in one record of shard 3, in files that read well
    folder = glob.glob(f"{path}/records/write=*/pack=0")[0]
    changed = spark.read.parquet(folder).withColumn("v", F.when(F.col("idx") == 17, F.lit("x")).otherwise(F.col("v")))
    changed.write.parquet(str(tmp_path / "changed"))
    spark.read.parquet(str(tmp_path / "changed")).write.mode("overwrite").parquet(folder)
    assert not verify_shards(spark, path).where("shard_id = 3").first().ok
    # a write that stopped before its log
    write_shards(rows.where("idx < 5").withColumn("v", F.lit("new")), str(tmp_path / "other"), 5)
    shutil.copytree(glob.glob(f"{tmp_path}/other/records/write=*")[0], f"{path}/records/write=9999999999999999")
    assert read_shards(spark, path).where("v = 'new'").isEmpty()


def test_checkpoint_folder_is_required_off_local():
    from types import SimpleNamespace

    from pairforge.session import checkpoint_root
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, applicationId="none", master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(conf=conf, sparkContext=sc))


def test_line_numbers_move_no_lines(spark, tmp_path):
    """The only shuffles below the line numbers are of one row per file split."""
    from pairforge.sources.manifest import physical_lines
    for i in range(3):
        (tmp_path / f"f{i}.jsonl").write_text("".join(f"line {j}\n" if j % 4 else "\n" for j in range(50 + i)))
    lines = physical_lines(spark, str(tmp_path))
    got = sorted((r.file[-8:], r.line_no, r.line) for r in lines.collect())
    assert got == sorted((f"f{i}.jsonl", j + 1, f"line {j}" if j % 4 else "") for i in range(3) for j in range(50 + i))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "BroadcastHashJoin" in plan


def test_skeleton_carries_no_text(spark):
    """Without values no text enters an index: the transcripts' scan reads neither the checkpoint nor the join with it."""
    from pairforge.plans.fixtures import fx_transcripts
    from pairforge.sources.tables import transcript_pairs
    rows = transcript_pairs(fx_transcripts(spark, SF0001), "transcripts", source_col="source", values=False)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.replace("positive_value", "") or "AS _text" in plan
    assert rows.where("positive_value is not null").count() == 0
    full = transcript_pairs(fx_transcripts(spark, SF0001), "transcripts", source_col="source")
    assert sorted(r.query_value for r in full.collect()) == sorted(r.query_value for r in rows.collect())


def test_feature_shards_with_media(spark, tmp_path):
    import wave

    import numpy as np

    from pairforge.sources.shards_io import read_payloads, read_shard_metadata, write_feature_shards
    wavs = tmp_path / "wav"
    wavs.mkdir()
    with wave.open(str(wavs / "s.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes((np.sin(np.arange(4000) * 0.2) * 9000).astype("<i2").tobytes())
    rows = [(0, "audio", "s.wav", "text", "a tone here", None, None), (1, "text", "b c", "text", "d", "text", "e f g"),
            (2, "audio", "none.wav", "text", "x", None, None)]
    df = spark.createDataFrame(rows, "idx long, query_type string, query_value string, positive_type string, "
                                     "positive_value string, negative_type string, negative_value string")
    path = str(tmp_path / "shards")
    assert write_feature_shards(df, path, 2, audio_root=str(wavs), metadata={"device": "cpu"}) == 2
    tokens = {r.idx: r for r in read_payloads(spark, path, "input_ids").collect()}
    assert len(tokens[0].positive_input_ids) == 3 and tokens[0].query_input_ids is None and len(tokens[1].negative_input_ids) == 3
    mels = {r.idx: r.query_log_mel for r in read_payloads(spark, path, "log_mel", roles=("query",)).collect()}
    assert list(mels[0].shape) == [80, 3000] and mels[2] is None
    meta = read_shard_metadata(spark, path).first()
    assert (meta.num_records, meta.num_shards, meta.device, meta.max_text_length, meta.manifest) == (3, 2, "cpu", 32768, None)


def test_stream_input_is_written_in_one_pass(spark, tmp_path):
    """A manifest in folders, and rows in the order they lie in, without a shuffle a folder."""
    from pyspark.sql import functions as F

    from pairforge.sources.manifest import read_manifest, write_manifest

    df = spark.createDataFrame([(i, "text", f"q{i}", "text", f"p{i}", None, None, "s", "ab"[i % 2]) for i in range(10)],
                               "idx long, query_type string, query_value string, positive_type string, positive_value string, "
                               "negative_type string, negative_value string, source string, part string").coalesce(1)
    write_manifest(df, str(tmp_path / "m"), order=None, folders=["part"])
    got = {p: [r.query_value for r in read_manifest(spark, str(tmp_path / "m" / f"part={p}")).records.orderBy("idx").collect()] for p in "ab"}
    assert got == {"a": [f"q{i}" for i in range(0, 10, 2)], "b": [f"q{i}" for i in range(1, 10, 2)]}
    records = stream.stream_append(spark, str(tmp_path / "m" / "*"), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.parquet(records).select("query_value").collect()) == sorted(f"q{i}" for i in range(10))
    assert spark.read.parquet(records).where(F.col("source") != "s").isEmpty()


def test_build_source_takes_all_files_of_a_part(spark, tmp_path):
    """A part that arrived as many files is one micro-batch, numbered as one, so no task has to read or write it whole."""
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for part in range(2):
        rows = spark.createDataFrame([(k, "s", f"t{k}") for k in range(20 * part, 20 * part + 20)], "k long, source string, text string")
        rows.repartition(4).write.mode("append").parquet(src)
        stream.stream_build_source(spark, src, "k long, source string, text string", out, ckpt, files_per_trigger=None)
    got = spark.read.parquet(f"{out}/records")
    assert got.select("batch_id").distinct().count() == 2
    assert sorted((r.k, r.row_index) for r in got.collect()) == [(k, k) for k in range(40)]
