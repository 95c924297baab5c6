"""J3/J4/J5 invariants on hand-made media, S3 readiness on FX12-like events, stream = batch."""

import os
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import features as feat
from pairforge.streaming import jobs as stream


def _png(path, pixels):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\x00" + bytes(c for px in row for c in px) for row in pixels)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_tensor_from_png(spark, tmp_path):
    _png(str(tmp_path / "a.png"), [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (255, 255, 255)]])
    row = feat.image_tensors(spark, str(tmp_path), size=2).collect()[0]
    t = np.asarray(row.tensor.data).reshape(row.tensor.shape)
    assert list(row.tensor.shape) == [3, 2, 2]
    # RGB order restored from Spark's BGR, /255, (x - 0.5) / 0.5
    assert t[0, 0, 0] == pytest.approx(1.0) and t[1, 0, 0] == pytest.approx(-1.0)
    assert t[2, 1, 0] == pytest.approx(1.0) and t[:, 1, 1] == pytest.approx([1.0, 1.0, 1.0])


def test_bilinear_constant_image_is_constant():
    img = np.full((5, 7, 3), 0.25)
    assert np.allclose(feat.resize_bilinear(img, 4), 0.25)


def _wav(path, seconds, freq=440.0, rate=16000):
    t = np.arange(int(seconds * rate)) / rate
    data = (np.sin(2 * np.pi * freq * t) * 0.5 * 32767).astype("<i2").tobytes()
    with wave.open(path, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(data)


def test_wav_fix_and_log_mel(spark, tmp_path):
    _wav(str(tmp_path / "short.wav"), 0.5)
    _wav(str(tmp_path / "long.wav"), 31)
    with open(tmp_path / "bad.wav", "wb") as f:
        f.write(b"RIFF\x00\x00")
    w = feat.read_wav(spark, str(tmp_path))
    rows = {os.path.basename(r.path): r for r in w.collect()}
    assert rows["bad.wav"].error.startswith("unreadable")
    fixed = {os.path.basename(r.path): r for r in feat.fix_waveform(w.where("error IS NULL")).collect()}
    assert all(len(r.waveform) == feat.WAVE_SAMPLES for r in fixed.values())
    assert fixed["short.wav"].waveform[-1] == 0.0
    mel = feat.log_mel_array(np.asarray(fixed["short.wav"].waveform))
    assert mel.shape == (80, 3000)
    assert mel.max() - mel.min() <= 2.0 + 1e-6  # floor at max - 8 in log10, then /4
    fb = feat.mel_filters()
    peak_bin = int(np.argmax(fb[:, int(round(440 / 8000 * 200))]))
    assert int(np.argmax(mel[:, 10])) == peak_bin


def test_ready_dirs_fx12(spark, tmp_path):
    rows = [("a", "model.pt", "2024-01-01 00:00:01"), ("b", "config.json", "2024-01-01 00:00:02"),
            ("a", "config.json", "2024-01-01 00:00:03"), ("a", "config.json", "2024-01-01 00:00:04")]
    ev = spark.createDataFrame(rows, "dir string, name string, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch = {r.dir: r.ready_ts for r in stream.ready_dirs(ev, ["model.pt", "config.json"]).collect()}
    assert set(batch) == {"a"}
    src = str(tmp_path / "events")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "dir string, name string, ts string").withColumn(
            "ts", F.to_timestamp("ts")).write.parquet(f"{src}/f{i}")
    got = stream.stream_ready(spark, f"{src}/*", "dir string, name string, ts timestamp",
                              ["model.pt", "config.json"], str(tmp_path / "out"), files_per_trigger=1)
    assert {r.dir: r.ready_ts for r in got.collect()} == batch


def test_featurize_scatters_all_modalities(spark, tmp_path):
    img_root, wav_root = tmp_path / "img", tmp_path / "wav"
    img_root.mkdir()
    wav_root.mkdir()
    _png(str(img_root / "a.png"), [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (255, 255, 255)]])
    _wav(str(wav_root / "s.wav"), 0.25)
    rows = [(0, "image", "a.png", "text", "red green", "text", "blue"),
            (1, "audio", "s.wav", "text", "a tone", None, None),
            (2, "image", "missing.png", "text", "none", None, None)]
    df = spark.createDataFrame(rows, "idx long, query_type string, query_value string, positive_type string, "
                                     "positive_value string, negative_type string, negative_value string")
    out = {(r.idx, r.role): r for r in feat.featurize(df, str(img_root), str(wav_root), image_size=4).collect()}
    assert len(out) == 7
    assert list(out[(0, "query")].tensor.shape) == [3, 4, 4]
    assert list(out[(1, "query")].log_mel.shape) == [80, 3000]
    assert out[(2, "query")].tensor is None  # missing media: NULL feature
    assert len(out[(0, "positive")].input_ids) == 2 and len(out[(0, "negative")].input_ids) == 1


def test_normalize_payload_counts_and_all_null(spark):
    df = spark.createDataFrame([(1, ("t", None, None, None)), (2, (None, None, None, None)),
                                (3, (None, "i.jpg", None, "v.mp4"))],
                               "idx int, p struct<text: string, image: string, audio: string, video: string>")
    got = {r.idx: (dict(r.p_fields), r.num_images, r.num_videos) for r in feat.normalize_payload(df, "p").collect()}
    assert got[1] == ({"text": "t"}, 0, 0)
    assert got[2] == ({"text": None, "image": None, "audio": None, "video": None}, 0, 0)
    assert got[3] == ({"image": "i.jpg", "video": "v.mp4"}, 1, 1)


def test_ready_fires_once_with_bounded_state(spark, tmp_path):
    rows = [("a", "model.pt", "2024-01-01 00:00:01"), ("b", "config.json", "2024-01-01 00:00:02"),
            ("a", "config.json", "2024-01-01 00:00:03"), ("a", "config.json", "2024-01-01 00:00:04"),
            ("c", "config.json", "2024-01-01 00:00:05"), ("c", "model.pt", "2024-01-01 00:00:06")]
    src = str(tmp_path / "events")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "dir string, name string, ts string").withColumn(
            "ts", F.to_timestamp("ts")).write.parquet(f"{src}/f{i}")
    out = stream.stream_ready_once(spark, f"{src}/*", "dir string, name string, ts timestamp",
                                   ["model.pt", "config.json"], str(tmp_path / "out"), files_per_trigger=1)
    got = sorted((r.dir, str(r.ready_ts)) for r in spark.read.parquet(out).collect())
    ev = spark.createDataFrame(rows, "dir string, name string, ts string").withColumn("ts", F.to_timestamp("ts"))
    want = sorted((r.dir, str(r.ready_ts)) for r in stream.ready_dirs(ev, ["model.pt", "config.json"]).collect())
    assert got == want == [("a", "2024-01-01 00:00:03"), ("c", "2024-01-01 00:00:06")]  # each fired exactly once


def test_ready_fires_once_whatever_comes_later(spark, tmp_path):
    """A directory whose files all come again, after its state is gone and after a restart, doesn't fire a second time; one
    whose files are further apart than the ttl doesn't fire."""
    src, out, ckpt = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def add(*rows):
        spark.createDataFrame(list(rows), "dir string, name string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)

    def run():
        return stream.stream_ready_once(spark, src, "dir string, name string, ts timestamp", ["m", "c"], out, watermark="1 hour", ttl="2 hours",
                                        checkpoint=ckpt, files_per_trigger=1)
    add(("a", "m", "2024-01-01 00:00:00"), ("a", "c", "2024-01-01 00:10:00"), ("late", "m", "2024-01-01 00:00:00"))
    add(("z", "m", "2024-01-02 00:00:00"))
    run()
    add(("a", "m", "2024-01-03 00:00:00"), ("a", "c", "2024-01-03 00:00:00"), ("late", "c", "2024-01-03 00:00:00"))
    add(("z", "c", "2024-01-02 00:30:00"))
    run()
    run()  # nothing new
    got = sorted((r.dir, str(r.ready_ts)) for r in spark.read.parquet(out).collect())
    assert got == [("a", "2024-01-01 00:10:00"), ("z", "2024-01-02 00:30:00")]


def test_source_build_goes_on_after_a_restart(spark, tmp_path):
    """Rows are numbered over all files, empty texts too; a replayed batch overwrites its own records; negatives come at the end."""
    src, out, ckpt = str(tmp_path / "rows"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    parts = [[(1, "s", "a"), (0, "s", "b"), (2, "t", "only")], [(3, "s", ""), (5, "s", "c"), (4, "s", None)], [], [(6, "s", "d"), (7, None, "x")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "k long, source string, text string").coalesce(1).write.mode("append").parquet(src)
        if i in (0, 2, 3):
            stream.stream_build_source(spark, src, "k long, source string, text string", out, ckpt)
    rows = sorted(stream.built_source(spark, out).collect(), key=lambda r: (r.source, r.row_index))
    assert [(r.source, r.k, r.query_value, r.positive_value, r.negative_value) for r in rows] == [
        ("", 7, "_000000.wav", "x", None), ("s", 0, "s_000000.wav", "b", "a"), ("s", 1, "s_000001.wav", "a", "c"),
        ("s", 5, "s_000004.wav", "c", "d"), ("s", 6, "s_000005.wav", "d", "b"), ("t", 2, "t_000000.wav", "only", None)]
    earlier = stream._before(spark, f"{out}/counters", 1).collect()
    assert {(r.source, r.rows) for r in earlier} == {("s", 2), ("t", 1)}


def test_mel_filters_are_htk_without_normalisation():
    """Hand values: 2595 log10(1 + f / 700) puts 8 kHz at 2840.023 mel; the 82 points are 35.0620 mel apart, so filter 0 peaks
    at 22.125 - no FFT bin (40 Hz apart) - and filter 40 between its edges at mel 1402.48, 1437.54 and 1472.60."""
    fb = feat.mel_filters()
    step = 2595 * np.log10(1 + 8000 / 700) / 81
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    assert abs(step * 81 - 2840.0230467) < 1e-6
    lo, mid, hi = hz(40 * step), hz(41 * step), hz(42 * step)
    for k in range(201):
        f = 40.0 * k
        assert abs(fb[40, k] - max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid)))) < 1e-9
    assert fb.max() <= 1.0 and fb[70:].max() > 0.8


def test_log_mel_floor_uses_all_frames():
    """A loud end beyond 3,000 frames sets the floor for the frames that are kept."""
    quiet = np.random.default_rng(0).normal(0, 1e-4, 480_000)
    loud = np.concatenate([quiet, np.sin(np.arange(16_000) * 0.3)])
    assert feat.log_mel_array(loud).min() > feat.log_mel_array(quiet).min()


def test_unreadable_images_and_sizes(spark, tmp_path):
    _png(str(tmp_path / "a.png"), [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (255, 255, 255)]])
    (tmp_path / "bad.png").write_bytes(b"not an image")
    rows = {os.path.basename(r.path): r for r in feat.image_tensors(spark, str(tmp_path), size=(2, 5)).collect()}
    assert list(rows["a.png"].tensor.shape) == [3, 2, 5] and rows["a.png"].error is None
    assert rows["bad.png"].tensor is None and rows["bad.png"].error


def test_items_are_read_once_for_all_encoders(spark):
    """One scan of the records, whatever the number of encoders; each gets its own values only, text by bucket."""
    df = spark.createDataFrame([(i, "image", f"{i}.png", "text", "red red blue" if i else "", "audio", "t.wav") for i in range(6)],
                               "idx long, query_type string, query_value string, positive_type string, positive_value string, negative_type string, negative_value string")

    def image(values):
        assert all(v.endswith(".png") for v in values)
        return [[len(v), 0.0] for v in values]

    def audio(values):
        assert set(values) == {"t.wav"}
        return [[3.0, 4.0]] * len(values)
    got = feat.encode_items(df, {"image": image, "audio": audio}, dim=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Union" not in plan
    rows = {(r.idx, r.role): r.embedding for r in got.collect()}
    assert len(rows) == 18 and rows[0, "negative"] == [0.6, 0.8] and rows[2, "query"] == [1.0, 0.0] and set(rows[0, "positive"]) == {0.0}
    two = sorted(x for x in rows[1, "positive"] if x)
    assert np.allclose(two, [1 / 5 ** 0.5, 2 / 5 ** 0.5]) or np.allclose(two, [1.0])
    one = {w: feat.hashed_embedding(spark.createDataFrame([(w,)], "t string"), "t", dim=16).first().embedding.index(1.0) for w in ("red", "blue")}
    assert one["red"] == one["blue"] or (rows[1, "positive"][one["red"]] > rows[1, "positive"][one["blue"]] > 0)


def test_no_item_is_dropped_without_encoder_or_root(spark):
    df = spark.createDataFrame([(0, "image", "a.png", "text", "red", "text", "blue"), (1, "audio", "s.wav", "text", "tone", None, None)],
                               "idx long, query_type string, query_value string, positive_type string, "
                               "positive_value string, negative_type string, negative_value string")
    with pytest.raises(Exception, match="no encoder for modality"):
        feat.encode_items(df).collect()
    kept = feat.encode_items(df, missing="null").collect()
    assert len(kept) == 5 and sum(r.embedding is None for r in kept) == 2
    assert len(feat.featurize(df).collect()) == 5


def test_log_mel_of_rows(spark):
    """Rows without waveform, samples that are null and other columns stay; results come as Arrow batches, not as objects."""
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 5 == 3 else [float(x) for x in rng.normal(size=10 + 300 * i).astype(np.float32)], f"r{i}") for i in range(20)]
    rows[4][1][2] = None
    df = spark.createDataFrame(rows, "k long, waveform array<float>, name string").coalesce(1)
    out = feat.log_mel(df)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: r for r in out.collect()}
    assert len(got) == 20
    for k, w, name in rows:
        assert got[k].name == name and (got[k].log_mel is None) == (w is None)
        if w is not None:
            want = feat.log_mel_array(np.array([np.nan if x is None else x for x in w], np.float32))
            assert list(got[k].log_mel.shape) == [80, 3000] and np.array_equal(np.array(got[k].log_mel.data, np.float32), want.reshape(-1), equal_nan=True)
