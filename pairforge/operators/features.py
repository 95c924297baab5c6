"""Feature preparation as partition-parallel jobs: J1 tokenize, J2 pad, J3 image tensors, J4 fixed-length
waveform, J5 log-mel, J6 payload normalisation, J7 featurize by modality, K1 encode.

Text work is built-in (split, xxhash64, slice, array_repeat). Image and audio maths run in ``mapInPandas``
with numpy (torch/PIL/librosa are not assumed); Spark decodes images with its ``image`` source and reads WAV
bytes with ``binaryFile``.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pairforge.session import ship_package
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.operators.records import ROLES, unpivot_items

# Reference feature settings.
MAX_TEXT_TOKENS = 32768
SAMPLE_RATE = 16000
WAVE_SAMPLES = 480000  # 30 s at 16 kHz
N_FFT, HOP, N_MELS, N_FRAMES = 400, 160, 80, 3000
IMAGE_SIZE, IMAGE_MEAN, IMAGE_STD = 384, 0.5, 0.5
VOCAB = 1 << 20  # our hashing tokenizer's id space


def words(text) -> F.Column:
    """Whitespace tokens of a text (no empty tokens)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(t, F.lit("")), r"\s+"), "")


def tokenize(df: DataFrame, text_col: str, max_len: int = MAX_TEXT_TOKENS, prefix: str = "") -> DataFrame:
    """J1 (default hashing tokenizer): ids = pmod(xxhash64(word), VOCAB) + 1, truncated to ``max_len``, no
    padding; attention mask of ones. Adds ``{prefix}input_ids``, ``{prefix}attention_mask``,
    ``{prefix}n_tokens`` and ``{prefix}truncated``."""
    w = words(text_col)
    ids = F.transform(w, lambda x: (F.pmod(F.xxhash64(x), F.lit(VOCAB)) + 1).cast("int"))
    return (df.withColumn(f"{prefix}n_words", F.size(w))
              .withColumn(f"{prefix}input_ids", F.slice(ids, 1, max_len))
              .withColumn(f"{prefix}n_tokens", F.size(f"{prefix}input_ids"))
              .withColumn(f"{prefix}attention_mask", F.array_repeat(F.lit(1), F.col(f"{prefix}n_tokens")))
              .withColumn(f"{prefix}truncated", F.col(f"{prefix}n_words") > max_len)
              .drop(f"{prefix}n_words"))


def tokenize_with(df: DataFrame, text_col: str, encode: Callable[[list[str]], list[list[int]]],
                  max_len: int = MAX_TEXT_TOKENS) -> DataFrame:
    """J1 with a pluggable tokenizer (e.g. a ``tokenizers`` object loaded in the worker): one call per Arrow
    batch in ``mapInPandas``; truncation to ``max_len``."""
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField("input_ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for pdf in batches:
            ids = encode(pdf[text_col].fillna("").tolist())
            pdf = pdf.copy()
            pdf["input_ids"] = [list(x)[:max_len] for x in ids]
            yield pdf
    return df.mapInPandas(run, schema)


def pad_tokens(df: DataFrame, batch_col: str = "batch_id", ids_col: str = "input_ids",
               mask_col: str = "attention_mask") -> DataFrame:
    """Pad every sequence of a batch to the batch's longest with 0 (ids and mask). A window over the batch (bounded by
    its size) finds the longest, so the sequences are made and shuffled once."""
    from pyspark.sql import Window
    j = df.withColumn("_pf_max", F.max(F.size(ids_col)).over(Window.partitionBy(batch_col)))
    j = j.withColumn("_pf_pad", F.greatest(F.col("_pf_max") - F.size(ids_col), F.lit(0)))
    return (j.withColumn(ids_col, F.concat(ids_col, F.array_repeat(F.lit(0), F.col("_pf_pad"))))
             .withColumn(mask_col, F.concat(mask_col, F.array_repeat(F.lit(0), F.col("_pf_pad"))))
             .withColumnRenamed("_pf_max", "padded_len").drop("_pf_pad"))


def fix_waveform(df: DataFrame, wave_col: str = "waveform", n: int = WAVE_SAMPLES) -> DataFrame:
    """Truncate or zero-pad to exactly ``n`` samples (30 s at 16 kHz by default)."""
    w = F.transform(F.col(wave_col), lambda x: x.cast("float"))
    pad = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(n) - F.size(w), F.lit(0)))
    return df.withColumn(wave_col, F.slice(F.concat(w, pad), 1, n))


def read_wav(spark, path: str) -> DataFrame:
    """Audio input: ``binaryFile`` scan -> (path, sample_rate, waveform float32 mono in [-1, 1], error).
    16-bit PCM WAV only; anything else is quarantined with a reason."""
    ship_package(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, sample_rate int, waveform array<float>, error string"

    def decode(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    with wave.open(io.BytesIO(bytes(content))) as w:
                        if w.getsampwidth() != 2:
                            raise ValueError("only 16-bit PCM is supported")
                        frames = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(np.float32)
                        ch = w.getnchannels()
                        if ch > 1:
                            frames = frames.reshape(-1, ch).mean(axis=1)
                        rate = w.getframerate()
                    err = None if rate == SAMPLE_RATE else f"sample rate {rate} is not {SAMPLE_RATE}"
                    row = (p, rate, frames / np.float32(32768.0), err)
                except Exception as e:  # noqa: BLE001 - quarantined with its reason
                    row = (p, None, None, f"unreadable audio: {e}")
                yield pd.DataFrame([row], columns=["path", "sample_rate", "waveform", "error"])  # one file at a time
    return raw.mapInPandas(decode, schema)


def _hz_to_mel(f):
    return 2595.0 * np.log10(1.0 + np.asarray(f, dtype=np.float64) / 700.0)


def _mel_to_hz(m):
    return 700.0 * (10.0 ** (np.asarray(m, dtype=np.float64) / 2595.0) - 1.0)


def mel_filters(sr: int = SAMPLE_RATE, n_fft: int = N_FFT, n_mels: int = N_MELS, fmin: float = 0.0,
                fmax: float = 8000.0) -> np.ndarray:
    """Triangular mel filterbank on the HTK mel scale, peaks of 1, not normalised (n_mels x (n_fft//2+1))."""
    fft_freqs = np.linspace(0, sr / 2, n_fft // 2 + 1)
    mel_pts = _mel_to_hz(np.linspace(_hz_to_mel(fmin), _hz_to_mel(fmax), n_mels + 2))
    fdiff = np.diff(mel_pts)
    ramps = mel_pts[:, None] - fft_freqs[None, :]
    lower = -ramps[:-2] / fdiff[:-1, None]
    upper = ramps[2:] / fdiff[1:, None]
    return np.maximum(0, np.minimum(lower, upper))


def log_mel_array(wave_arr: np.ndarray, filters: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """J5 for one waveform: periodic Hann STFT (n_fft 400, hop 160, centre reflect padding), power 2, mel,
    clamp 1e-10, log10, floor at the maximum of all frames - 8, (x + 4) / 4, then cut/pad to 3000 frames -> 80 x 3000
    float32 (written to ``out``, zeros, if it is given)."""
    x = np.asarray(wave_arr, dtype=np.float64)
    x = np.pad(x, (N_FFT // 2, N_FFT // 2), mode="reflect") if len(x) > N_FFT // 2 else \
        np.pad(x, (N_FFT // 2, N_FFT // 2))
    n_frames = 1 + (len(x) - N_FFT) // HOP
    idx = np.arange(N_FFT)[None, :] + HOP * np.arange(n_frames)[:, None]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    spec = np.abs(np.fft.rfft(x[idx] * window, axis=1)) ** 2
    spec = spec.T  # bins x frames
    fb = mel_filters() if filters is None else filters
    mel = fb @ spec
    logm = np.log10(np.maximum(mel, 1e-10))
    logm = np.maximum(logm, logm.max() - 8.0)
    logm = (logm + 4.0) / 4.0
    out = np.zeros((N_MELS, N_FRAMES), dtype=np.float32) if out is None else out
    k = min(N_FRAMES, logm.shape[1])
    out[:, :k] = logm[:, :k]
    return out


def log_mel(df: DataFrame, wave_col: str = "waveform", out_col: str = "log_mel") -> DataFrame:
    """J5 over a DataFrame: adds ``out_col`` STRUCT<shape ARRAY<INT>, data ARRAY<FLOAT>> (80 x 3000, row-major)."""
    ship_package(df.sparkSession)
    feat = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())),
                         T.StructField("data", T.ArrayType(T.FloatType()))])
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, feat)])

    at, names = df.columns.index(wave_col), schema.names

    def run(batches):
        fb = mel_filters()
        for batch in batches:
            for s in range(0, batch.num_rows, 16):  # a result is a megabyte, whatever the batch's rows are
                part = batch.slice(s, 16)
                given = part.column(at).is_valid().to_numpy(zero_copy_only=False)
                data = np.zeros((int(given.sum()), N_MELS, N_FRAMES), dtype=np.float32)
                for i, row in enumerate(np.flatnonzero(given).tolist()):
                    log_mel_array(part.column(at)[row].values.to_numpy(zero_copy_only=False), fb, data[i])
                ends = np.concatenate([[0], np.cumsum(given)]).astype(np.int32)
                shapes = pa.ListArray.from_arrays(pa.array(2 * ends), pa.array(np.tile(np.int32([N_MELS, N_FRAMES]), len(data))))
                mels = pa.ListArray.from_arrays(pa.array(N_MELS * N_FRAMES * ends), pa.array(data.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays([shapes, mels], ["shape", "data"], mask=pa.array(~given))], names=names)
    return df.mapInArrow(run, schema)


def _height_width(size: int | tuple[int, int]) -> tuple[int, int]:
    return (size, size) if isinstance(size, int) else (int(size[0]), int(size[1]))


def resize_bilinear(img: np.ndarray, size: int | tuple[int, int]) -> np.ndarray:
    """Bilinear resize of H x W x C to ``size`` (a side, or height and width) with half-pixel centres."""
    h, w = img.shape[:2]
    out_h, out_w = _height_width(size)

    def axis(n_in, n_out):
        pos = (np.arange(n_out) + 0.5) * (n_in / n_out) - 0.5
        pos = np.clip(pos, 0, n_in - 1)
        lo = np.floor(pos).astype(int)
        hi = np.minimum(lo + 1, n_in - 1)
        return lo, hi, pos - lo
    y0, y1, fy = axis(h, out_h)
    x0, x1, fx = axis(w, out_w)
    top = img[y0][:, x0] * (1 - fx)[None, :, None] + img[y0][:, x1] * fx[None, :, None]
    bot = img[y1][:, x0] * (1 - fx)[None, :, None] + img[y1][:, x1] * fx[None, :, None]
    return top * (1 - fy)[:, None, None] + bot * fy[:, None, None]


def image_array(row_struct, size: int | tuple[int, int] = IMAGE_SIZE, mean: float = IMAGE_MEAN, std: float = IMAGE_STD) -> np.ndarray:
    """J3 for one Spark ``image`` struct (BGR bytes): RGB, /255, bilinear resize, (x - mean) / std, C x H x W."""
    h, w, c = int(row_struct["height"]), int(row_struct["width"]), int(row_struct["nChannels"])
    arr = np.frombuffer(bytes(row_struct["data"]), dtype=np.uint8).reshape(h, w, c).astype(np.float64)
    if c == 1:
        arr = np.repeat(arr, 3, axis=2)
    rgb = arr[:, :, [2, 1, 0]] if arr.shape[2] >= 3 else arr
    rgb = rgb[:, :, :3] / 255.0
    out = (resize_bilinear(rgb, size) - mean) / std
    return out.transpose(2, 0, 1).astype(np.float32)


def image_tensors(spark, path: str, size: int | tuple[int, int] = IMAGE_SIZE, mean: float = IMAGE_MEAN,
                  std: float = IMAGE_STD) -> DataFrame:
    """Spark ``image`` source (JVM decode) -> (path, tensor STRUCT<shape, data>, error) via numpy, a few images at a
    time (an output tensor has the same size whatever the picture's). Unreadable images keep their row, with a null
    tensor and the reason in ``error``."""
    ship_package(spark)
    imgs = spark.read.format("image").option("dropInvalid", "false").load(path).select("image")
    feat = "path string, tensor struct<shape: array<int>, data: array<float>>, error string"

    def one(im):
        if im is None or int(im["height"]) <= 0 or int(im["width"]) <= 0:
            return None, "unreadable image"
        try:
            t = image_array(im, size, mean, std)
        except Exception as e:  # noqa: BLE001 - quarantined with its reason
            return None, f"unreadable image: {e}"
        return {"shape": list(t.shape), "data": t.reshape(-1)}, None

    def run(batches):
        for pdf in batches:
            for s in range(0, len(pdf), 16):
                out = [(im["origin"] if im is not None else None, *one(im)) for im in pdf["image"].iloc[s:s + 16]]
                yield pd.DataFrame(out, columns=["path", "tensor", "error"])
    return imgs.mapInPandas(run, feat)


def normalize_payload(df: DataFrame, payload_col: str) -> DataFrame:
    """Keep only non-null modality fields of a text/image/audio/video payload struct (as a map); if all are
    null keep the value as is; count images/videos per sample (null 0, list = its length, else 1)."""
    fields = [f.name for f in df.schema[payload_col].dataType.fields]
    everything = F.array(*[F.struct(F.lit(f).alias("k"), F.col(f"{payload_col}.{f}").cast("string").alias("v"))
                           for f in fields])
    kept = F.filter(everything, lambda e: e.getField("v").isNotNull())
    # all fields null: the payload is kept as it is (every key, NULL values)
    entries = F.map_from_entries(F.when(F.size(kept) > 0, kept).otherwise(everything))
    out = df.withColumn(f"{payload_col}_fields", entries)

    def count(name):
        if name not in fields:
            return F.lit(0)
        c = F.col(f"{payload_col}.{name}")
        dt = df.schema[payload_col].dataType[name].dataType
        return F.when(c.isNull(), 0).otherwise(F.size(c) if isinstance(dt, T.ArrayType) else F.lit(1))
    return out.withColumn("num_images", count("image")).withColumn("num_videos", count("video"))


def hashed_embedding(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 64) -> DataFrame:
    """Default K1 text encoder without weights: feature hashing of the whitespace words into ``dim`` buckets
    (Spark ML ``HashingTF``, one JVM pass over the words), L2-normalised."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array
    staged = df.withColumn("_pf_words", words(text_col))
    tf = HashingTF(inputCol="_pf_words", outputCol="_pf_tf", numFeatures=dim).transform(staged)
    vec = vector_to_array(F.col("_pf_tf"))
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    emb = F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)
    return tf.withColumn(out_col, emb).drop("_pf_words", "_pf_tf")


def encode_items(df: DataFrame, encoders: dict | None = None, dim: int = 64, idx_col: str = "idx",
                 missing: str = "error") -> DataFrame:
    """K1: route items (B3 unpivot) by modality, encode, L2-normalise; returns (idx, role, modality, embedding).

    ``encoders`` maps modality -> callable(list[value]) -> 2-D array. The items are read once: an Arrow batch's items go to their
    encoders in one call a modality, in ``mapInPandas`` (a callable that loads its model once per Python worker does so for all of
    them); text defaults to ``hashed_embedding``, which stays in the JVM, and values without a given encoder aren't sent to
    Python. An item of a modality without an encoder fails the job, or with ``missing="null"`` keeps its row with a null embedding."""
    if missing not in ("error", "null"):
        raise ValueError("missing must be 'error' or 'null'")
    ship_package(df.sparkSession)
    encoders = encoders or {}
    modality = F.col("modality")
    items = unpivot_items(df, idx_col).select(idx_col, "role", "modality", "value")
    none = F.lit(None).cast("array<double>")
    if missing == "error":
        none = F.raise_error(F.concat(F.lit("no encoder for modality "), modality)).cast("array<double>")
    if "text" in encoders:
        items = items.withColumn("embedding", F.when(~modality.isin(*encoders), none))
    else:
        own = hashed_embedding(items.withColumn("_pf_text", F.when(modality == "text", F.col("value"))), "_pf_text", "embedding", dim).drop("_pf_text")
        items = own.withColumn("embedding", F.when(modality == "text", F.col("embedding")).when(~modality.isin("text", *encoders), none))
    if not encoders:
        return items.select(idx_col, "role", "modality", "embedding")
    sent = items.select(idx_col, "role", "modality", F.when(modality.isin(*encoders), F.col("value")).alias("value"), "embedding")

    def route(batches):
        for pdf in batches:
            out = pdf[[idx_col, "role", "modality"]].copy()
            out["embedding"] = pdf["embedding"]
            for m, fn in encoders.items():
                at = np.flatnonzero((pdf["modality"] == m).to_numpy())
                if len(at):
                    emb = np.asarray(fn(pdf["value"].iloc[at].tolist()), dtype=np.float64)
                    emb = emb / np.maximum(np.linalg.norm(emb, axis=1, keepdims=True), 1e-12)
                    held = out["embedding"].tolist()
                    for i, v in zip(at.tolist(), emb, strict=True):
                        held[i] = v
                    out["embedding"] = pd.Series(held, index=out.index, dtype=object)
            yield out
    return sent.mapInPandas(route, f"{idx_col} long, role string, modality string, embedding array<double>")


def featurize_text(df: DataFrame, max_len: int = MAX_TEXT_TOKENS, idx_col: str = "idx") -> DataFrame:
    """J7 (text part): group items by modality across roles, tokenize the text group in bulk, scatter back to
    (record, role) with a pivot on role -> one row per record with ``{role}_n_tokens``."""
    items = unpivot_items(df, idx_col).where(F.col("modality") == "text")
    tok = tokenize(items, "value", max_len)
    return tok.groupBy(idx_col).pivot("role", list(ROLES)).agg(F.first("n_tokens")) \
              .select(idx_col, *[F.col(r).alias(f"{r}_n_tokens") for r in ROLES])


def featurize(df: DataFrame, image_root: str | None = None, audio_root: str | None = None,
              max_len: int = MAX_TEXT_TOKENS, image_size: int = IMAGE_SIZE, idx_col: str = "idx") -> DataFrame:
    """Group items by modality across roles, process each group in bulk, scatter back to (record, role).

    Text items are tokenized (J1); image items join the decoded tensors of ``image_root`` (J3) on their path;
    audio items join the 30 s log-mel features of the WAV files under ``audio_root`` (J4 + J5) on their path.
    Paths are compared relative to the roots (as written in manifests). Output: one row per (idx, role) with
    ``modality``, ``input_ids`` (text), ``tensor`` (image) or ``log_mel`` (audio); missing media, and all items of a
    modality without a root, keep their row with NULL features (see D1 to list them first). Joins are on the path key: equi-joins on bulk-processed tables."""
    from pairforge.sources.media import _strip_root
    spark = df.sparkSession
    items = unpivot_items(df, idx_col)
    text = tokenize(items.where(F.col("modality") == "text"), "value", max_len).select(
        idx_col, "role", "modality", "input_ids")
    parts = [text]
    for m, root in (("image", image_root), ("audio", audio_root)):
        if not root:  # items stay, without features
            parts.append(items.where(F.col("modality") == m).select(idx_col, "role", "modality"))
    if image_root:
        imgs = image_tensors(spark, image_root, image_size).withColumn("value", _strip_root("path", image_root))
        parts.append(items.where(F.col("modality") == "image")
                     .join(imgs.select("value", "tensor"), "value", "left").select(idx_col, "role", "modality", "tensor"))
    if audio_root:
        waves = read_wav(spark, audio_root).where(F.col("error").isNull())
        mel = log_mel(fix_waveform(waves)).withColumn("value", _strip_root("path", audio_root))
        parts.append(items.where(F.col("modality") == "audio")
                     .join(mel.select("value", "log_mel"), "value", "left").select(idx_col, "role", "modality", "log_mel"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
