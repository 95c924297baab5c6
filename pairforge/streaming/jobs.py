"""S1 stream_manifest, S2 stream_append and stream_build_source, S3 stream_ready, S4 stream_summary.

All sinks are idempotent: S1 uses the file sink (exactly-once through its checkpoint log); S2-S4 write each
micro-batch with ``foreachBatch`` into a folder keyed by the batch id (overwrite), so a replayed batch after a
failure rewrites the same files. Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.parse import parse_records
from pairforge.operators.index import group_index_stats
from pairforge.operators.joins import join_bounded
from pairforge.operators.order import ring_negatives
from pairforge.operators.records import modality_filter, resolve_media, to_trainer_rows
from pairforge.session import scratch_path

RECORD_FIELDS = ["query_type", "query_value", "positive_type", "positive_value", "negative_type",
                 "negative_value", "source"]


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise RuntimeError(str(query.exception()))


def manifest_stream(spark: SparkSession, path: str, allowed=None, query=None, positive=None, negative=None,
                    image_root: str | None = None, audio_root: str | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming twin of A1 + C0a (stateless): new JSONL files -> parsed, resolved, filtered records.
    Bad lines are kept with their ``error`` (quarantine); no line numbers (a stream has no global order)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(path).where(F.col("value").rlike(r"(?U)\S")).withColumnRenamed("value", "line")
    parsed = resolve_media(parse_records(lines, "line"), image_root, audio_root)
    ok = F.col("error").isNull()
    return parsed.where(~ok | modality_filter(allowed, query, positive, negative))


def stream_manifest(spark: SparkSession, path: str, out: str, checkpoint: str | None = None,
                    include_negative: bool | None = None, **filters) -> str:
    """Run the stream to the end of the available files (``availableNow``) into a parquet file sink. With
    ``include_negative`` set, the sink gets trainer rows (B5) with or without ``negative_0``."""
    df = manifest_stream(spark, path, **filters).where(F.col("error").isNull()).drop("error")
    if include_negative is not None:
        df = to_trainer_rows(df, include_negative)
    q = (df.writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", checkpoint or scratch_path(spark, "s1-ckpt"))
           .trigger(availableNow=True).start())
    _run(q)
    return out


def stream_append(spark: SparkSession, path: str, out: str, checkpoint: str | None = None,
                  files_per_trigger: int = 1) -> str:
    """Resumable incremental build. Each micro-batch (``files_per_trigger`` input files) is written to
    ``out/batch_id=N`` with overwrite, so a restart from the checkpoint replays idempotently."""
    df = manifest_stream(spark, path, max_files_per_trigger=files_per_trigger) \
        .where(F.col("error").isNull()).drop("error")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch_id={batch_id}")
    q = (df.writeStream.foreachBatch(write)
           .option("checkpointLocation", checkpoint or scratch_path(spark, "s2-ckpt"))
           .trigger(availableNow=True).start())
    _run(q)
    return out


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The rows of ``path/batch_id=N`` of earlier batches, or None before the first."""
    if batch_id == 0:
        return None
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException as e:  # no batch has written anything yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def stream_build_source(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, key: str = "k", source_col: str = "source",
                        text_col: str = "text", files_per_trigger: int | None = 1) -> str:
    """Transcript sources (A5) built as their parquet files arrive, resumable at any file. A micro-batch takes ``files_per_trigger``
    files (None: all that are there, so that several files may be read by several tasks).

    Rows are numbered per source in order of arrival (by ``key`` within a micro-batch), rows without a text too, as in A5; records
    of rows with a text are written to ``out/records/batch_id=N``. What goes on from one micro-batch to the next is one
    counter a source: a batch writes how many rows of each source it held to ``out/counters/batch_id=N``, and starts where the
    batches before it ended. A replayed batch finds the same counters, numbers its rows alike and overwrites its own folders. Within a
    batch, rows are numbered by a distributed sort, so a source may be any share of it. :func:`built_source` adds the
    negatives when the source is complete.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    rows = reader.parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = batch.select(F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(key).alias("k"), text.alias("text"))
        numbered, sizes = group_index_stats(rows, ["source"], ["k"], pos_col="_pos", size_col=None)
        earlier = _before(session, f"{out}/counters", batch_id)
        if earlier is None:
            numbered = numbered.withColumn("row_index", F.col("_pos"))
        else:  # one row a source
            start = earlier.groupBy("source").agg(F.sum("rows").alias("_start"))
            numbered = join_bounded(numbered, start, ["source"], "left").withColumn("row_index", F.coalesce("_start", F.lit(0)) + F.col("_pos"))
        records = numbered.where(F.col("text") != "").select(
            "k", "row_index", F.lit("audio").alias("query_type"), F.format_string("%s_%06d.wav", "source", "row_index").alias("query_value"),
            F.lit("text").alias("positive_type"), F.col("text").alias("positive_value"), "source")
        records.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/records/batch_id={batch_id}")
        sizes.select("source", F.col("size").alias("rows")).write.mode("overwrite").parquet(f"{out}/counters/batch_id={batch_id}")
    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _run(q)
    return out


def built_source(spark: SparkSession, out: str) -> DataFrame:
    """The records that :func:`stream_build_source` has written so far, with C1: the negative of a record is the text of the next one
    of its source, the first one's for the last; a source of one record has none."""
    records = spark.read.parquet(f"{out}/records").drop("batch_id")
    return ring_negatives(records, ["source"], ["row_index"])


def ready_dirs(events: DataFrame, required: Sequence[str], dir_col: str = "dir", name_col: str = "name",
               ts_col: str = "ts") -> DataFrame:
    """S3 batch twin: a directory is ready once every required file has appeared; ready_ts = the latest of the
    first arrival times of the required names. One partial/final aggregate per directory."""
    req = list(required)
    firsts = [F.min(F.when(F.col(name_col) == r, F.col(ts_col))).alias(f"_pf_r{i}") for i, r in enumerate(req)]
    agg = events.where(F.col(name_col).isin(*req)).groupBy(dir_col).agg(*firsts)
    cols = [F.col(f"_pf_r{i}") for i in range(len(req))]
    ready = F.greatest(*cols) if len(cols) > 1 else cols[0]
    cond = None
    for c in cols:
        cond = c.isNotNull() if cond is None else (cond & c.isNotNull())
    return agg.where(cond).select(dir_col, ready.alias("ready_ts"))


def stream_ready(spark: SparkSession, events_path: str, schema: str, required: Sequence[str], out: str,
                 dir_col: str = "dir", name_col: str = "name", ts_col: str = "ts",
                 checkpoint: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """S3: readiness as a stateful streaming aggregation (update mode). Each micro-batch's updated directories are
    written under ``out/batch_id=N``; the current state is the row of the latest batch per directory, and a
    directory fires the first time it appears ready. The state holds one row per directory."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    ev = reader.parquet(events_path).select(F.col(dir_col).alias("dir"), F.col(name_col).alias("name"),
                                            F.col(ts_col).alias("ts"))
    state = ready_dirs(ev, required, "dir", "name", "ts")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    q = (state.writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "s3-ckpt"))
              .trigger(availableNow=True).start())
    _run(q)
    return latest_state(spark.read.parquet(out), ["dir"])


def latest_state(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final state of an update-mode sink: per key, the row written by the latest batch (partial/final max_by)."""
    cols = [c for c in updates.columns if c not in (*keys, "batch_id")]
    agg = updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_pf_s"))
    return agg.select(*keys, *[F.col(f"_pf_s.{c}").alias(c) for c in cols])


def stream_summary(spark: SparkSession, path: str, out: str, checkpoint: str | None = None, allowed=None,
                   query=None, positive=None, negative=None, files_per_trigger: int | None = None) -> DataFrame:
    """E1 as running counters (complete mode); each trigger rewrites the one-row summary for its batch id and
    the latest one is the answer."""
    recs = manifest_stream(spark, path, max_files_per_trigger=files_per_trigger).where(F.col("error").isNull())
    ok = modality_filter(allowed, query, positive, negative)
    neg = F.col("negative_type").isNotNull()
    mods = F.array_compact(F.array("query_type", "positive_type", "negative_type"))
    agg = recs.withColumn("_ok", ok).groupBy().agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_ok"), mods))))).alias("modalities"),
        F.count_if(F.col("_ok")).alias("num_rows"),
        F.count_if(F.col("_ok") & neg).alias("num_negatives_present"),
        F.count_if(F.col("_ok") & ~neg).alias("num_negatives_missing"),
        F.count_if(~F.col("_ok")).alias("skipped_rows"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "s4-ckpt"))
            .trigger(availableNow=True).start())
    _run(q)
    res = spark.read.parquet(out)
    last = res.agg(F.max("batch_id")).collect()[0][0]
    out_df = res.where(F.col("batch_id") == last).drop("batch_id")
    return out_df.withColumn("has_uniform_negatives",
                             (F.col("num_negatives_present") > 0) & (F.col("num_negatives_missing") == 0))


def stream_ready_once(spark: SparkSession, events_path: str, schema: str, required: Sequence[str], out: str,
                      dir_col: str = "dir", name_col: str = "name", ts_col: str = "ts", watermark: str = "1 day", ttl: str | None = None,
                      checkpoint: str | None = None, files_per_trigger: int | None = None) -> str:
    """S3 as the watcher behaves: a directory fires once, when every required file has arrived, with
    ready_ts = the latest first-arrival time of the required names. Returns ``out``: a table (dir, ready_ts, batch_id).

    State (``applyInPandasWithState``) is held only for directories that wait: the first-arrival time of each required
    name. It goes when the directory fires, or by an event-time timer once the watermark is ``ttl`` (default: ``watermark``)
    beyond the directory's last event; choose it longer than the longest wait between a directory's files, since what
    came before is forgotten then. The fired directories are the sink itself: each micro-batch writes to ``out/batch_id=N`` what
    no earlier batch has fired, so none fires twice, however late more events of it come, after a restart or a replay too.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from pairforge.session import ship_package
    ship_package(spark)
    req = list(required)
    delay_ms = int(pd.Timedelta(ttl or watermark).total_seconds() * 1000)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    ev = (reader.parquet(events_path)
                .select(F.col(dir_col).cast("string").alias("dir"), F.col(name_col).alias("name"),
                        F.col(ts_col).cast("timestamp").alias("ts"))
                .where(F.col("name").isin(*req))
                .withWatermark("ts", watermark))

    def fire(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        firsts = list(state.get[0]) if state.exists else [None] * len(req)
        last = None
        for pdf in batches:
            for name, ts in zip(pdf["name"], pdf["ts"]):
                t = int(pd.Timestamp(ts).value // 1000)
                i = req.index(name)
                firsts[i] = t if firsts[i] is None else min(firsts[i], t)
                last = t if last is None else max(last, t)
        if all(f is not None for f in firsts):
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(max(firsts), unit="us"))], columns=["dir", "ready_ts"])
            return
        state.update((firsts,))
        state.setTimeoutTimestamp(max(last // 1000 if last is not None else 0, state.getCurrentWatermarkMs()) + delay_ms)

    ready = ev.groupBy("dir").applyInPandasWithState(
        fire, "dir string, ready_ts timestamp", "firsts array<long>", "append", GroupStateTimeout.EventTimeTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        earlier = _before(batch.sparkSession, out, batch_id)
        new = batch if earlier is None else batch.join(earlier.select("dir"), "dir", "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    q = (ready.writeStream.foreachBatch(write).outputMode("append")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "s3once-ckpt"))
              .trigger(availableNow=True).start())
    _run(q)
    return out
