"""B0c write_shards and A9 read_shards: fixed-size shards in a parquet table, a log of what was written, and a one-row
``_metadata`` table (num_records, num_shards, shard_size and how the features were made).

Many shards share a file: a write puts its records under ``records/write=W/pack=P`` (P = shard_id div ``PACK_SHARDS``), sorted by shard, so
the number of folders and files follows the data's size and a read of few shards is pruned by pack and by the files' own
statistics. When all records are there, the write commits by adding a row per shard (records, checksum) to ``log/write=W``, read
from the written files. Readers follow the log: each shard is read from the last write that committed it, so a retried or resumed job
replaces exactly the shards it writes, and records of a write that didn't get to its log are never seen. Reads ignore
shards beyond the metadata's number (left by an earlier, larger write) and fail on unreadable files.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.features import MAX_TEXT_TOKENS, featurize
from pairforge.operators.joins import join_bounded
from pairforge.operators.records import ROLES
from pairforge.operators.shards import DEFAULT_SHARD_SIZE, assign_shards

#: Shards of a folder, and files that a folder's shards are dealt to.
PACK_SHARDS, PACK_FILES = 1000, 8
#: Optional metadata fields of feature shards, with their types.
FEATURE_FIELDS = {"manifest": "string", "text_encoder": "string", "image_encoder": "string", "audio_encoder": "string",
                  "max_text_length": "int", "device": "string"}


def write_shards(df: DataFrame, path: str, shard_size: int = DEFAULT_SHARD_SIZE, total: int | None = None,
                 idx_col: str = "idx", metadata: dict | None = None, pack_shards: int = PACK_SHARDS) -> int:
    """F1, then the records of all shards, their log, and the metadata; returns the number of shards. ``metadata`` may set the
    ``FEATURE_FIELDS`` (null otherwise)."""
    unknown = set(metadata or {}) - set(FEATURE_FIELDS)
    if unknown:
        raise ValueError(f"unknown metadata fields: {', '.join(sorted(unknown))}")
    spark = df.sparkSession
    shards = assign_shards(df, shard_size, idx_col).drop("shard_name")
    n = total if total is not None else df.count()
    num_shards = -(-n // shard_size) if n else 0
    write = time.time_ns() // 1000  # later writes have larger numbers
    pack = F.floor(F.col("shard_id") / pack_shards).cast("int")
    (shards.withColumn("pack", pack).repartition("pack", F.pmod("shard_id", F.lit(PACK_FILES))).sortWithinPartitions("pack", "shard_id", "shard_pos")
           .write.mode("overwrite").option("compression", "zstd").partitionBy("pack").parquet(f"{path}/records/write={write}"))
    written = spark.read.schema(shards.schema).parquet(f"{path}/records/write={write}")
    _sums(written).write.mode("overwrite").parquet(f"{path}/log/write={write}")
    meta = spark.range(1).select(F.lit(n).cast("long").alias("num_records"),
                                 F.lit(num_shards).cast("int").alias("num_shards"),
                                 F.lit(shard_size).cast("int").alias("shard_size"),
                                 *[F.lit((metadata or {}).get(f)).cast(t).alias(f) for f, t in FEATURE_FIELDS.items()])
    meta.write.mode("overwrite").parquet(f"{path}/_metadata")
    return num_shards


def _hashable(df: DataFrame, name: str) -> Column:
    return F.to_json(name) if "map<" in dict(df.dtypes)[name] else F.col(f"`{name}`")


def _sums(records: DataFrame) -> DataFrame:
    """(shard_id, num_records, checksum): the checksum is the exclusive or of the rows' hashes, whatever their order."""
    row = F.xxhash64(*[_hashable(records, c) for c in sorted(c for c in records.columns if c not in ("write", "pack"))])
    return records.groupBy("shard_id").agg(F.count(F.lit(1)).alias("num_records"), F.bit_xor(row).alias("checksum"))


def shard_log(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, write, num_records, checksum) of the shards there are, each by its last committed write. No record is read, so
    it is the cheap source for E4 and for F2's resume."""
    try:
        log = spark.read.parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"No shards found under {path}") from e
    last = log.groupBy("shard_id").agg(F.max_by(F.struct("write", "num_records", "checksum"), "write").alias("_pf_l")).select("shard_id", "_pf_l.*")
    meta = read_shard_metadata(spark, path).limit(1).collect()
    return last.where(F.col("shard_id") < meta[0]["num_shards"]) if meta else last


def _records(spark: SparkSession, path: str, log: DataFrame, skip_unreadable: bool) -> DataFrame:
    """The records that ``log`` names, with the pack column left out."""
    writes = [r["write"] for r in log.select("write").distinct().collect()]  # one row a write
    rows = spark.read.option("ignoreCorruptFiles", str(skip_unreadable).lower()).parquet(f"{path}/records").where(F.col("write").isin(writes)).drop("pack")
    if len(writes) == 1:  # one write holds all shards: nothing to look up
        bounds = log.agg(F.min("shard_id"), F.max("shard_id"), F.count(F.lit(1))).first()
        if bounds[1] - bounds[0] + 1 == bounds[2]:
            return rows.where(F.col("shard_id").between(bounds[0], bounds[1])).drop("write")
    return join_bounded(rows, log.select("shard_id", "write"), ["shard_id", "write"]).drop("write")


def read_shards(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """The shard table (records with ``shard_id``, ``shard_pos``); fails when no shard exists or one can't be read.
    ``skip_unreadable`` leaves unreadable files out: for E4's count before a resume, never for training data."""
    log = shard_log(spark, path)
    if log.isEmpty():
        raise FileNotFoundError(f"No shards found under {path}")
    return _records(spark, path, log, skip_unreadable)


def verify_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, num_records, found, ok) of every committed shard: whether its records can be read and give the log's count and
    checksum. The shards that aren't ok are those to write again."""
    log = shard_log(spark, path)
    found = _sums(_records(spark, path, log, skip_unreadable=True)).select("shard_id", F.col("num_records").alias("found"), F.col("checksum").alias("_pf_sum"))
    ok = (F.col("found") == F.col("num_records")) & (F.col("_pf_sum") == F.col("checksum"))
    return log.join(found, "shard_id", "left").select("shard_id", "num_records", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(ok, F.lit(False)).alias("ok"))


def read_shard_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_metadata")


def write_feature_shards(df: DataFrame, path: str, shard_size: int = DEFAULT_SHARD_SIZE, image_root: str | None = None,
                         audio_root: str | None = None, metadata: dict | None = None, idx_col: str = "idx", **featurize_options) -> int:
    """J7 -> B0c: features of every record (a struct per role: modality, input_ids and, with media roots, tensor and
    log_mel) in fixed-size shards. Returns the number of shards."""
    items = featurize(df, image_root, audio_root, idx_col=idx_col, **featurize_options)
    kinds = [c for c in items.columns if c not in (idx_col, "role")]
    # three items a record: the pivot's groups are bounded
    records = items.groupBy(idx_col).pivot("role", list(ROLES)).agg(F.first(F.struct(*kinds)))
    meta = {"max_text_length": featurize_options.get("max_len", MAX_TEXT_TOKENS)} | (metadata or {})
    return write_shards(records, path, shard_size, total=df.count(), idx_col=idx_col, metadata=meta)


def read_payloads(spark: SparkSession, path: str, field: str, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """A9 for feature shards: one payload field (input_ids, tensor or log_mel) of each role, nothing else is read."""
    df = read_shards(spark, path)
    return df.select("idx", "shard_id", "shard_pos", *[F.col(f"{r}.{field}").alias(f"{r}_{field}") for r in roles])
