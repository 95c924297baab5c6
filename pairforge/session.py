"""Session helpers.

Lineage is cut with reliable ``checkpoint()`` into the shared folder named by ``spark.checkpoint.dir``.
On a cluster that setting comes from the deployment; only when it is unset (unit tests, a laptop) do we
create a private folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "pairforge", shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        # checkpoints of P1 indexes are removed once their RDD is garbage-collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()
_LOCAL_ROOTS: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``pairforge`` importable in Python workers (Arrow UDF tasks unpickle functions from it): zip the
    package once per application and ``addPyFile`` it, so executors receive it with their tasks."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="pairforge-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir() or _LOCAL_ROOTS.get(spark.sparkContext.applicationId)
    if not root:
        # Unset only outside a cluster (tests): take a private folder once per application.
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pairforge-ckpt-")
        _LOCAL_ROOTS[spark.sparkContext.applicationId] = root
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(spark))
    ship_package(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written intermediate table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/pairforge/{name}-{uuid.uuid4().hex}"


def default_parallelism(spark: SparkSession) -> int:
    """Range partitions for P1 indexes: ``pairforge.index.partitions`` if set, else the shuffle partitions.

    Size it like any shuffle: input bytes / target partition bytes (e.g. 100 TB at ~2 GB -> ~50,000); the driver
    receives one count per partition.
    """
    for key in ("pairforge.index.partitions", "spark.sql.shuffle.partitions"):
        try:
            v = spark.conf.get(key, None)
        except Exception:  # pragma: no cover - unknown key on some deployments
            v = None
        if v:
            return max(1, int(v))
    return max(1, os.cpu_count() or 1)
