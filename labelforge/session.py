"""Session construction and the shared scratch folder.

Stages and lineage cuts go to ``spark.checkpoint.dir`` (the cluster's shared
folder).  Only when the session has none (local tests, the bench) is a fresh
folder under the system temp dir set.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "labelforge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``labelforge`` importable by the Python workers (once per app).

    Functions run by ``mapInPandas`` / ``predict_batch_udf`` are pickled by
    reference to this package, so executors need it on their path; it is
    zipped and distributed with ``addPyFile`` like ``--py-files`` would.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="labelforge-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder plus the package on the workers' path."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def scale_conf(input_bytes: int, shuffle_bytes: int | None = None, executor_cores: int = 4000,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings sized for a given input volume (spill-aware).

    * splits of ``target_partition_bytes`` (256 MB): ~400k tasks for 100 TB;
    * shuffle partitions so that one reduce partition holds about that much
      of the shuffled data (default: the whole input), at least 2x the cores;
      the bucketed stage tables use the same count;
    * AQE coalesces small partitions and splits skewed join partitions above
      5x the median (and 1 GB);
    * broadcasts only below 64 MB of measured size.
    """
    shuffle_bytes = shuffle_bytes or input_bytes
    partitions = max(2 * executor_cores, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.  Only a single-machine session gets
    one of its own if unset; on a cluster that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors "
                               f"share (master is {master})")
        configured = tempfile.mkdtemp(prefix="labelforge-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    Used where one result feeds two branches of a plan, so the upstream work
    runs once (and is not redone when an executor is lost).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
