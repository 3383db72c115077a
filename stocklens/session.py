"""Session set-up for tests and the benchmark, and the shared scratch folder.

On a cluster the session comes from the platform; the library only reads
``spark.checkpoint.dir`` from it. ``local_session`` is for tests and
``bench.py`` only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings the analysis is designed for; apply them to a cluster session too.
# AQE re-plans joins from measured sizes and splits skewed partitions; the
# forced variant also splits a hot (product, location) in the three joins that
# share one partitioning, paying an extra shuffle only when a partition is
# actually skewed.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stocklens",
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STOCKLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """Id of the Spark application behind ``spark`` (classic or Connect)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect sessions expose no SparkContext
        return spark.conf.get("spark.app.id", None) or f"session-{id(spark)}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's, or a new local one.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is
    used as is. A folder is only created here in local mode (tests, local
    runs), where driver and executors share one machine; on a cluster with no
    setting this raises rather than fall back to a machine-local folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the session configuration is visible
        conf = spark.conf.get(CHECKPOINT_CONF, None)
        if not conf:
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder on shared storage")
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_CONF} to a folder on shared storage (HDFS, object store)"
            )
        conf = tempfile.mkdtemp(prefix="stocklens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def in_few(df: DataFrame, most: int, *, dealt: bool = False) -> DataFrame:
    """``df`` in at most ``most`` partitions, where the session shuffles to more.

    A small table written from many partitions is as many files, and each costs more than its rows (on local
    folders Hadoop starts a process for every file and its checksums). Partitions are put together as they are; with
    ``dealt`` rows are shuffled, so that the work below keeps its tasks and a split hot key its parts: for narrow rows.
    """
    if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= most:
        return df
    return df.repartition(most) if dealt else df.coalesce(most)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage: later jobs read the files, so losing an executor costs
    a re-read, not a re-run of the joins that built ``df``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
