"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join sides even when that adds a shuffle further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows may hold whole documents: a batch of the default size would be tens of megabytes on both sides
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # aggregates that keep short lists per group stay hash-based for more than 128 groups per task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SIZED = "spark.flowhorizon.advisoryBefore"


def size_shuffles(spark: SparkSession, rows: int, rows_a_partition: int, size: str) -> None:
    """Shuffles of a table of ``rows`` rows start with a partition for every ``rows_a_partition`` of them, and adaptive
    execution joins small ones up to ``size`` bytes. The usual fixed number of partitions lets a task grow with the table.
    Holds until the next :func:`tune`, that is for one query; a table of few partitions, and a session that names its own
    first number, are left as they are."""
    _unsize(spark)
    wanted = -(-rows // rows_a_partition)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) and spark.conf.get(PARTITIONS, None) is None:
        spark.conf.set(SIZED, spark.conf.get(ADVISORY))
        spark.conf.set(PARTITIONS, str(wanted))
        spark.conf.set(ADVISORY, size)


def _unsize(spark: SparkSession) -> None:
    before = spark.conf.get(SIZED, None)
    if before is not None:
        spark.conf.set(ADVISORY, before)
        spark.conf.unset(PARTITIONS)
        spark.conf.unset(SIZED)


def build_session(app: str = "flowhorizon", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session. ``master`` is only given in tests and benches."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    _unsize(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Where none is named, a temporary one in local mode only:
    on more than one machine every executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if folder is None and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="flowhorizon-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        current = spark.sparkContext.getCheckpointDir()
    return folder or current
