"""Session settings the datasets rely on, and lineage cutting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # DATETIME columns carry no zone; one fixed session zone keeps date maths stable.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot doctor, patient or admission is split at the join instead of being one task.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split it even where the next operator then needs a shuffle of its own: after a
    # partial aggregate that shuffle is small, an unsplit hot key is not.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


SHUFFLE_BYTES = 128 * 1024 * 1024


def cluster_settings(largest_table_bytes: int, cores: int) -> dict[str, str]:
    """Settings to start a cluster session with, from the size of the largest table.

    The number of shuffle partitions is an upper bound that keeps a partition of the
    largest shuffle near 128 MB, so that it fits an executor and spills little; small
    shuffles are merged again at run time.
    """
    partitions = max(2 * cores, -(-largest_table_bytes // SHUFFLE_BYTES))
    return {
        **SETTINGS,
        # also the number of ranges of a sort, which is not adapted at run time
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_BYTES),
        "spark.sql.files.maxPartitionBytes": str(2 * SHUFFLE_BYTES),
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings above to an existing session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "wardline") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Plans are built from many small expressions; recording the Python line of
        # each of them costs more than planning. Set it at start-up on a cluster too.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else one in the warehouse.

    Executors share either of them. A warehouse in the driver's own files is refused on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/checkpoints"


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` so that several outputs share one evaluation.

    The files go to the shared folder the cluster names in ``spark.checkpoint.dir``
    and so survive the loss of executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()
