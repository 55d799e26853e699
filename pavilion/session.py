"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this package relies on. Skewed join sides are split by
# AQE even where that costs one more shuffle of the (smaller) result. Shuffled
# facts are small beside what a task needs to sort and sum them.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the adaptive settings on; what its owner has set stays as it is."""
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in _RUNTIME.items():
        if key not in given and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "pavilion") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_local_root: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for staged tables, under the cluster's shared checkpoint folder.

    Only a local session without ``spark.checkpoint.dir`` may use a temporary
    folder of this machine; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_root:
            _local_root[app] = tempfile.mkdtemp(prefix="pavilion-")
        root = _local_root[app]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
