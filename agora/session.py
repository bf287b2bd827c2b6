"""Spark session helpers.

Every query runs with the session time zone pinned to UTC (epoch seconds are
turned into dates the same way on every executor) and with AQE on, so shuffle
partition counts and skewed joins are re-planned at runtime.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a query relies on for correct results, applied to any session.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Settings that only make sense where this package creates the session
# (tests, bench); a cluster keeps its own.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every query depends on."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "agora") -> SparkSession:
    """Session for tests and the bench: local mode, UI off, UTC."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**LOCAL_CONF, **REQUIRED_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset and the master is local (tests) is a scratch
    folder created; a cluster without the setting is an error, since its
    executors do not share a local folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="agora-ckpt-",
                                 dir=os.environ.get("AGORA_SCRATCH", "/tmp"))
        sc.setCheckpointDir(local)
        spark.conf.set("spark.checkpoint.dir", local)
    return sc.getCheckpointDir()
