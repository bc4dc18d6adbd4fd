"""SparkSession construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every tagflow job relies on; all are plain Spark configuration.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tagflow", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass master=None and let spark-submit decide."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` wins. Only when it is unset and the master is local
    (tests, one machine) a fresh scratch folder is created; on any other master a missing setting
    is an error, because executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tagflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started from (once a context)."""
    sc = spark.sparkContext
    if getattr(sc, "_tagflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tagflow-pkg-"), "tagflow-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tagflow", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tagflow_shipped = True


def state_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; ``clear_state`` knows it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tagflow-{name}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_tagflow_states", []).append(path)
    return path


def clear_state(spark: SparkSession) -> None:
    """Delete the state tables this session has written. DataFrames that still read them become unusable."""
    paths = spark.sparkContext.__dict__.get("_tagflow_states", [])
    while paths:
        drop_state(spark, paths.pop())


def drop_state(spark: SparkSession, path: str) -> None:
    """Delete a state table that no later plan reads (through Hadoop's file system API)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    paths = spark.sparkContext.__dict__.get("_tagflow_states", [])
    if path in paths:
        paths.remove(path)


def materialize(df: DataFrame, name: str = "state") -> DataFrame:
    """Write df as a parquet table under the shared checkpoint folder and read it back.

    Used by iterative loops: the re-read table starts a fresh logical plan, so neither the RDD
    lineage nor the optimizer's plan grows with the number of rounds, and the data survives the
    loss of any executor.
    """
    spark = df.sparkSession
    path = state_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
