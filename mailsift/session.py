"""Session helpers.

Nothing here overrides settings a cluster already provides: every option is
applied only when the running session has no value for it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a local test session gets when the launcher gave none.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "mailsift") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", os.environ.get("MAILSIFT_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stream checkpoints.

    On a cluster this is the ``spark.checkpoint.dir`` the launcher names (a
    shared file system); without one we refuse, because executors would write
    to their own disks. Only a local master (unit tests) gets a private folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="mailsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: Python functions that
    run there are found by name, and a cluster's machines don't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_mailsift_shipped", False):
        return
    import io
    import zipfile
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join(os.path.basename(here), os.path.relpath(full, here)))
    path = os.path.join(tempfile.mkdtemp(prefix="mailsift-"), "mailsift.zip")  # the driver's; Spark serves it to the executors
    with open(path, "wb") as out:
        out.write(data.getvalue())
    sc.addPyFile(path)
    sc._mailsift_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the checkpoint root."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the plan starts anew at
    the files, and a lost executor costs a read instead of the work before.
    ``options`` are the writer's."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")  # shuffle files go when the write ends
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
