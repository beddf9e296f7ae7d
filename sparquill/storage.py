"""Intermediate tables in the folder all executors share.

Lineage is cut by writing a table, never by ``localCheckpoint``: a lost executor then costs
a re-read, not a wrong or failed result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only for a local master.

    On a cluster without that setting a ``ValueError`` is raised, because a folder of one
    machine cannot be read by the others.
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        folder = tempfile.mkdtemp(prefix="sparquill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_SCRATCH[app] = folder
    return "file://" + _LOCAL_SCRATCH[app]


def application_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{scratch_root(spark)}/sparquill-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; DataFrames that still read them fail."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
