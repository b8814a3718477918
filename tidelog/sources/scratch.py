"""A folder for tables that only this application needs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, a temporary folder if all runs on this
    machine (it goes when the process ends), else one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.split("[")[0] == "local":
        if "path" not in _OWN:
            _OWN["path"] = tempfile.mkdtemp(prefix="tidelog-")
            atexit.register(shutil.rmtree, _OWN["path"], ignore_errors=True)
        path = _OWN["path"]
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidelog-scratch").rstrip("/")


#: Lets Spark delete the shuffle files of a query when it ends. A query that is run again makes them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it back: lineage ends there, a lost executor costs nothing, later plans
    know the true size, and the shuffles behind it take no more disk."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table which nothing that is still to run reads."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
