"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and all runs in one
    process (local tests). Elsewhere executors would write to disks of their own, so this raises. A folder without a
    scheme is named with that of the default file system, so that all who read the name mean the same one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            own = tempfile.mkdtemp(prefix="quantloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN[app] = "file://" + own
        folder = _OWN[app]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor lose it
    with an executor, and the optimizer sees its real size."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by keys to as many tasks as a shuffle has. For few rows with much work each: told only the keys,
    Spark would put them together by their bytes, in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
