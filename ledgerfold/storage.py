"""Tables written between the steps of an operator: they cut the lineage, and survive the loss of any executor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in ``spark.checkpoint.dir``. On one machine any folder is shared."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/ledgerfold-{spark.sparkContext.applicationId}"


_written: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back. What is still there when the driver ends is deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerfold-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may have been stopped
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
