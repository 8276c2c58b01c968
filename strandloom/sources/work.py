"""Where files and tables go that one job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset on one machine (tests), a folder of our own, removed when Python ends.

    On a cluster a folder must be named: nodes don't share their local ones.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes of the cluster share")
        own = tempfile.mkdtemp(prefix="strandloom-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strandloom/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows of `frame`, computed once: written as Parquet to the shared folder and read again, without lineage."""
    spark = frame.sparkSession
    path = work_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Remove the files of a table of written() that nothing will read again."""
    spark = frame.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
