"""Reading input tables and staging intermediate ones."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of an input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing on one machine (tests) a temporary folder is set once; on a cluster
    that would be a folder of one machine only, so it is an error.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        have = tempfile.mkdtemp(prefix="quarrymill-")
        atexit.register(shutil.rmtree, have, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", have)
    return have


#: Folders written by ``staged`` in this process.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this process; results that still read them are lost."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, computes what is used
    several times only once, and gives later plans the true size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def bounded_batches(df: DataFrame, limit: str = "16m") -> DataFrame:
    """``df``, with Arrow batches of its session bounded in bytes, so that very long texts do not
    meet in one batch; a limit that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = str(df.sparkSession.conf.get(key, None)).rstrip("b")
    if not digits.isdigit() or int(digits) > 1 << 30:
        df.sparkSession.conf.set(key, limit)
    return df


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted ``rows`` stay within ``limit``."""
    return F.broadcast(df) if rows <= limit else df
