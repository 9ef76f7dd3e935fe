"""Session settings and the folder that executors share."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH = "spark.tallow.scratch"


def configure(spark: SparkSession) -> SparkSession:
    """Settings the results depend on: UTC, and timestamps as UTC microseconds in Parquet.

    The last one is for speed: the JVM never compiles a method of more than 8,000 bytes,
    so a stage whose generated code is longer had better not be generated as one.

    The settings stay with the caller's session; give it ``spark.newSession()`` to keep them apart.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's ``spark.checkpoint.dir``.

    Only a session on one machine (a ``local`` master) may do without: there a folder is made
    once per session. On several machines each would write to its own disk and the results
    would be short, so the missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_SCRATCH, None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallow-")
        spark.conf.set(_OWN_SCRATCH, base)
    return f"{base.rstrip('/')}/tallow-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write once, read many: cuts lineage, so a lost executor costs no recomputation.

    A path that is given must not exist: nothing of the caller's is overwritten.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    schema = df.schema
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def hadoop_folder(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and its file system, by the settings of this session."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the job made, on whatever file system it is."""
    folder, system = hadoop_folder(spark, path)
    system.delete(folder, True)
