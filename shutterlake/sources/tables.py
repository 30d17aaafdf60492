"""Reading the catalogue's tables, and scratch tables that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a catalogue directory; Parquet, one file or a folder of parts."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder.

    Where none is set, a session whose executors are threads of this process
    (``local[...]``) gets a temporary one; any other is refused, as a folder of
    one machine would lose the rows of the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="shutterlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, most_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back.

    Unlike ``DataFrame.checkpoint`` this runs the plan once and leaves columns
    that later scans can prune. No file gets more than ``most_rows`` rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if most_rows:
        writer = writer.option("maxRecordsPerFile", most_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = f"{shared_folder(spark)}/tables/"
    for name in {f[: f.index("/", f.index("/tables/") + 8)] for f in df.inputFiles() if "/tables/" in f}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if name.split("/tables/")[0].rstrip("/").split(":")[-1].lstrip("/") == root.split("/tables/")[0].split(":")[-1].lstrip("/"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
