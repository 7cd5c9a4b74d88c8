"""Shared scratch tables: cut lineage with Parquet in the folder that all executors share.

``spark.checkpoint.dir`` names the shared folder; only where it is unset and Spark runs on this machine alone
(tests, a laptop) a temporary folder takes its place and is set as ``spark.checkpoint.dir`` for the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Tables written once under a folder of their own and read again; ``drop`` removes one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.written: dict[str, list[str]] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table as read from there; a name that was used before gets a new folder."""
        paths = self.written.setdefault(name, [])
        paths.append(self.path(f"{name}.{len(paths)}" if paths else name))
        df.write.mode("overwrite").parquet(paths[-1])
        return self.spark.read.schema(df.schema).parquet(paths[-1])

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, or everything, with the session's own file system client."""
        for path in [p for n in names for p in self.written.pop(n, [])] if names else [self.root]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
