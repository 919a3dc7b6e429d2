"""Tables between steps, in the folder that driver and executors share. Writing one cuts lineage and survives the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In plain local mode, where one is not set, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="attesta-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _leave() -> None:
    """Results are lazy and may read their tables until the driver ends, so only then workspaces go."""
    for jvm, conf, path in _kept:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001, PERF203  # the JVM may have gone first; whoever owns the folder cleans it then
            return


class Workspace:
    """Tables of one job in the shared folder; they are deleted when the driver ends, or before that by drop()."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_root(spark)}/attesta-{name}-{uuid.uuid4().hex}"
        _kept.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), self.path))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, f"{self.path}/{name}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a written table, computed once; lost executors don't lose it."""
    return Workspace(df.sparkSession, "cut").save(df, "table")
