"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own is set on a local master, and any other
    is refused, as its executors do not share the driver's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sayframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut a plan's lineage.

    They lie in the shared folder, so that a lost executor takes nothing with it. ``drop`` frees what is no longer
    read; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self._quiet_drop)

    def table(self, df: DataFrame, name: str, grows: bool = False) -> DataFrame:
        """The frame, written and read again. One that grows with the input is joined by sorting: Spark judges a file by
        its compressed size, so it would gather a table of many times that size on the driver to broadcast it. What was
        shuffled for it is freed at once."""
        held = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, held)
        read = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        return read.hint("merge") if grows else read

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _quiet_drop(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # the session has ended, and with it whatever could delete
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def extended(df: DataFrame, ddl: str) -> StructType:
    """The frame's schema with further fields; a frame's own schema object is never changed."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
