"""Results of a loop's rounds, written where all nodes reach them: plans stay short, and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='spanloom-')).rstrip('/')}/spanloom-{uuid.uuid4().hex}"


class Rounds:
    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, folder(spark), 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, kept: int) -> None:
        """Deletes all tables but the last `kept`."""
        jvm = self.spark.sparkContext._jvm
        for k in range(1, self.count - kept + 1):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{k}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
