"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from dispatchery.session import ensure_checkpoint_dir


class Run:
    """A folder of its own below spark.checkpoint.dir for the intermediate tables of one call."""

    def __init__(self, spark, name: str):
        self.spark, self.folder, self.count = spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write `df` and go on from what was written."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table of this run that nothing reads any more."""
        for file in [df.inputFiles()[0]] if df is not None and df.inputFiles() else []:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getParent().getName() == self.folder.rpartition("/")[2]:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
