"""Tables that grow batch by batch and are looked up by key.

Plain Parquet below `<path>/part=<p>/label=<batch>/`. The part is a prefix of the key's hash, or a column such as a day, so
a batch reads only the parts that its own keys fall into, and the scan of the rest is pruned. A batch overwrites the
partitions of its own label, so one that runs again after a lost executor leaves the same rows. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_part(key: str, parts: int = 64) -> Column:
    """The part of a key among `parts`; null keys have one of their own like any other value."""
    return F.format_string("%04d", F.pmod(F.xxhash64(key), F.lit(parts)))


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: Column):
        self.spark, self.path, self.schema, self.part = spark, path, schema, part

    def _exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def parts_of(self, batch: DataFrame) -> list[str]:
        """The parts a batch falls into: at most as many short strings as the table has parts."""
        return [r[0] for r in batch.select(self.part.alias("part")).distinct().collect()]

    def read(self, parts: list[str] | None = None, without: str | None = None) -> DataFrame:
        """The rows of `parts` (all by default), leaving out one batch: what a re-run of that batch has to look at."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        split = [T.StructField("part", T.StringType()), T.StructField("label", T.StringType())]
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, *split])).parquet(self.path)
        if parts is not None:
            rows = rows.where(F.col("part").isin(parts))
        if without is not None:
            rows = rows.where(F.col("label") != without)
        return rows.drop("part", "label")

    def append(self, rows: DataFrame, label: str) -> None:
        # A rebalance gathers each part in few files and still splits a part that holds most of the rows.
        rows.select(*self.schema.names, self.part.alias("part"), F.lit(label).alias("label")).hint("rebalance", "part").write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "label").parquet(self.path)
