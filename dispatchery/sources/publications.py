"""Tables that are stored together and become visible together.

Plain Parquet: `<root>/<table>/label=<label>/` holds the rows, and `<root>/committed/label=<label>/`, written last, the
names of the tables that the label covers. Readers join rows with it, so a batch that was lost half-way shows nothing, and
running it again overwrites what it left. One writer at a time.
"""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


class Publications:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _exists(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def committed(self) -> DataFrame:
        """(part, label): the tables that each visible label covers."""
        schema = "part string, label string"
        if not self._exists("committed"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/committed")

    def commit(self, label: str, tables: dict[str, DataFrame], optional: tuple[str, ...] = ()) -> bool:
        """Store every table under `label` and then show them; False, and nothing written, for a label that is shown.

        A table named in `optional` that can't be computed is left out with a warning: a measurement that fails
        must not lose the publication.
        """
        if not self.committed().where(F.col("label") == label).isEmpty():
            return False
        written = []
        for name, rows in tables.items():
            try:
                rows.write.mode("overwrite").parquet(f"{self.root}/{name}/label={label}")
            except (PySparkException, Py4JJavaError):
                if name not in optional:
                    raise
                log.warning("%s of %s could not be computed", name, label, exc_info=True)
                continue
            written.append((name,))
        self.spark.createDataFrame(written, "part string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/committed/label={label}")
        return True

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """All rows of a table that are visible; an absent table is an empty one."""
        shown = self.committed().where(F.col("part") == name).select("label")
        if not self._exists(name) or shown.isEmpty():
            return self.spark.createDataFrame([], schema)
        labelled = T.StructType([*schema.fields, T.StructField("label", T.StringType())])
        rows = self.spark.read.schema(labelled).parquet(f"{self.root}/{name}")
        return rows.join(shown, "label", "left_semi").drop("label")
