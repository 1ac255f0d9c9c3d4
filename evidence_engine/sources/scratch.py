"""Written tables that cut a lineage: they lie in the folder that ``spark.checkpoint.dir`` names, which all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """The tables that one run writes. Each run has its own list, so none deletes what another still reads."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:  # a session of one machine without a shared folder, as in tests
            root = "file://" + tempfile.mkdtemp(prefix="scratch-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.written = 0

    def settled(self, df: DataFrame) -> DataFrame:
        """The same rows as a written table."""
        path = f"{self.folder}/{self.written}"
        self.written += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def clear(self, *but: DataFrame) -> None:
        """Deletes the tables of this run, except some."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        kept = [(table, path) for table, path in self.tables if any(table is b for b in but)]
        for table, path in self.tables:
            if not any(table is b for b in but):
                at = hadoop(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.tables = kept
