"""A keyed table of change files, merged where it is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import delete_folder


@dataclass
class KeyedTable:
    """Rows under a folder, written batch by batch as change files; a batch's rows of a key replace all earlier ones of that key.

    A write takes what the batch holds and nothing else. A batch that is written again replaces itself, so that replaying changes nothing. compact() writes the merged rows once as a base
    and deletes what it covers. Batches are numbered by one writer, as a stream numbers its micro-batches.
    """

    spark: SparkSession
    path: str
    key: str = "id"

    def write(self, batch: int, rows: DataFrame, deleted: DataFrame | None = None) -> None:
        """The rows of a batch, and keys (a column named like the table's) that it deletes."""
        new = rows.withColumn("_deleted", F.lit(False))
        if deleted is not None:
            new = new.unionByName(deleted.select(self.key, F.lit(True).alias("_deleted")).distinct(), allowMissingColumns=True)
        new.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch:09d}")

    def changes(self, batch: int) -> DataFrame:
        """What one batch has written, deletions left out."""
        return self.spark.read.parquet(f"{self.path}/changes/batch={batch:09d}").filter("NOT _deleted").drop("_deleted")

    def read(self) -> DataFrame | None:
        """The merged rows; None before the first batch."""
        bases, changes = self._finished("base"), self._finished("changes")
        upto = bases[-1][0] if bases else -1
        later = [path for n, path in changes if n > upto]
        base = self.spark.read.parquet(bases[-1][1]) if bases else None
        if not later:
            return base
        rows = self.spark.read.option("basePath", f"{self.path}/changes").parquet(*later).withColumnRenamed("batch", "_batch")
        newest = F.max("_batch").over(Window.partitionBy(self.key))
        fresh = rows.withColumn("_newest", newest).filter("_batch = _newest AND NOT _deleted").drop("_batch", "_newest", "_deleted")
        if base is None:
            return fresh
        return base.join(rows.select(self.key).distinct(), self.key, "left_anti").select(*base.columns).unionByName(fresh, allowMissingColumns=True)

    def compact(self) -> None:
        """Write the merged rows as a new base, then delete the older ones and the changes that it holds."""
        changes, rows = self._finished("changes"), self.read()
        if not changes or rows is None:
            return
        upto = changes[-1][0]
        rows.write.mode("overwrite").parquet(f"{self.path}/base/upto={upto:09d}")
        for n, path in [*self._finished("base"), *changes]:
            if n < upto or "/changes/" in path:
                delete_folder(self.spark, path)

    def _finished(self, kind: str) -> list[tuple[int, str]]:
        """(number, folder) of the finished writes, in order."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [f.getPath() for f in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted((int(p.getName().partition("=")[2]), p.toString()) for p in found)


def newest(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the one of the largest version; of equal versions the one with the smallest hash."""
    last = Window.partitionBy(key).orderBy(F.desc("version"), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
