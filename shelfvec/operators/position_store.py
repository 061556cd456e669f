"""Dense positions of a growing table, without renumbering what did not change.

Rows lie in ranges of their key, a folder each, numbered from 0 inside the
range. A fence table holds a row per range: its least key, its rows, and the
version of its folder. A position is the place in the range plus the rows of
earlier ranges, so rows that are added shift later ranges in the fence alone.
Only ranges that get rows are read, merged and written anew; one that has grown
too large is split. Former versions stay until ``drop_former``, so a reader of
the last fence, or a run that is lost half way, sees a whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfvec.operators.joins import require_unique
from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

# Rows of a range, about.
RANGE_ROWS = 1_000_000


class PositionStore:
    """Positions by one key column of unique values, under a folder of its own."""

    def __init__(self, spark: SparkSession, path: str, key: str, range_rows: int = RANGE_ROWS):
        self.spark, self.path, self.key, self.range_rows = spark, path.rstrip("/"), key, range_rows
        self.version = -1

    def _fence(self) -> DataFrame:
        """``range, folder, low, rows`` of the last version."""
        return self.spark.read.parquet(f"{self.path}/fence/{self.version}")

    def _data(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")

    def _write(self, rows: DataFrame, kept: DataFrame | None, first: int) -> None:
        """``rows`` (with ``_range``) as folders of the next version, and the fence with them.

        Ranges beyond twice their size are split; new numbers start at ``first``.
        """
        self.version += 1
        size = self.range_rows
        place = F.row_number().over(Window.partitionBy("_range").orderBy(self.key)) - 1
        total = F.count("*").over(Window.partitionBy("_range"))
        # A range is bounded by its size, so these windows are.
        placed = rows.repartition("_range").withColumns({"_place": place.cast("long"), "_total": total})
        piece = F.when(F.col("_total") > 2 * size, F.floor(F.col("_place") / size)).otherwise(F.lit(0)).cast("long")
        placed = placed.withColumn("_piece", piece).withColumn("_place", F.col("_place") - F.col("_piece") * size)
        # The first piece keeps its number, so later rows of smaller keys still find it.
        numbers = placed.where("_piece > 0").select("_range", "_piece").distinct()
        order = Window.orderBy("_range", "_piece")
        named = materialize(numbers.withColumn("_new", F.row_number().over(order) + (first - 1)), "range-numbers")
        placed = placed.join(F.broadcast(named), ["_range", "_piece"], "left")
        placed = placed.withColumn("_range", F.coalesce("_new", "_range").cast("long")).drop("_piece", "_total", "_new")
        out = placed.withColumn("_version", F.lit(self.version))
        out.write.partitionBy("_version", "_range").mode("append").parquet(f"{self.path}/data")
        fresh = (
            self._data()
            .where(F.col("_version") == self.version)
            .groupBy(F.col("_range").cast("long").alias("range"))
            .agg(F.min(self.key).alias("low"), F.count("*").alias("rows"))
            .withColumn("folder", F.lit(self.version))
        )
        whole = fresh if kept is None else fresh.unionByName(kept)
        whole.write.parquet(f"{self.path}/fence/{self.version}")

    def create(self, df: DataFrame) -> None:
        """Store the first rows."""
        require_unique(df, self.key, "the table")
        parts = max(1, -(-df.count() // self.range_rows))
        ranged = materialize(df.repartitionByRange(parts, self.key).withColumn("_range", F.spark_partition_id().cast("long")), "ranges")
        self._write(ranged, None, parts)

    def _with_range(self, df: DataFrame) -> DataFrame:
        """The range that each row's key falls into: the last one that begins at or before it."""
        ensure_shipped(self.spark)
        # A row per range: bounded by the table over the size of a range.
        fence = self._fence().select("low", "range").orderBy("low").toArrow()
        lows, ranges = fence.column("low").to_numpy(), fence.column("range").to_numpy()
        sent = self.spark.sparkContext.broadcast((lows, ranges))

        @F.arrow_udf("long")
        def range_of(keys: pa.Array) -> pa.Array:
            lows, ranges = sent.value
            at = np.searchsorted(lows, keys.to_numpy(zero_copy_only=False), side="right") - 1
            return pa.array(ranges[np.maximum(at, 0)])

        return df.withColumn("_range", range_of(self.key))

    def touched(self, added: DataFrame) -> DataFrame:
        """Stored rows of the ranges that ``added`` (with ``_range``) falls into; others are not read."""
        ranges = [r["_range"] for r in added.select("_range").distinct().collect()]
        found = self._fence().where(F.col("range").isin(*ranges)).collect()
        folders = [f"{self.path}/data/_version={r['folder']}/_range={r['range']}" for r in found]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*folders)

    def append(self, df: DataFrame) -> None:
        """Merge further rows into their ranges; their keys are new."""
        if self.version < 0:
            self.create(df)
            return
        added = materialize(self._with_range(df), "added")
        if added.isEmpty():
            return
        old = self.touched(added).drop("_place", "_version").withColumn("_range", F.col("_range").cast("long"))
        merged = materialize(old.unionByName(added), "merged")
        require_unique(merged, self.key, "the table")
        fence = self._fence()
        first = fence.agg(F.max("range")).first()[0] + 1
        kept = fence.join(added.select(F.col("_range").alias("range")).distinct(), "range", "left_anti")
        self._write(merged, kept, first)

    def positions(self, name: str = "row_id") -> DataFrame:
        """All rows with their position."""
        earlier = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        fence = self._fence().withColumn("_offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        fence = fence.select(F.col("range").alias("_range"), F.col("folder").alias("_version"), "_offset")
        rows = self._data().withColumn("_range", F.col("_range").cast("long"))
        joined = rows.join(F.broadcast(fence), ["_range", "_version"])
        return joined.withColumn(name, F.col("_offset") + F.col("_place")).drop("_range", "_version", "_offset", "_place")

    def drop_former(self) -> None:
        """Delete folders that the last fence does not name."""
        current = {(r["folder"], r["range"]) for r in self._fence().collect()}
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.path}/data")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for version in files.listStatus(root):
            if not version.getPath().getName().startswith("_version="):
                continue
            for folder in files.listStatus(version.getPath()):
                name = folder.getPath().getName()
                if not name.startswith("_range="):
                    continue
                pair = (int(version.getPath().getName().split("=")[1]), int(name.split("=")[1]))
                if pair not in current:
                    files.delete(folder.getPath(), True)
