"""Tables written once so that later passes read exactly the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session.

    A folder of our own is used only where none is set and all tasks run on
    this machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_roots:
        _own_roots[application] = tempfile.mkdtemp(prefix="shelfvec-")
    return _own_roots[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    application = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/shelfvec/{application}/{label}-{uuid.uuid4().hex}"


def materialize(
    df: DataFrame, label: str = "stage", partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached frame the result survives lost executors, is read with
    column pruning, and carries the file sizes the optimiser needs to choose
    a join strategy. Tables lie under the application id, so that all those of
    a finished application can be deleted together.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    own = f"/shelfvec/{spark.sparkContext.applicationId}/"
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if own not in folder:
            raise ValueError(f"not a table of this application: {folder}")
        _delete(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application has stored; call it at the end of a run."""
    _delete(spark, f"{scratch_root(spark)}/shelfvec/{spark.sparkContext.applicationId}")
