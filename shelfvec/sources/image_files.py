"""A data source over listed files: its partitions are slices of the list.

Paths come from a table, so no folder is listed, however many files there are
and wherever they lie. The list is stored as so many part files; a partition
names one of them, and its task reads the paths there and opens each file.
Files that do not exist come back flagged. Paths are those that pyarrow's file
systems open: local ones, ``file:``, ``hdfs:``, ``s3:``, ``gs:``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.functions.pixels import png_pixels
from shelfvec.sources.scratch import fresh_path
from shelfvec.sources.shipping import ensure_shipped

FORMAT = "listed_files"
SCHEMA = "path string, content binary, missing boolean"

# Files of a slice, and bytes of a batch that a task hands on.
SLICE_FILES = 2_000
BATCH_BYTES = 16 * 1024 * 1024

# The image source's codes for one, three and four channels of bytes.
MODES = {1: 0, 3: 16, 4: 24}
IMAGE = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        *[T.StructField(n, T.IntegerType()) for n in ("height", "width", "nChannels", "mode")],
        T.StructField("data", T.BinaryType()),
    ]
)


def _source() -> type:
    """The data source's class, made in a function so that it travels by value."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Slice(InputPartition):
        def __init__(self, file: str):
            self.file = file

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.manifest = options["manifest"]

        def partitions(self) -> list:
            from pyarrow import fs

            system, root = fs.FileSystem.from_uri(self.manifest)
            # One entry per slice; the files themselves are not looked at.
            parts = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
            return [Slice(p) for p in parts] or [Slice("")]

        def read(self, partition) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa
            import pyarrow.parquet as pq
            from pyarrow import fs

            names = ["path", "content", "missing"]

            def batch(rows: list[tuple]) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.binary(), pa.bool_()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

            if not partition.file:
                return
            system, _ = fs.FileSystem.from_uri(self.manifest)
            with system.open_input_file(partition.file) as listed:
                paths = pq.read_table(listed, columns=["path"]).column("path").to_pylist()
            rows, held = [], 0
            for path in paths:
                content = None
                try:
                    own, place = fs.FileSystem.from_uri(path)
                    with own.open_input_stream(place) as file:
                        content = file.read()
                except (FileNotFoundError, IsADirectoryError):
                    pass
                rows.append((path, content, content is None))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    class ListedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return ListedFiles


def _uri(path: str) -> str:
    # Spark writes a local path with one slash after its scheme.
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def read_listed_files(listed: DataFrame, path_col: str = "image_path", slice_files: int = SLICE_FILES) -> DataFrame:
    """``path, content, missing``: a row for each distinct path that a table lists.

    The content of a file that does not exist is null, and ``missing`` is true.
    Null paths are no paths. Paths are given with their full folder.
    """
    spark = listed.sparkSession
    ensure_shipped(spark)
    spark.dataSource.register(_source())
    path = F.regexp_replace(path_col, "^file:/(?!/)", "file:///")
    paths = listed.select(path.alias("path")).where("path IS NOT NULL").distinct()
    target = fresh_path(spark, "manifest")
    slices = max(1, -(-paths.count() // slice_files))
    paths.repartition(slices, F.xxhash64("path")).write.parquet(target)
    return spark.read.format(FORMAT).option("manifest", _uri(target)).load()


def decode_images(files: DataFrame, decode: Callable[[bytes], np.ndarray | None] = png_pixels) -> DataFrame:
    """``nm, image, missing`` of ``read_listed_files``, in the shape of the image source.

    ``decode`` makes rows by columns by channels of bytes, blue, green and red
    last to first as that source has them, or None for what it cannot read:
    such images, and missing ones, have sizes of -1. ``nm`` is the leading
    number of the file's name, null for any other name. The decoder given reads
    PNG; pass another for other formats. It runs where the file was read.
    """
    ensure_shipped(files.sparkSession)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("image", IMAGE), T.StructField("missing", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, content, missing = (batch.column(n)[row].as_py() for n in ("path", "content", "missing"))
                pixels = None if missing else decode(content)
                if pixels is None:
                    image = (path, -1, -1, -1, -1, b"")
                else:
                    tall, wide, channels = pixels.shape
                    image = (path, tall, wide, channels, MODES[channels], np.ascontiguousarray(pixels).tobytes())
                kinds = [pa.string(), *[pa.int32()] * 4, pa.binary()]
                parts = [pa.array([v], k) for v, k in zip(image, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.StructArray.from_arrays(parts, IMAGE.names), pa.array([missing])], names=schema.names)

    decoded = files.mapInArrow(run, schema)
    number = F.split(F.element_at(F.split("path", "/"), -1), r"\.")[0].try_cast("long")
    return decoded.select(number.alias("nm"), "image", "missing")
