"""Distributed image resizing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvec.functions.pixels import area_mean, rgb_array, shrink_to_fit
from shelfvec.operators.joins import require_unique
from shelfvec.sources.shipping import ensure_shipped

# Fixed value: default target size (width, height).
IMAGE_SIZE = (384, 384)

RESIZED = "nm long, width int, height int, data binary"


def resize_images(
    images: DataFrame, size: tuple[int, int] = IMAGE_SIZE, exact: bool = False
) -> DataFrame:
    """Shrink ``nm, image`` rows to fit ``size``, keeping the aspect ratio.

    ``exact`` ignores the aspect ratio instead. Pixels come back as RGB bytes;
    undecodable images are left out here and painted by ``complete_images``.
    Each image is resized in the task that decoded it, so full-size pixels are
    never shuffled.
    """
    ensure_shipped(images.sparkSession)

    def resize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nm, *source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pixels = rgb_array(*source)
                if pixels is not None:
                    small = area_mean(pixels, size) if exact else shrink_to_fit(pixels, size)
                    rows.append((nm, small.shape[1], small.shape[0], np.ascontiguousarray(small).tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["nm", "width", "height", "data"],
            )

    flat = images.select("nm", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInArrow(resize, RESIZED)


def complete_images(
    manifest: DataFrame, resized: DataFrame, size: tuple[int, int] = IMAGE_SIZE
) -> DataFrame:
    """One picture per manifest row: a black one, flagged ``missing``, where none was read.

    Stops if two pictures have one number. Decoded pixels outgrow any estimate
    made from file sizes, so the pictures are never broadcast.
    """
    require_unique(resized, "nm", "the table of pictures")
    width, height = size
    black = F.unhex(F.repeat(F.lit("00"), 3 * width * height))
    missing = F.col("data").isNull()
    return manifest.join(resized.hint("merge"), "nm", "left").withColumns(
        {
            "missing": missing,
            "width": F.coalesce("width", F.lit(width)),
            "height": F.coalesce("height", F.lit(height)),
            "data": F.when(missing, black).otherwise(F.col("data")),
        }
    )
