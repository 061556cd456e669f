"""From product files to the prepared and numbered catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from shelfvec.operators import prepare as P
from shelfvec.operators.numbering import with_positions


def prepare_catalog(
    products: DataFrame, image_dir: str, separator: str = "/", bad_ids: Sequence[int] = P.BAD_IDS
) -> DataFrame:
    """Usable products with their image path; all product columns are kept.

    One scan and no shuffle. Filling blanks keeps nulls, so the null filters
    come first, where they can be pushed into the scan.
    """
    rows = P.drop_null(P.drop_null(products, "title"), "description")
    if bad_ids:
        rows = P.drop_ids(rows, ids=bad_ids)
    rows = P.fill_blanks(rows)
    return rows.withColumn("image_path", P.image_path(image_dir, separator=separator))


def prepare_training(
    products: DataFrame, image_dir: str, excluded: DataFrame | None = None
) -> DataFrame:
    """The stricter variant: no nulls in any text column, listed images left out."""
    rows = P.drop_columns(products)
    rows = P.decode_bytes(P.drop_incomplete(rows))
    if excluded is not None:
        rows = P.drop_listed(rows, excluded)
    return rows.withColumn("image_path", P.image_path(image_dir))


def prepared_columns(catalog: DataFrame) -> DataFrame:
    return catalog.select("nm", "title", "image_path")


def number_catalog(catalog: DataFrame, order_by: Sequence[str] = ("nm",)) -> DataFrame:
    """Positions that tie labels to vectors."""
    return with_positions(catalog, order_by)
