"""Feature columns for the classifiers."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from shelfvec.operators.similarity import concat_vectors

# Feature sets and numbers of components.
TEXT, IMAGE, COMBINED, REDUCED = "Text", "Image", "Combined", "PCA"
FEATURE_SETS = (TEXT, IMAGE, COMBINED, REDUCED)
COMPONENTS = 10
PROJECTION_COMPONENTS = 3


def vector_columns(df: DataFrame, text: str = "text", img: str = "img") -> DataFrame:
    """Text, Image and Combined feature vectors in place of the two arrays."""
    # Column names ignore case, so the inputs cannot stay beside the outputs.
    others = [name for name in df.columns if name not in (text, img)]
    return df.select(
        *others,
        array_to_vector(text).alias(TEXT),
        array_to_vector(img).alias(IMAGE),
        array_to_vector(concat_vectors(text, img)).alias(COMBINED),
    )


def fit_standardizer(df: DataFrame, column: str, output: str) -> PipelineModel:
    """Zero mean and unit population deviation; a constant component becomes 0.

    Spark divides by the sample deviation, so a constant factor follows.
    """
    scaler = StandardScaler(inputCol=column, outputCol=f"{output}_sample", withMean=True)
    model = scaler.fit(df)
    rows = df.count()
    factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    rescale = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * model.mean.size),
        inputCol=f"{output}_sample",
        outputCol=output,
    )
    return PipelineModel([model, rescale])


def standardize(
    df: DataFrame, column: str, output: str, fit: DataFrame | None = None
) -> DataFrame:
    """Standardised by the values of ``fit``, of the table itself by default."""
    scaler = fit_standardizer(df if fit is None else fit, column, output)
    return scaler.transform(df).drop(f"{output}_sample")


def reduce_dimensions(
    df: DataFrame,
    column: str = COMBINED,
    output: str = REDUCED,
    components: int = COMPONENTS,
    fit: DataFrame | None = None,
) -> DataFrame:
    """Principal components of the standardised vectors, at most as many as their width.

    Spark projects without centring, so the standardised column goes in. The
    covariance matrix is summed over partitions; only width squared numbers
    reach the driver. Scaling and axes come from ``fit``, the table by default.
    """
    source = df if fit is None else fit
    scaler = fit_standardizer(source, column, "_standard")
    width = scaler.stages[0].mean.size
    axes = PCA(k=min(components, width), inputCol="_standard", outputCol=output)
    model = axes.fit(scaler.transform(source))
    return model.transform(scaler.transform(df)).drop("_standard", "_standard_sample")
