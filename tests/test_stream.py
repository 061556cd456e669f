from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfvec.schemas import PRODUCT
from shelfvec.streaming.catalog import arriving_products, encode_arriving, prepare_arriving


def sizes():
    class Sizes:
        def text(self, values):
            return np.array([[len(v)] for v in values], dtype=float)

        image = text

    return Sizes()


def test_files_are_prepared_and_encoded_as_they_arrive(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "title", "text", "c", "s", True, "b"), (2, None, "text", "c", "s", True, "b")]
    spark.createDataFrame(rows, PRODUCT).write.parquet(source)
    ready = prepare_arriving(arriving_products(spark, source), "/img")
    coded = encode_arriving(ready, sizes, "title", "description", "m")

    def run():
        stream = (
            coded.writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start(out)
        )
        stream.awaitTermination()
        return sorted((r.nm, r.model, r.text[0]) for r in spark.read.parquet(out).collect())

    assert run() == [(1, "m", 5.0)]
    more = spark.createDataFrame(rows[:1], PRODUCT).withColumn("nm", F.lit(7).cast("long"))
    more.write.mode("append").parquet(source)
    assert run() == [(1, "m", 5.0), (7, "m", 5.0)]
