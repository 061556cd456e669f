from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfvec.functions import pixels as X
from shelfvec.operators import encode as E
from shelfvec.operators import resize as Z
from shelfvec.operators import similarity as S
from shelfvec.operators.joins import gather
from shelfvec.plans.embedding import embed_catalog, store_embeddings
from shelfvec.sources.image_files import decode_images, read_listed_files
from shelfvec.sources.images import read_images, read_listed_images
from shelfvec.sources.vectors import read_bucketed, read_vectors, write_bucketed
from suite.onnx_model import matmul_model, weight


def length_encoder():
    class Lengths:
        def text(self, values):
            return np.array([[len(v), len(values)] for v in values], dtype=float)

        def image(self, values):
            return np.array([[v.shape[1], v.shape[0], v[0, 0, 0], v[0, 0, 2]] for v in values], dtype=float)

    return Lengths()


def picture(height, width, fill=7):
    return {"height": height, "width": width, "data": bytes([fill, 0, 9] * (height * width))}


PICTURE = "struct<height: int, width: int, data: binary>"


def test_encode_keeps_rows_together(spark):
    rows = [(i, "x" * i, picture(1, i + 1)) for i in range(50)]
    df = spark.createDataFrame(rows, f"row_id long, title string, picture {PICTURE}")
    for parts in (1, 7):
        out = E.encode(df.repartition(parts), length_encoder, batch_size=4).collect()
        assert len(out) == 50
        for r in out:
            assert r.text[0] == r.row_id and r.text[1] <= 4
            assert list(r.img) == [r.row_id + 1, 1, 7, 9]


def test_onnx_scores_match_numpy(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(20, 6))
    df = spark.createDataFrame(
        [(i, row.tolist(), row[:4].tolist()) for i, row in enumerate(data)],
        "row_id long, a array<double>, b array<double>",
    )
    factory = E.onnx_factory(spark, matmul_model(6, 3), matmul_model(4, 2))
    out = E.encode(df, factory, "a", "b", batch_size=7, element="double").collect()
    table = np.array([[weight(i, j) for j in range(3)] for i in range(6)])
    for r in out:
        np.testing.assert_allclose(r.text, data[r.row_id] @ table, atol=1e-12)
        np.testing.assert_allclose(r.img, data[r.row_id][:4] @ table[:4, :2], atol=1e-12)


def test_vector_report(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0]), ([1.0, 2.0], [1.0])], "text array<float>, img array<float>")
    assert tuple(E.vector_report(df).first()) == (2, 1, 2, 1, 2)


def test_normalize_edges(spark):
    rows = [(0, [3.0, 4.0]), (1, []), (2, None), (3, [0.0, 0.0]), (4, [2.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>").coalesce(1)
    got = {r.i: r.u for r in df.select("i", S.l2_normalize("v").alias("u")).collect()}
    assert got[0] == [0.6, 0.8] and got[1] == [] and got[2] is None and got[4] == [1.0]
    assert all(math.isnan(x) for x in got[3])


def pairs(spark, n):
    eye = np.eye(4)
    rows = [(i, eye[i % 4].tolist(), eye[i % 4].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, text array<double>, img array<double>").repartition(3)


def test_logits_of_orthogonal_pairs_and_short_last_batch(spark):
    out = {r.row_id: r for r in S.batch_logits(pairs(spark, 7), 4, logit_scale=2.0).collect()}
    assert out[1].logits_per_image == [0.0, 2.0, 0.0, 0.0]
    assert out[6].batch_id == 1 and out[6].logits_per_text == [0.0, 0.0, 2.0]


def test_loss_in_closed_form(spark):
    scale = 2.0
    out = {r.batch_id: r for r in S.contrastive_loss(pairs(spark, 7), 4, scale).collect()}
    for batch, n in ((0, 4), (1, 3)):
        want = math.log(math.exp(scale) + n - 1) - scale
        assert out[batch].n == n
        assert math.isclose(out[batch].loss, want) and math.isclose(out[batch].text_loss, want)


def test_logits_are_not_symmetric(spark):
    rows = [(0, [1.0, 0.0], [1.0, 1.0]), (1, [0.0, 1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, text array<double>, img array<double>")
    out = {r.row_id: r for r in S.batch_logits(df, 2, logit_scale=1.0).collect()}
    half = math.sqrt(0.5)
    np.testing.assert_allclose(out[0].logits_per_image, [half, half])
    np.testing.assert_allclose(out[0].logits_per_text, [half, 1.0])


def test_repeated_positions_are_refused(spark):
    twice = pairs(spark, 4).union(pairs(spark, 4))
    with pytest.raises(Exception, match="positions are not unique"):
        S.batch_logits(twice, 4).collect()


def test_batches_use_no_product_join(spark, plan_of):
    plan = plan_of(S.batch_logits(pairs(spark, 8), 4))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join" not in plan


def test_fitted_sizes():
    assert X.fitted_size(800, 400, (384, 384)) == (384, 192)
    assert X.fitted_size(400, 800, (384, 384)) == (192, 384)
    assert X.fitted_size(100, 50, (384, 384)) == (100, 50)
    assert X.fitted_size(5000, 2, (384, 384)) == (384, 1)


def test_flat_pictures_stay_flat():
    flat = np.full((37, 53, 3), 200, dtype=np.uint8)
    for out in (X.shrink_to_fit(flat, (10, 10)), X.area_mean(flat, (91, 17))):
        assert (out == 200).all()


def test_area_means():
    pixels = np.arange(15, dtype=np.uint8).reshape(3, 5, 1)
    # One and a half rows and two and a half columns each, halves up.
    rows = np.array([[2, 1, 0], [0, 1, 2]]) / 3
    columns = np.array([[2, 2, 1, 0, 0], [0, 0, 1, 2, 2]]) / 5
    want = np.floor(rows @ pixels[:, :, 0] @ columns.T + 0.5)
    assert X.area_mean(pixels, (2, 2))[:, :, 0].tolist() == want.tolist()
    assert X.area_mean(pixels, (5, 3)) is pixels
    assert X.area_mean(pixels[:1, :2], (4, 1))[0, :, 0].tolist() == [0, 0, 1, 1]


def test_pictures_do_not_cross_an_exchange(spark, image_dir, plan_of):
    catalog = spark.createDataFrame([(0, 1, "one")], "row_id long, nm long, title string")
    plan = plan_of(embed_catalog(catalog, read_images(spark, image_dir), length_encoder, "m", size=(16, 16)))
    assert "picture" not in plan and "data#" not in plan


def test_two_pictures_of_one_number_are_refused(spark, image_dir):
    images = read_images(spark, image_dir)
    manifest = spark.createDataFrame([(0, 1, "one")], "row_id long, nm long, title string")
    with pytest.raises(ValueError, match="repeats"):
        Z.complete_images(manifest, Z.resize_images(images.union(images)))
    with pytest.raises(ValueError, match="repeats"):
        embed_catalog(manifest, images.union(images), length_encoder, "m", size=(16, 16))


def test_channel_order():
    bgr = bytes([1, 2, 3, 4, 5, 6])
    assert X.rgb_array(1, 2, 3, bgr).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert X.rgb_array(1, 1, 4, bytes([1, 2, 3, 9])).tolist() == [[[3, 2, 1]]]
    assert X.rgb_array(1, 2, 1, bytes([5, 6])).tolist() == [[[5, 5, 5], [6, 6, 6]]]
    assert X.rgb_array(-1, -1, -1, b"") is None


@pytest.fixture(scope="module")
def image_dir(spark, tmp_path_factory):
    """PNG and JPEG files written by the JVM, and one that is no image."""
    folder = tmp_path_factory.mktemp("images")
    java = spark.sparkContext._jvm
    for name, width, height, kind in (
        ("1.png", 80, 40, "png"), ("2.jpg", 20, 20, "jpg"), ("3.png", 10, 5, "png"),
    ):
        image = java.java.awt.image.BufferedImage(width, height, 5)
        graphics = image.createGraphics()
        graphics.setColor(java.java.awt.Color(250, 100, 10))
        graphics.fillRect(0, 0, width, height)
        java.javax.imageio.ImageIO.write(image, kind, java.java.io.File(str(folder / name)))
    (folder / "4.jpg").write_bytes(b"not an image")
    return str(folder)


def test_read_and_resize_files(spark, image_dir):
    images = read_images(spark, image_dir)
    sizes = {r.nm: (r.image.width, r.image.height) for r in images.collect()}
    assert sizes == {1: (80, 40), 2: (20, 20), 3: (10, 5), 4: (-1, -1)}
    shrunk = {r.nm: r for r in Z.resize_images(images, (16, 16)).collect()}
    assert {k: (r.width, r.height) for k, r in shrunk.items()} == {1: (16, 8), 2: (16, 16), 3: (10, 5)}
    assert shrunk[1].data[:3] == bytes([250, 100, 10])
    for a, b in zip(shrunk[2].data[:3], (250, 100, 10)):
        assert abs(a - b) < 8
    exact = {r.nm: (r.width, r.height) for r in Z.resize_images(images, (16, 16), exact=True).collect()}
    assert exact == {1: (16, 16), 2: (16, 16), 3: (16, 16)}


def test_stray_and_unlisted_files(spark, image_dir, tmp_path):
    for name in ("1.png", "3.png"):
        (tmp_path / name).write_bytes((Path(image_dir) / name).read_bytes())
    (tmp_path / "Thumbs.db").write_bytes(b"x")
    assert sorted(r.nm for r in read_images(spark, str(tmp_path)).collect()) == [1, 3]
    paths = [f"{tmp_path}/1.png", f"file://{tmp_path}/1.png", f"{tmp_path}/9.png", f"{image_dir}/4.jpg", None]
    listed = spark.createDataFrame([(p,) for p in paths], "image_path string")
    got = sorted((r.nm, r.image.width) for r in read_listed_images(listed).collect())
    assert got == [(1, 80), (4, -1)]
    assert read_listed_images(listed.where("false")).count() == 0


def test_listed_files_by_slices_of_the_list(spark, image_dir, plan_of):
    """No folder is listed; missing files are flagged; PNG pixels equal the image source's."""
    paths = [f"{image_dir}/1.png", f"file://{image_dir}/3.png", f"{image_dir}/3.png", f"{image_dir}/9.png", f"{image_dir}/4.jpg", f"{image_dir}/2.jpg", None]
    listed = spark.createDataFrame([(p,) for p in paths], "image_path string")
    files = read_listed_files(listed, slice_files=2)
    assert files.rdd.getNumPartitions() >= 2 and "FileScan" not in plan_of(files)
    got = {r.path: r for r in files.collect()}
    assert set(got) == set(paths) - {None}
    assert {p for p, r in got.items() if r.missing} == {f"{image_dir}/9.png"}
    assert got[paths[0]].content == Path(paths[0]).read_bytes() and got[paths[3]].content is None
    images = decode_images(files)
    known = {r.nm: r.image for r in read_images(spark, image_dir).collect()}
    for r in images.collect():
        shape = (r.image.height, r.image.width, r.image.nChannels, r.image.mode, r.image.data)
        want = known[r.nm] if r.nm in (1, 3) else None
        assert shape == (tuple(want[1:]) if want else (-1, -1, -1, -1, b"")) and r.missing == (r.nm == 9)
    shrunk = Z.resize_images(images.where("nm = 1").select("nm", "image"), (16, 16)).first()
    assert (shrunk.width, shrunk.height) == (16, 8)
    assert read_listed_files(listed.where("false")).collect() == []


@pytest.mark.parametrize("kind", [1, 2, 5, 6, 10, 13])
def test_png_kinds_equal_the_image_source(spark, tmp_path, kind):
    """Grey, indexed, colour with and without alpha, with noise that makes the encoder use its filters."""
    java = spark.sparkContext._jvm
    image = java.java.awt.image.BufferedImage(23, 17, kind)
    draw = random.Random(kind)
    for y in range(17):
        for x in range(23):
            image.setRGB(x, y, (255 << 24 | (x * 9 << 16) | (y * 13 << 8) | draw.randrange(60)) - (1 << 32))
    java.javax.imageio.ImageIO.write(image, "png", java.java.io.File(str(tmp_path / "5.png")))
    data = (tmp_path / "5.png").read_bytes()
    want = read_images(spark, str(tmp_path)).first().image
    got = X.png_pixels(data)
    np.testing.assert_array_equal(X.rgb_array(*got.shape, np.ascontiguousarray(got).tobytes()), X.rgb_array(want.height, want.width, want.nChannels, want.data))
    assert X.png_pixels(b"") is None and X.png_pixels(data[:20]) is None and X.png_pixels(b"GIF89a") is None


def test_pictures_are_never_broadcast(spark, image_dir, plan_of):
    manifest = spark.createDataFrame([(1,)], "nm long")
    plan = plan_of(Z.complete_images(manifest, Z.resize_images(read_images(spark, image_dir))))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_missing_pictures_are_black(spark, image_dir):
    manifest = spark.createDataFrame([(1,), (4,), (99,)], "nm long")
    out = {r.nm: r for r in Z.complete_images(manifest, Z.resize_images(read_images(spark, image_dir))).collect()}
    assert not out[1].missing and out[4].missing and out[99].missing
    assert (out[4].width, out[4].height) == (384, 384)
    assert out[99].data == bytes(3 * 384 * 384)


def test_catalog_to_store_and_back(spark, image_dir, tmp_path, plan_of):
    catalog = spark.createDataFrame(
        [(0, 1, "one"), (1, 4, "four"), (2, 3, "three")], "row_id long, nm long, title string"
    )
    images = read_images(spark, image_dir)
    for model in ("base", "tuned"):
        vectors = embed_catalog(catalog, images, length_encoder, model, size=(16, 16))
        store_embeddings(vectors, str(tmp_path / "store"))
    read = read_vectors(spark, str(tmp_path / "store"), ["tuned"])
    out = {r.row_id: r for r in read.collect()}
    assert {r.model for r in out.values()} == {"tuned"}
    assert [out[i].text[0] for i in range(3)] == [3, 4, 5]
    assert list(out[0].img) == [16, 8, 250, 10] and list(out[1].img) == [16, 16, 0, 0]
    plan = plan_of(read.select("row_id", F.size("text")))
    assert "(model#" in plan.split("PartitionFilters")[1] and "img" not in plan.split("ReadSchema")[1]


def test_bucketed_store_joins_without_moving_vectors(spark, tmp_path, plan_of):
    rows = spark.range(200).selectExpr(
        "'m' AS model", "id AS row_id", "array(CAST(id AS float)) AS text", "array(1.0f) AS img"
    )
    spark.sql("DROP TABLE IF EXISTS bucketed_vectors")
    write_bucketed(rows, "bucketed_vectors", 4, str(tmp_path / "b"))
    store = read_bucketed(spark, "bucketed_vectors", ["m"])
    labels = spark.range(0, 200, 2).selectExpr("id AS row_id", "1 AS target")
    joined = gather(labels, store.hint("merge"), limit_bytes=-1)
    plan = plan_of(joined)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert sorted(r.text[0] for r in joined.collect()) == [float(i) for i in range(0, 200, 2)]
    spark.sql("DROP TABLE bucketed_vectors")
