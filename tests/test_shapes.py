"""Reading order, rasters and sketches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions import raster
from inkveil.operators import images, layout, metrics


def test_reading_order_of_two_columns_under_a_gap(spark):
    rng = random.Random(1)
    rows, want = [], []
    for column in range(2):
        for line in range(12):
            x = 300.0 * column
            for k in range(5):
                width, drop = rng.uniform(10, 40), rng.uniform(-2, 2)
                word = f"w{column}-{line}-{k}"
                rows.append((1, word, x, 20 * line + drop, x + width, 20 * line + drop + 10))
                want.append((word, column, line, k))
                x += width + rng.uniform(1, 8)
    rows.append((2, "alone", 0.0, 0.0, 5.0, 10.0))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id int, word string, x0 double, y0 double, x1 double, y1 double")
    read = layout.reading_order(df).filter("page_id = 1").orderBy("seq").collect()
    assert [(r.word, r.column_no, r.line_no, r.pos) for r in read] == want
    assert [r.seq for r in read] == list(range(len(want)))
    assert layout.reading_order(df.limit(0)).collect() == []


def test_all_filters_and_colours_give_the_raster():
    rng = np.random.default_rng(2)
    grey = rng.integers(0, 256, (9, 13), dtype=np.uint8)
    hashes = set()
    for kind in range(5):
        for level in (0, 9):
            content = raster.encoded(grey, kind, level)
            assert (raster.decoded(content) == np.repeat(grey[:, :, None], 3, axis=2)).all(), kind
            hashes.add(raster.hash_of(content))
    assert len(hashes) == 1
    assert raster.hash_of(raster.encoded(grey.T.copy())) not in hashes and raster.hash_of(None) is None
    assert raster.hash_of(raster.encoded(grey.reshape(13, 9))) not in hashes  # the same bytes, another shape


@pytest.mark.parametrize("content", [b"", b"abc", raster.SIGNATURE, raster.SIGNATURE + b"\0\0\0\rIHDR", raster.encoded(np.zeros((2, 2), np.uint8))[:-20]])
def test_what_cannot_be_decoded_has_the_hash_of_its_bytes(content):
    import hashlib

    assert raster.hash_of(content) == hashlib.sha256(content).hexdigest()


def test_first_of_equal_pixels(spark):
    grey = np.arange(64, dtype=np.uint8).reshape(8, 8)
    rows = [(3, raster.encoded(grey, 0)), (1, raster.encoded(grey, 2)), (2, raster.encoded(grey, 4, 1)), (5, raster.encoded(grey + 1)), (6, b"x")]
    df = spark.createDataFrame(rows, "image_id long, content binary")
    assert sorted(r.image_id for r in images.first_of_equal(df, F.col("content"), "image_id", pixels=True).collect()) == [1, 5, 6]
    assert images.first_of_equal(df, F.col("content"), "image_id").count() == 5


def test_merged_sketches_keep_their_bound(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=20_000), rng.exponential(50, 20_000)])
    df = spark.createDataFrame([(int(i % 37), float(v)) for i, v in enumerate(values)], "part int, value double").withColumn("key", F.lit("k"))
    merged = metrics.merged(metrics.sketches(df, ["key", "part"], "value"), ["key"])
    row = metrics.sketched_percentiles(merged, (0.01, 0.5, 0.9, 0.99)).first()
    assert row.n == len(values)
    for p in (0.01, 0.5, 0.9, 0.99):
        assert abs((values <= row[f"p{round(100 * p)}"]).mean() - p) < 0.02
    assert merged.select(F.length("sketch")).first()[0] < 20_000
