"""Masters written in parts by tasks and joined on commit."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import stack as K
from nightloom.sources import fits


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/masters"


def test_a_drizzled_master_of_three_planes_comes_back(spark):
    rng = np.random.default_rng(1)
    rows = [(m, c, x + 0.3 * m, y + 0.2, float(rng.random()), 1.0) for m in (1, 2) for c in range(3) for y in range(9) for x in range(7)]
    made = K.drizzle(spark.createDataFrame(rows, "master_id int, channel int, px double, py double, v double, weight double"), ["master_id"], 2, 7, 9)
    made = made.select("master_id", "channel", F.col("oy").cast("int").alias("y"), F.col("ox").cast("int").alias("x"), "v")
    to = folder()
    out = {r["master_id"]: r for r in fits.write_masters(made, to, extra=[("OBJECT", "'NGC 7000'", "")], rows=4).collect()}
    assert sorted(os.listdir(to)) == ["1.fits", "2.fits"]
    for m in (1, 2):
        data = open(f"{to}/{m}.fits", "rb").read()
        assert len(data) == out[m]["bytes"] and len(data) % fits.BLOCK == 0
        image = fits.read_image(data)
        own = [r for r in made.collect() if r["master_id"] == m]
        want = np.zeros((3, max(r["y"] for r in own) + 1, max(r["x"] for r in own) + 1))
        for r in own:
            want[r["channel"], r["y"], r["x"]] = r["v"]
        assert image.shape == want.shape
        np.testing.assert_allclose(image, want, rtol=1e-6)
        assert data == fits.image_bytes(want, [("OBJECT", "'NGC 7000'", "")])


def test_bands_without_pixels_are_zero(spark):
    to = folder()
    fits.write_masters(spark.createDataFrame([("a", 1, 20, 3, 7.0)], "master_id string, channel int, y int, x int, v double"), to, rows=4)
    image = fits.read_image(open(f"{to}/a.fits", "rb").read())
    assert image.shape == (2, 21, 4) and image.sum() == 7.0 and image[1, 20, 3] == 7.0


def test_a_failed_task_leaves_nothing(spark):
    to = folder()
    bad = spark.range(100).select(F.lit(1).alias("master_id"), F.lit(0).alias("channel"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0).alias("v"))
    with pytest.raises(Exception, match="lost"):
        fits.write_masters(bad, to, rows=8)
    assert not os.path.exists(to) or os.listdir(to) == []
