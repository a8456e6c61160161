"""Every frame is solved, and its centre found again."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nightloom import catalogue
from nightloom.fixtures import view

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_every_frame_is_solved(spark):
    import numpy as np

    from nightloom.plans.sky import CD

    frames = {r["frame_id"]: r for r in view(spark, SF, "stars").groupBy("frame_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))], F.count("*").alias("n")).collect()}
    got = {r["frame_id"]: r for r in catalogue.QUERIES["fit_plate_solve"](spark, SF).collect()}
    assert set(got) == {k for k, r in frames.items() if r["n"] >= 12} and any(k % 10 for k in got)
    cd = np.array([[CD["cd11"], CD["cd12"]], [CD["cd21"], CD["cd22"]]])
    for k, r in got.items():
        f = frames[k]
        pixel = np.array([(f["lowx"] + f["highx"]) / 2 + 1 - CD["crpix1"], (f["lowy"] + f["highy"]) / 2 + 1 - CD["crpix2"]])
        xi, eta = np.radians(cd @ pixel)
        d0 = np.radians(CD["crval2"])
        ra = CD["crval1"] + np.degrees(np.arctan2(xi, np.cos(d0) - eta * np.sin(d0)))
        dec = np.degrees(np.arctan2(np.sin(d0) + eta * np.cos(d0), np.hypot(xi, np.cos(d0) - eta * np.sin(d0))))
        assert abs(r["crval1"] - ra) < 0.003 and abs(r["crval2"] - dec) < 0.003, k


def test_places_are_projected_once(spark):
    """No filter holds the projection, which would be computed anew for each of its uses there; stars behind the plane take no place."""
    from nightloom.operators import stars as St

    s = spark.range(8).selectExpr("id % 2 frame_id", "radians(double(id * 40 - 70)) + radians(0.5D * id) al", "radians(double(id) - 3) de", "radians(1.0D) d0", "2.0D step", "double(100 - id) flux")
    out = St._on_plane(s, ["frame_id", "parity"], 2)
    assert not [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "COS" in line]
    got = sorted(tuple(r) for r in out.collect())
    want = []
    for frame in (0, 1):
        ids = [k for k in range(8) if k % 2 == frame]
        at = {k: (math.radians(k * 40 - 70) + math.radians(0.5 * k), math.radians(k - 3), math.radians(1.0)) for k in ids}
        cosc = {k: math.sin(d0) * math.sin(de) + math.cos(d0) * math.cos(de) * math.cos(al) for k, (al, de, d0) in at.items()}
        for place, k in enumerate([k for k in ids if cosc[k] > 1e-6][:2], 1):
            al, de, d0 = at[k]
            xi, y = (math.degrees(v / cosc[k]) * 3600 / 2 for v in (math.cos(de) * math.sin(al), math.cos(d0) * math.sin(de) - math.sin(d0) * math.cos(de) * math.cos(al)))
            want += [(frame, parity, place, xi * parity, y) for parity in (-1, 1)]
    assert len(got) == len(want) and any(k * 40 - 70 + 0.5 * k > 91 for k in range(8))
    assert all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9) for a, b in zip(got, sorted(want)))
