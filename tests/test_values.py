"""Values of the queries that have no SQL twin, against plain versions."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom import catalogue
from nightloom.fixtures import view
from nightloom.functions import frames as ff
from nightloom.operators import sky as S
from nightloom.operators import stack as K
from nightloom.plans import sky as plans
from nightloom.sources import fits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def upper(v):
    return sorted(v)[len(v) // 2]


def sigma_of(v):
    m = upper(v)
    return 1.4826 * upper([abs(x - m) for x in v])


def by_frame(rows):
    out = {}
    for r in rows:
        out.setdefault(r["frame_id"], []).append(r)
    return out


def test_every_star_is_in_one_tile_under_the_cap(spark):
    tiles = catalogue.QUERIES["agg_sky_tiles"](spark, SF).collect()
    stars = view(spark, SF, "sky").select("ra", "dec").collect()
    assert sum(t["stars"] for t in tiles) == len(stars) and max(t["stars"] for t in tiles) < 60
    for t in tiles[::7]:
        inside = [s for s in stars if t["ra0"] <= s["ra"] < t["ra1"] and t["dec0"] <= s["dec"] < t["dec1"]]
        assert len(inside) == t["stars"], t


def test_the_plan_covers_the_sphere(spark):
    tiles = S.plan_tiles(spark, -90.0, 30.0).collect()
    for ra in np.linspace(0, 359.9, 25):
        for dec in np.linspace(-89.9, 89.9, 19):
            assert sum(t["ra0"] <= ra < t["ra1"] and t["dec0"] <= dec < t["dec1"] for t in tiles) == 1


def test_star_colours_are_aperture_ratios(spark):
    got = {r["frame_id"]: r for r in catalogue.QUERIES["agg_star_colours"](spark, SF).collect()}
    planes = {}
    for r in view(spark, SF, "pixels").collect():
        planes.setdefault(r["frame_id"], np.zeros((8, 8)))[r["y"], r["x"]] = r["v"]
    want = {}
    for k, p in planes.items():
        rgb = {"r": p[0::2, 1::2], "g": (p[0::2, 0::2] + p[1::2, 1::2]) / 2, "b": p[1::2, 0::2]}
        inside = [(y, x) for y in range(4) for x in range(4) if (x - 1.5) ** 2 + (y - 1.5) ** 2 <= 2.25]
        if max(c[at] for c in rgb.values() for at in inside) >= 2.0:
            continue
        total = {n: sum(c[at] for at in inside) for n, c in rgb.items()}
        if min(total.values()) > 0:
            want[k] = total["r"] / total["g"], total["b"] / total["g"]
    assert set(got) == set(want) and want
    assert all(abs(got[k]["r"] - r) < 2e-6 and abs(got[k]["b"] - b) < 2e-6 for k, (r, b) in want.items())


def test_field_star_white_is_a_clipped_median(spark):
    got = {r["frame_id"]: r for r in catalogue.QUERIES["agg_white_fieldstars"](spark, SF).collect()}
    want = {}
    for k, rows in by_frame(plans.ratios(spark, SF).collect()).items():
        p = [(r["r"], r["b"]) for r in rows]
        if len(p) < 30:
            continue
        m, s = [upper(c) for c in zip(*p, strict=True)], [sigma_of(c) for c in zip(*p, strict=True)]
        for _ in range(3):
            if min(s) <= 0:
                break
            kept = [x for x in p if all(abs(x[c] - m[c]) <= 1.2 * s[c] for c in (0, 1))]
            stop, p = len(kept) < 8 or len(kept) == len(p), kept
            if stop:
                break
            m, s = [upper(c) for c in zip(*p, strict=True)], [sigma_of(c) for c in zip(*p, strict=True)]
        want[k] = (*m, len(p))
    assert set(got) == set(want) and want
    assert all(abs(got[k]["r"] - r) < 2e-6 and abs(got[k]["b"] - b) < 2e-6 and got[k]["used"] == n for k, (r, b, n) in want.items())


def test_catalogue_white_is_a_clipped_line(spark):
    got = {r["frame_id"]: r for r in catalogue.QUERIES["agg_white_catalogue"](spark, SF).collect()}
    frames = by_frame(plans.ratios(spark, SF).collect())
    assert set(got) == set(frames)
    for k, rows in frames.items():
        r = got[k]
        if len(rows) < 30:
            assert r["status"] == "thin" and r["r"] is None and r["scatter_r"] is None and r["span"] is None
            continue
        c = sorted(x["colour"] for x in rows)
        assert r["status"] == "ok" and abs(r["span"] - (c[len(c) * 3 // 4] - c[len(c) // 4])) < 2e-6 and abs(r["colour"] - upper(c)) < 2e-6
        for name in ("r", "b"):
            x, y = np.array([q["colour"] for q in rows]), np.log10([q[name] for q in rows])
            for _ in range(4):
                if len(x) < 8:
                    break
                slope, start = np.polyfit(x, y, 1)
                away = np.abs(y - start - slope * x)
                spread = 1.4826 * upper(away)
                keep = away <= 2.5 * spread
                if keep.all() or keep.sum() < 8:
                    break
                x, y = x[keep], y[keep]
            at = 10 ** (start + 0.82 * slope)
            assert abs(r[name] - at) < 1e-5 and abs(r[f"scatter_{name}"] - at * (10**spread - 1)) < 1e-5


def test_classes_in_their_order(spark):
    rows = [(1, 0, 0, 5, "Light", "GRBG"), (3, 0, 10, None, None, None), (1, 0, 10, None, None, None), (1, 10, 10, None, " Light ", None), (1, 10, 10, None, None, "RGGB")]
    d = spark.createDataFrame(rows, "planes int, width int, height int, n int, kind string, bayer string")
    got = d.select(ff.classify(*[F.col(c) for c in ("planes", "width", "height", "n", "kind", "bayer")]).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [
        ("Master", "STACKCNT = 5, NAXIS3 = 1"),
        ("Master", "NAXIS3 = 3, already colour"),
        ("Unreadable", "no image dimensions"),
        ("Light", "IMAGETYP = Light, single plane, BAYERPAT = none"),
        ("Light", "IMAGETYP = ?, single plane, BAYERPAT = RGGB"),
    ]


def test_empty_share_of_a_drizzle(spark):
    rows = [(1, 0, 1.0, 1.0, 5.0, 1.0), (1, 1, 0.5, 0.5, 5.0, 0.0)]
    out = K.drizzle(spark.createDataFrame(rows, "m int, channel int, px double, py double, v double, weight double"), ["m"], 2, 4, 4)
    cells = out.where("weight > 0").count()
    got = K.drizzle_empty(out, ["m"], 2, 4, 4).first()
    assert cells >= 1 and abs(got["empty_pct"] - 100 * (1 - cells / (3 * 64))) < 1e-9


def test_headers_of_a_folder_and_of_a_table(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.fits").write_bytes(fits.image_bytes(np.zeros((1, 2, 3)), [("OBJECT", f"'M {k}'", "")]))
    (tmp_path / "other.txt").write_text("no header")
    spark.dataSource.register(fits.HeaderSource)
    read = spark.read.format("fits_headers").load(str(tmp_path))
    paths = spark.createDataFrame([(str(tmp_path / f"{k}.fits"),) for k in range(3)] + [(str(tmp_path / "gone.fits"),), (None,)], "path string")
    for headers in (read, fits.headers(paths)):
        f = fits.fields(fits.cards(headers, "path", "header"), "path").collect()
        assert sorted(r["object"] for r in f) == ["M 0", "M 1", "M 2"] and {r["width"] for r in f} == {3}
