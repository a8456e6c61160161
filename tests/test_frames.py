"""Planted truth for the NumPy steps, and the reference's small cases."""

import numpy as np
from pyspark.sql import functions as F

from nightloom.functions import develop as D
from nightloom.functions import frames as ff
from nightloom.operators import pixels as P
from nightloom.operators import sky as S
from nightloom.operators import stack as K
from nightloom.operators import stars as St
from nightloom.operators import tiles as Ti
from nightloom.operators import triage as T
from nightloom.sources import fits, tables


def noise(n, seed=1):
    out, x = np.empty(n), seed
    for k in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out[k] = x / 2**32
    return out


def plane_rows(spark, plane, frame_id=1):
    yy, xx = np.indices(plane.shape)
    return spark.createDataFrame([(frame_id, int(y), int(x), float(v)) for y, x, v in zip(yy.ravel(), xx.ravel(), plane.ravel(), strict=True)], "frame_id long, y int, x int, v double")


def test_night_is_noon_to_noon(spark):
    times = ["2024-03-01 11:59:00", "2024-03-01 12:00:00", "2024-03-01 23:06:00", "2024-03-02 03:48:00"]
    d = spark.createDataFrame([(t,) for t in times], "t string").select(ff.night(F.to_timestamp("t")).cast("string").alias("n"))
    assert [r["n"] for r in d.collect()] == ["2024-02-29", "2024-03-01", "2024-03-01", "2024-03-01"]


def test_quality_of_small_nights(spark):
    rows = [(1, "a", 100, 1), (2, "a", 900, 2), (3, "a", 500, 3), (4, "b", 10, 4), (5, "b", 20, 5), (6, "c", 7, 6)]
    q = T.quality(spark.createDataFrame(rows, "frame_id long, night string, stars long, second long"))
    assert {r["frame_id"]: r["quality"] for r in q.collect()} == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.0, 5: 1.0, 6: 1.0}


def test_twilight_and_cloud(spark):
    stars = [900] * 20 + [300] * 5 + [900] * 20 + [100] * 8
    rows = [(1, "n", k * 60, k, s) for k, s in enumerate(stars)]
    e = T.sky_events(spark.createDataFrame(rows, "project_id long, night string, second long, frame_id long, stars long"))
    assert {(r["label"], r["start"], r["end"]) for r in e.collect()} == {("thin cloud", 1200, 1440), ("astronomical twilight", 2700, 3120)}


def test_narrowband_names(spark):
    narrow, broad = ["Ha", "OIII", "L-eXtreme", "dual-band", "IDAS NBZ", "S II"], ["", "LP", "IRCUT", "UV/IR cut", "Luminance", "Red"]
    d = spark.createDataFrame([(n,) for n in narrow + broad], "n string").select(ff.is_narrowband(F.col("n")).alias("b"))
    assert [r["b"] for r in d.collect()] == [True] * 6 + [False] * 6


def test_mtf_undoes_itself(spark):
    d = spark.range(1, 1000).select((F.col("id") / 1000).alias("x")).withColumn("y", D.mtf(F.lit(0.02), F.col("x")))
    worst = d.select(F.max(F.abs(D.mtf(F.lit(0.98), F.col("y")) - F.col("x")))).first()[0]
    assert worst < 1e-9


def test_demosaic_of_a_flat_colour():
    plane = np.array([[10.0, 20.0], [30.0, 10.0]]).repeat(1, 0)
    rgb = P.demosaic(np.tile(plane, (4, 4)))
    assert np.allclose(rgb[2:-2, 2:-2], [20, 10, 30])


def test_half_debayer_patterns(spark):
    p = plane_rows(spark, np.array([[10.0, 20.0], [30.0, 40.0]]))
    assert [tuple(r[c] for c in "rgb") for r in P.debayer_half(p).collect()] == [(20.0, 25.0, 30.0)]
    assert [tuple(r[c] for c in "rgb") for r in P.debayer_half(p, "RGGB").collect()] == [(10.0, 25.0, 40.0)]


def test_background_of_a_gradient(spark):
    y, x = np.indices((96, 96))
    plane = 0.05 + 0.0005 * x + 0.0002 * y + 0.0005 * noise(96 * 96).reshape(96, 96)
    plane[::17, ::13] += 0.5
    rows = plane_rows(spark, plane)
    model = P.fit_background(P.clipped_tiles(rows, 8, 96, 96), 8, 96, 96)
    flat = P.subtract_background(rows, model, 96, 96)
    tiles = P.clipped_tiles(flat, 8, 96, 96).agg(F.max("median") - F.min("median")).first()[0]
    assert tiles < 0.1 * (95 * 0.0007)


def test_bulk_stack_is_the_long_form(spark):
    cube = noise(9 * 64).reshape(9, 8, 8)
    cube[3, 2, 2] = 50
    weights = np.linspace(1, 2, 9)
    value, clipped = K.combine(cube, weights, 2.0, 2.0, np.arange(9))
    rows = [(int(y), int(x), float(cube[f, y, x]), float(weights[f])) for f in range(9) for y in range(8) for x in range(8)]
    long = K.sigma_clip(spark.createDataFrame(rows, "y int, x int, v double, weight double"), ["y", "x"], 2.0, 2.0).collect()
    assert all(abs(r["v"] - value[r["y"], r["x"]]) < 1e-9 and r["clipped"] == clipped[r["y"], r["x"]] for r in long)


def test_catmull_rom_keeps_whole_shifts_and_planes():
    y, x = np.indices((12, 12))
    plane = 3.0 * x - 2.0 * y
    out = Ti.catmull_rom(plane, x + 0.25, y + 0.5)
    assert np.isnan(out[0, 0]) and np.allclose(out[3:8, 3:8], (3 * (x + 0.25) - 2 * (y + 0.5))[3:8, 3:8])


def blobs_of(mask):
    """The first pixel of each pixel's blob, by flooding."""
    first, todo = {}, [tuple(p) for p in np.argwhere(mask).tolist()]
    for p in todo:
        stack = [p] if p not in first else []
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and (y, x) not in first:
                first[y, x] = p
                stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return first


def test_labels_join_across_rows(spark):
    spiral = ["###########", "..........#", "#########.#", "#.......#.#", "#.#####.#.#", "#.#...#.#.#", "#.#.###.#.#", "#.#.....#.#", "#.#######.#", "#.........#", "###########", "...........", "#..#.#.#..#", ".##.#.#.##."]
    masks = [np.array([[c == "#" for c in row] for row in spiral]), noise(30 * 30, 8).reshape(30, 30) > 0.6, noise(30 * 30, 9).reshape(30, 30) > 0.85]
    rows = [(k, y, x) for k, m in enumerate(masks) for y, x in np.argwhere(m).tolist()]
    got = {(r["frame_id"], r["y"], r["x"]): tuple(r["first"]) for r in St.labelled(spark.createDataFrame(rows, "frame_id long, y int, x int")).collect()}
    assert got == {(k, *p): f for k, m in enumerate(masks) for p, f in blobs_of(m).items()}


def test_detects_planted_stars(spark):
    y, x = np.indices((64, 64))
    plane = 0.01 + 0.001 * (noise(64 * 64).reshape(64, 64) - 0.5)
    for cx, cy in ((15.3, 20.6), (40.0, 44.2)):
        plane += 0.5 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 1.5**2))
    found = sorted((r["x"], r["y"]) for r in St.detect(plane_rows(spark, plane)).collect())
    assert len(found) == 2 and np.allclose(found, [(15.3, 20.6), (40.0, 44.2)], atol=0.2)


def scene(n, seed):
    p = noise(3 * n, seed).reshape(n, 3)
    return p[np.argsort(-p[:, 2])][:, :2] * 1000


def test_registration_finds_and_refuses(spark):
    """Frames with a third of the stars gone, with noise, at half a turn, against themselves; and one of another field."""
    ref = scene(130, 5)
    cases = {1: (3.5, 22.0, -13.0, 0.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (180.0, 900.0, 1000.0, 0.2), 4: (-40.0, -55.5, 610.0, 0.4)}
    rows = [(9, float(x), float(y), float(-k)) for k, (x, y) in enumerate(scene(130, 77))]
    for frame, (turn, tx, ty, blur) in cases.items():
        c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
        u, v = ref[:, 0] - tx, ref[:, 1] - ty
        jitter = blur * (noise(260, frame).reshape(130, 2) - 0.5)
        src = np.stack([c * u + s * v, -s * u + c * v], axis=1) + jitter
        rows += [(frame, float(x), float(y), float(-k)) for k, (x, y) in enumerate(src) if k < 5 or k % 3]
    source = spark.createDataFrame(rows, "frame_id long, x double, y double, flux double")
    list_ = spark.createDataFrame([(float(x), float(y), float(-k)) for k, (x, y) in enumerate(ref)], "x double, y double, flux double")
    found = {r["frame_id"]: r for r in St.register_to(source, list_).collect()}
    assert set(found) - {9} == set(cases) and (9 not in found or found[9]["inliers"] < 20)
    for frame, (turn, tx, ty, blur) in cases.items():
        r = found[frame]
        assert r["inliers"] > 60 and r["rms"] < 0.05 + blur and abs(r["tx"] - tx) < 0.05 + blur and abs(r["ty"] - ty) < 0.05 + blur
        assert abs((r["rotation"] - turn + 180) % 360 - 180) < 0.05 and abs(r["scale"] - 1) < 1e-3


def test_white_by_catalogue_fails_rather_than_falls_back(spark):
    c = noise(80, 3) * 2
    rows = [(1, float(x), float(10 ** (-0.2 + 0.15 * x)), float(10 ** (0.1 - 0.2 * x))) for x in c] + [(2, 0.5, 1.0, 1.0)] * 10
    out = {r["m"]: r for r in St.white_catalogue(spark.createDataFrame(rows, "m int, colour double, r double, b double"), "m", 0.82).collect()}
    assert out[1]["status"] == "ok" and abs(out[1]["slope_r"] - 0.15) < 0.01 and abs(out[1]["r"] - 10 ** (-0.2 + 0.15 * 0.82)) < 0.02
    assert out[2]["status"] == "thin" and out[2]["r"] is None


def test_cone_across_the_pole_and_zero(spark):
    rows = [(1, 359.9, 10.0), (2, 0.1, 10.0), (3, 180.0, 89.5), (4, 90.0, 89.0), (5, 180.0, -10.0)]
    sky = spark.createDataFrame(rows, "source_id long, ra double, dec double").withColumns({c: F.lit(1.0) for c in ("g", "bp", "rp")})
    centres = spark.createDataFrame([(1, 0.0, 10.0, 0.5), (2, 0.0, 90.0, 2.0)], "centre_id long, ra double, dec double, radius double")
    assert {(r["centre_id"], r["source_id"]) for r in S.cone_search(centres, sky.withColumn("tile_id", S.tile_of(F.col("ra"), F.col("dec"), -90.0, 10.0))).collect()} == {(1, 1), (1, 2), (2, 3), (2, 4)}


def test_fits_round_trip():
    image = np.arange(8, dtype=np.float64).reshape(2, 2, 2)
    data = fits.image_bytes(image, [("OBJECT", "'NGC 7000'", "")])
    assert len(data) % 2880 == 0 and (fits.read_image(data) == image).all()


def test_card_values(spark):
    lines = ["BITPIX  =                   16 / bits", "SIMPLE  =                    T / yes", "EXP     =     2.90000009536743", "PATTERN = 'GRBG    '", "OBJECT  = 'NGC 7000'", "CDELT1  =   2.06472528197D-05", "BAD     = what", "END"]
    d = spark.createDataFrame([(1, "".join(x.ljust(80) for x in lines))], "id int, header string")
    c = {r["key"]: (r["v_long"], r["v_bool"], r["v_double"], r["v_string"]) for r in fits.cards(d, "id", "header").collect()}
    assert c == {"BITPIX": (16, None, None, None), "SIMPLE": (None, True, None, None), "EXP": (None, None, 2.90000009536743, None), "PATTERN": (None, None, None, "GRBG"), "OBJECT": (None, None, None, "NGC 7000"), "CDELT1": (None, None, 2.06472528197e-05, None)}


def test_catalogue_by_name(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("stars\tnew\tframe_id\trejected\thfr\n12\tx\t3\t1\tbad\n")
    r = tables.read_catalogue(spark, str(tmp_path / "c.tsv")).first()
    assert (r["frame_id"], r["stars"], r["rejected"], r["hfr"], r["object"]) == (3, 12, True, 0.0, "")
