"""Queries of star lists, the sky catalogue and header cards, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nightloom.fixtures import view, with_views
from nightloom.functions import wcs as W
from nightloom.functions.robust import upper_median
from nightloom.operators import colour as C
from nightloom.operators import sky as S
from nightloom.operators import stars as St
from nightloom.sources import fits
from nightloom.sources.staging import staged, staging_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

MED = "list_sort(list({0}))[CAST(floor(count({0}) / 2) AS BIGINT) + 1]"
SEP = "degrees(acos(greatest(-1, least(1, sin(radians({1})) * sin(radians({3})) + cos(radians({1})) * cos(radians({3})) * cos(radians({0}) - radians({2}))))))"
R = lambda c, n=6: F.round(c, n).alias(c)


def query(sql: str | None = None, views: tuple[str, ...] = ("stars",)):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(*views, body=sql)
        return f

    return put


STORE = """, st AS (SELECT source_id, CAST(trunc(ra * 1000000) AS INTEGER) AS ra, CAST(trunc(dec * 1000000) AS INTEGER) AS dec, CAST(trunc(g * 100) AS SMALLINT) AS g, CAST(trunc(bp * 100) AS SMALLINT) AS bp, CAST(trunc(rp * 100) AS SMALLINT) AS rp FROM sky),
 sd AS (SELECT source_id, CAST(ra AS DOUBLE) / 1000000 AS ra, CAST(dec AS DOUBLE) / 1000000 AS dec, CAST(g AS DOUBLE) / 100 AS g, bp, rp FROM st)"""


def store(spark, sf_dir):
    """The sky in a new store, as it is read back."""
    path = staging_dir(spark, "sky")
    S.write_store(view(spark, sf_dir, "sky"), path)
    return S.read_store(spark, path)


@query(STORE + " SELECT source_id, ra, dec, g FROM sd WHERE ra >= 40 AND ra < 200 AND dec >= -30 AND dec < 45 AND g < 11.5 AND bp IS NOT NULL AND rp IS NOT NULL", views=("sky",))
def flt_gaia_box(spark, sf_dir):
    return S.stored_box(store(spark, sf_dir), 40, 200, -30, 45, 11.5).select("source_id", "ra", "dec", "g")


@query(f" SELECT source_id, round({SEP.format('ra', 'dec', '314.768', '45.733')}, 6) AS sep FROM sky", views=("sky",))
def prj_angular_sep(spark, sf_dir):
    return view(spark, sf_dir, "sky").select("source_id", F.round(W.angular_sep(F.col("ra"), F.col("dec"), F.lit(314.768), F.lit(45.733)), 6).alias("sep"))


@query(", m AS (SELECT centre_id, greatest(-90, least(60, dec - 90 + radius * 4)) AS min_dec FROM centres) SELECT centre_id, round(min_dec, 6) AS min_dec, round((1 - sin(radians(min_dec))) / 2, 6) AS fraction FROM m", views=("centres",))
def prj_sky_geometry(spark, sf_dir):
    m = view(spark, sf_dir, "centres").select("centre_id", W.visible_min_dec(F.col("dec"), F.col("radius") * 4).alias("min_dec"))
    return m.select("centre_id", F.round("min_dec", 6).alias("min_dec"), F.round(W.sky_fraction(F.col("min_dec")), 6).alias("fraction"))


@query(STORE + f" SELECT centre_id, source_id, round(sep, 6) AS sep FROM (SELECT centre_id, source_id, radius, {SEP.format('c.ra', 'c.dec', 's.ra', 's.dec')} AS sep FROM centres c CROSS JOIN sd s) WHERE sep <= radius", views=("centres", "sky"))
def jn_cone_search(spark, sf_dir):
    return S.cone_search(view(spark, sf_dir, "centres"), store(spark, sf_dir)).select("centre_id", "source_id", F.round("sep", 6).alias("sep"))


@query(STORE + " SELECT source_id, ra, dec, g, bp, rp FROM st", views=("sky",))
def sink_sky_store(spark, sf_dir):
    """The store's form, written by tile and read back."""
    path = staging_dir(spark, "sky")
    S.write_store(view(spark, sf_dir, "sky"), path, cell=30.0)
    return spark.read.parquet(path).select("source_id", "ra", "dec", "g", "bp", "rp")


TILE_CAP, TILE_CELL = 60, 30.0


def _quad_sql() -> str:
    """All counts of a tree of twelve levels over tiles of 30 degrees from the south pole, cut from the top."""
    code = " + ".join(f"(((cy >> {12 + k}) & 1) * 2 + ((cx >> {12 + k}) & 1)) * {4**k}" for k in range(12))
    bits = lambda first: " + ".join(f"((code >> {2 * k + first}) & 1) * {2**k}" for k in range(12))
    return f""", tb AS (SELECT source_id, ra, dec, least(CAST(floor((dec + 90) / 30) AS BIGINT), 5) AS band FROM sky), tc AS (SELECT *, greatest(CAST(ceil(360 * greatest(cos(radians(greatest(abs(band * 30 - 90), abs(band * 30 - 60)))), 0.02) / 30) AS BIGINT), 1) AS cells FROM tb),
 ti AS (SELECT *, least(CAST(floor(ra * cells / 360) AS BIGINT), cells - 1) AS i FROM tc), tp AS (SELECT band * 1000 + i AS tile_id, ra, dec, i * CAST(360 AS DOUBLE) / cells AS ra0, (i + 1) * CAST(360 AS DOUBLE) / cells AS ra1, CAST(band * 30 - 90 AS DOUBLE) AS dec0, CAST(band * 30 - 60 AS DOUBLE) AS dec1 FROM ti),
 tx AS (SELECT *, least(CAST(floor((ra - ra0) / (ra1 - ra0) * 16777216) AS BIGINT), 16777215) AS cx, least(CAST(floor((dec - dec0) / (dec1 - dec0) * 16777216) AS BIGINT), 16777215) AS cy FROM tp),
 td AS (SELECT tile_id, ra0, ra1, dec0, dec1, {code} AS deep FROM tx), tl AS (SELECT *, unnest(range(13)) AS depth FROM td),
 nd AS (SELECT tile_id, depth, deep // CAST(pow(4, 12 - depth) AS BIGINT) AS code, any_value(ra0) AS ra0, any_value(ra1) AS ra1, any_value(dec0) AS dec0, any_value(dec1) AS dec1, count(*) AS stars FROM tl GROUP BY 1, 2, 3),
 lf AS (SELECT *, {bits(0)} AS x, {bits(1)} AS y FROM nd n WHERE stars < {TILE_CAP} AND (depth = 0 OR EXISTS (SELECT 1 FROM nd p WHERE p.tile_id = n.tile_id AND p.depth = n.depth - 1 AND p.code = n.code // 4 AND p.stars >= {TILE_CAP})))
 SELECT tile_id, CAST(depth AS INTEGER) AS depth, code, ra0 + (ra1 - ra0) * x / pow(2, depth) AS ra0, ra0 + (ra1 - ra0) * (x + 1) / pow(2, depth) AS ra1, dec0 + (dec1 - dec0) * y / pow(2, depth) AS dec0, dec0 + (dec1 - dec0) * (y + 1) / pow(2, depth) AS dec1, stars, false AS over FROM lf"""


@query(_quad_sql(), views=("sky",))
def agg_sky_tiles(spark, sf_dir):
    return S.split_dense(view(spark, sf_dir, "sky"), S.plan_tiles(spark, -90.0, TILE_CELL), TILE_CAP, -90.0, TILE_CELL)


@query(""", b AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, star_id) AS r FROM stars WHERE NOT saturated) SELECT frame_id, star_id, r AS place FROM b WHERE r <= 20""")
def top_brightest(spark, sf_dir):
    return St.brightest(view(spark, sf_dir, "stars"), 20).select("frame_id", "star_id", F.col("place").cast("long").alias("place"))


REACH = "(least(greatest(a.hfr * 3, 3), 10) + 4)"


@query(f" SELECT frame_id, star_id FROM stars a WHERE NOT EXISTS (SELECT 1 FROM stars b WHERE b.frame_id = a.frame_id AND b.star_id <> a.star_id AND abs(b.x - a.x) < 14 AND abs(b.y - a.y) < 14 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) < {REACH} * {REACH})")
def jn_isolated_stars(spark, sf_dir):
    return S.isolated(view(spark, sf_dir, "stars")).select("frame_id", "star_id")


def projected(spark, sf_dir):
    """Catalogue places of the stars of a frame: a third of them, moved by a pixel or two; colours run over the allowed range and beyond."""
    s = view(spark, sf_dir, "stars").where("star_id % 3 = 0")
    i = F.col("star_id")
    return s.select("frame_id", i.alias("source_id"), (F.col("x") + i % 7 / 2.0 - 1).alias("px"), (F.col("y") + i % 5 / 2.0 - 1).alias("py"), (i % 50 / 10.0 - 0.6).alias("colour"))


PROJECTED = ", pj AS (SELECT frame_id, star_id AS source_id, x + CAST(star_id % 7 AS DOUBLE) / 2 - 1 AS px, y + CAST(star_id % 5 AS DOUBLE) / 2 - 1 AS py, CAST(star_id % 50 AS DOUBLE) / 10 - 0.6 AS colour FROM stars WHERE star_id % 3 = 0)"


@query(PROJECTED + """, pr AS (SELECT s.frame_id, star_id, source_id, colour, (s.x - px) * (s.x - px) + (s.y - py) * (s.y - py) AS d2 FROM stars s JOIN pj p ON p.frame_id = s.frame_id AND abs(s.x - px) <= 9 AND abs(s.y - py) <= 9 WHERE colour >= -0.5 AND colour < 4),
 rk AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY frame_id, star_id) AS n FROM pr WHERE d2 <= 81 WINDOW w AS (PARTITION BY frame_id, star_id ORDER BY d2, source_id)) SELECT frame_id, star_id, source_id, round(colour, 6) AS colour FROM rk WHERE r = 1 AND n = 1 AND d2 <= 9""")
def jn_crossmatch(spark, sf_dir):
    return S.crossmatch(view(spark, sf_dir, "stars"), projected(spark, sf_dir)).select("frame_id", "star_id", "source_id", F.round("colour", 6).alias("colour"))


TRANSFORM = ("1 - CAST(frame_id % 5 AS DOUBLE) / 1000", "CAST(frame_id % 7 AS DOUBLE) / 1000", "CAST(frame_id % 11 AS DOUBLE)", "-CAST(frame_id % 13 AS DOUBLE)")


@query(f""", t AS (SELECT DISTINCT frame_id, {TRANSFORM[0]} AS a, {TRANSFORM[1]} AS b, {TRANSFORM[2]} AS tx, {TRANSFORM[3]} AS ty FROM stars), m AS (SELECT s.frame_id, star_id, a * x - b * y + tx AS mx, b * x + a * y + ty AS my FROM stars s JOIN t USING (frame_id)),
 d AS (SELECT m.frame_id, m.star_id, min((mx - x) * (mx - x) + (my - y) * (my - y)) AS d2 FROM m JOIN stars r ON r.frame_id = 0 AND abs(mx - x) <= 2 AND abs(my - y) <= 2 GROUP BY 1, 2) SELECT frame_id, count(*) AS inliers, round(sqrt(avg(d2)), 6) AS rms FROM d WHERE d2 <= 4 GROUP BY 1""")
def jn_inliers(spark, sf_dir):
    s = view(spark, sf_dir, "stars")
    t = s.select("frame_id").distinct().select("frame_id", *[F.expr(e).alias(n) for e, n in zip(TRANSFORM, ("a", "b", "tx", "ty"), strict=True)])
    return S.inliers(s.select("frame_id", "star_id", "x", "y"), s.where("frame_id = 0"), t).withColumn("rms", F.round("rms", 6))


@query(f""", t AS (SELECT star_id, x, y, {TRANSFORM[0]} AS a, {TRANSFORM[1]} AS b, {TRANSFORM[2]} AS tx, {TRANSFORM[3]} AS ty FROM stars) SELECT star_id, round(a * x - b * y + tx, 6) AS x, round(b * x + a * y + ty, 6) AS y, round(x, 6) AS back_x, round(y, 6) AS back_y, round(degrees(atan2(b, a)), 6) AS rotation, round(sqrt(a * a + b * b), 6) AS scale FROM t""")
def prj_transform(spark, sf_dir):
    s = view(spark, sf_dir, "stars").select("star_id", "x", "y", F.struct(*[F.expr(e).alias(n) for e, n in zip(TRANSFORM, ("a", "b", "tx", "ty"), strict=True)]).alias("t"))
    t = F.col("t")
    m = s.withColumn("m", W.apply_similarity(t, F.col("x"), F.col("y"))).withColumn("i", W.invert_similarity(t))
    m = m.withColumn("back", W.apply_similarity(F.col("i"), F.col("m.x"), F.col("m.y")))
    return m.select("star_id", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"), F.round("back.x", 6).alias("back_x"), F.round("back.y", 6).alias("back_y"), F.round(F.degrees(F.atan2(t["b"], t["a"])), 6).alias("rotation"), F.round(F.sqrt(t["a"] * t["a"] + t["b"] * t["b"]), 6).alias("scale"))


CD = {"crval1": 314.768, "crval2": 45.733, "crpix1": 1080.5, "crpix2": 1920.5, "cd11": -0.00102, "cd12": 0.00001, "cd21": 0.00002, "cd22": 0.00101}


def wcs_column():
    return F.struct(*[F.lit(v).alias(k) for k, v in CD.items()])


_c = {k: repr(v) for k, v in CD.items()}
_det = f"({_c['cd11']} * {_c['cd22']} - {_c['cd12']} * {_c['cd21']})"


@query(f""", a AS (SELECT source_id, radians(ra) AS a, radians(dec) AS d, radians({_c['crval1']}) AS a0, radians({_c['crval2']}) AS d0 FROM sky), b AS (SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a - a0) AS cosc FROM a),
 c AS (SELECT source_id, degrees(cos(d) * sin(a - a0) / cosc) AS xi, degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a - a0)) / cosc) AS eta FROM b WHERE cosc > 1e-6),
 e AS (SELECT source_id, ({_c['cd22']} * xi - ({_c['cd12']}) * eta) / {_det} AS u, ({_c['cd11']} * eta - ({_c['cd21']}) * xi) / {_det} AS v FROM c) SELECT source_id, round(u + 1e-7 * u * u + {_c['crpix1']} - 1, 2) AS x, round(v + 2e-7 * u * v + {_c['crpix2']} - 1, 2) AS y FROM e WHERE abs(u) < 1e5 AND abs(v) < 1e5""", views=("sky",))
def prj_world_to_pixel(spark, sf_dir):
    term = lambda p, q, c: F.array(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(c).alias("c")))
    s = view(spark, sf_dir, "sky").withColumn("w", wcs_column())
    plain = s.withColumn("u", W.world_to_pixel(F.col("ra"), F.col("dec"), F.col("w"))).where(f"abs(u.x + 1 - {_c['crpix1']}) < 1e5 and abs(u.y + 1 - {_c['crpix2']}) < 1e5")
    p = plain.withColumn("p", W.world_to_pixel(F.col("ra"), F.col("dec"), F.col("w"), term(2, 0, 1e-7), term(1, 1, 2e-7)))
    return p.select("source_id", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


@query(f""", a AS (SELECT star_id, x + 1 - {_c['crpix1']} AS u, y + 1 - {_c['crpix2']} AS v, radians({_c['crval1']}) AS a0, radians({_c['crval2']}) AS d0 FROM stars), b AS (SELECT *, radians({_c['cd11']} * u + {_c['cd12']} * v) AS xi, radians({_c['cd21']} * u + {_c['cd22']} * v) AS eta FROM a),
 c AS (SELECT *, sqrt(xi * xi + eta * eta) AS rho FROM b), d AS (SELECT *, atan(rho) AS c FROM c), e AS (SELECT star_id, a0 + atan2(xi * sin(c), rho * cos(d0) * cos(c) - eta * sin(d0) * sin(c)) AS ra, asin(cos(c) * sin(d0) + eta * sin(c) * cos(d0) / rho) AS dec FROM d)
 SELECT star_id, round(degrees(ra - 2 * pi() * floor(ra / (2 * pi()))), 6) AS ra, round(degrees(dec), 6) AS dec FROM e""")
def prj_pixel_to_world(spark, sf_dir):
    p = view(spark, sf_dir, "stars").withColumn("p", W.pixel_to_world(F.col("x"), F.col("y"), wcs_column()))
    return p.select("star_id", F.round("p.ra", 6).alias("ra"), F.round("p.dec", 6).alias("dec"))


@query(f""", t AS (SELECT frame_id, list_sort(list(hfr))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_hfr, {MED.format('ecc')} AS median_ecc, count(*) AS stars FROM stars GROUP BY 1),
 r AS (SELECT s.frame_id, count(*) AS trails FROM stars s JOIN t USING (frame_id) WHERE s.ecc > 0.92 AND s.hfr > 2 * greatest(median_hfr, 0.3) AND s.pixels > 12 GROUP BY 1)
 SELECT t.frame_id, t.stars, round(median_hfr, 6) AS hfr, round(median_ecc, 6) AS ecc, coalesce(r.trails, 0) AS trails, f.background, f.noise FROM t LEFT JOIN r USING (frame_id) JOIN frames f ON f.frame_id = t.frame_id""", views=("stars", "frames"))
def agg_measure_frames(spark, sf_dir):
    m = St.measure(view(spark, sf_dir, "stars"), view(spark, sf_dir, "frames").select("frame_id", "background", "noise"))
    return m.withColumns({"hfr": F.round("hfr", 6), "ecc": F.round("ecc", 6)})


@query(""", b AS (SELECT *, v - 0.55 AS w FROM pixels WHERE v > 0.6), m AS (SELECT frame_id, sum(w) AS flux, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, max(v) AS peak, count(*) AS pixels FROM b GROUP BY 1 HAVING count(*) BETWEEN 3 AND 5000),
 q AS (SELECT frame_id, flux, cx, cy, peak, m.pixels, sum(w * (x - cx) * (x - cx)) / flux AS xx, sum(w * (y - cy) * (y - cy)) / flux AS yy, sum(w * (x - cx) * (y - cy)) / flux AS xy FROM b JOIN m USING (frame_id) GROUP BY 1, 2, 3, 4, 5, 6)
 SELECT frame_id, round(flux, 6) AS flux, round(cx, 6) AS x, round(cy, 6) AS y, round(peak, 6) AS peak, pixels, round(sqrt(1 - greatest((xx + yy) / 2 - sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 0) / ((xx + yy) / 2 + sqrt((xx - yy) * (xx - yy) / 4 + xy * xy))), 5) AS ecc FROM q""", views=("pixels",))
def agg_star_shapes(spark, sf_dir):
    blobs = view(spark, sf_dir, "pixels").where("v > 0.6").select("frame_id", F.lit(0).alias("blob"), "y", "x", "v")
    out = St.shapes(blobs, F.lit(0.55))
    return out.select("frame_id", F.round("flux", 6).alias("flux"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("peak", 6).alias("peak"), "pixels", F.round("ecc", 5).alias("ecc"))


@query()
def agg_detect_stars(spark, sf_dir):
    return St.detect(view(spark, sf_dir, "pixels").select("frame_id", "y", "x", "v"), sigma=1.5).select("frame_id", "blob", "pixels", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(""", b AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, star_id) AS i FROM stars), s AS (SELECT * FROM b WHERE i <= 30),
 t AS (SELECT a.frame_id, a.i, b.i AS j, c.i AS k, list_sort([sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y)), sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y))]) AS s FROM s a JOIN s b ON b.frame_id = a.frame_id AND a.i < b.i JOIN s c ON c.frame_id = a.frame_id AND b.i < c.i)
 SELECT frame_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(s[3], 6) AS long, round(s[2] / s[3], 6) AS r1, round(s[1] / s[3], 6) AS r2 FROM t WHERE s[3] >= 12 AND s[1] / s[3] >= 0.15""")
def fit_triangles(spark, sf_dir):
    return S.triangles(view(spark, sf_dir, "stars")).select("frame_id", "i", "j", "k", F.round("long", 6).alias("long"), F.round("r1", 6).alias("r1"), F.round("r2", 6).alias("r2"))


@query()
def fit_register(spark, sf_dir):
    """Each frame against itself, turned and shifted by its number: the fit must find that transform."""
    s = view(spark, sf_dir, "stars").select("frame_id", "star_id", "x", "y", "flux")
    t = F.radians(F.col("frame_id") % 9 / 3.0)
    moved = s.select("frame_id", "star_id", (F.cos(t) * F.col("x") - F.sin(t) * F.col("y") + F.col("frame_id") % 40).alias("x"), (F.sin(t) * F.col("x") + F.cos(t) * F.col("y") - 7).alias("y"), "flux")
    m = St.register_pairs(moved, s)
    return m.select("frame_id", "inliers", F.round("rms", 4).alias("rms"), F.round("rotation", 4).alias("rotation"), F.round("scale", 5).alias("scale"))


@query()
def fit_plate_solve(spark, sf_dir):
    """Stars of each frame on a sky made of their own places: the solver must find the centre again."""
    s = view(spark, sf_dir, "stars").select("frame_id", "star_id", "x", "y", "flux")
    sky = s.withColumn("p", W.pixel_to_world(F.col("x"), F.col("y"), wcs_column())).select("frame_id", "p.ra", "p.dec", F.col("flux").alias("light"))
    hints = s.select("frame_id").distinct().select("frame_id", F.lit(CD["crval1"] + 0.3).alias("ra"), F.lit(CD["crval2"] - 0.2).alias("dec"), F.lit(3.66).alias("scale"))
    out = St.plate_solve(s, sky, hints)
    return out.select("frame_id", "inliers", F.round("crval1", 3).alias("crval1"), F.round("crval2", 3).alias("crval2"), F.round("scale", 3).alias("scale"), "parity")


@query(""", h AS (SELECT frame_id, unnest(range(7)) AS seq, header FROM headers), c AS (SELECT frame_id, seq, substr(header, CAST(seq * 80 + 1 AS BIGINT), 80) AS card FROM h), d AS (SELECT *, trim(substr(card, 1, 8)) AS key FROM c WHERE seq < 5 AND substr(card, 9, 1) = '=' AND trim(substr(card, 1, 8)) NOT IN ('COMMENT', 'HISTORY', ''))
 SELECT frame_id, CAST(seq AS INTEGER) AS seq, key, CASE key WHEN 'SIMPLE' THEN 'bool' WHEN 'NAXIS1' THEN 'long' WHEN 'OBJECT' THEN 'string' ELSE 'double' END AS vtype, CASE WHEN key = 'SIMPLE' THEN true END AS v_bool, CASE WHEN key = 'NAXIS1' THEN CAST(trim(substr(card, 10, 21)) AS BIGINT) END AS v_long,
 CASE WHEN key = 'CDELT' THEN CAST(replace(trim(substr(card, 10, 9)), 'D', 'E') AS DOUBLE) END AS v_double, CASE WHEN key = 'OBJECT' THEN rtrim(replace(regexp_extract(substr(card, 11), '^''((?:[^'']|'''')*)''', 1), '''''', '''')) END AS v_string FROM d""", views=("headers",))
def src_fits_cards(spark, sf_dir):
    return fits.cards(view(spark, sf_dir, "headers"), "frame_id", "header")


@query(""", h AS (SELECT frame_id, unnest(range(5)) AS seq, header FROM headers) SELECT frame_id, string_agg(rtrim(substr(header, CAST(seq * 80 + 1 AS BIGINT), 80)), chr(10) ORDER BY seq) AS text FROM h GROUP BY 1""", views=("headers",))
def src_header_text(spark, sf_dir):
    return fits.header_text(view(spark, sf_dir, "headers"), "frame_id", "header")


@query(""" SELECT frame_id, 'O''' || o.o_orderpriority AS object, 1000 + o.o_custkey AS width, 0 AS height, 1 AS planes, round(CAST((1 + frame_id % 9) || '.5E-05' AS DOUBLE), 9) AS cdelt FROM headers JOIN orders o ON o.o_orderkey = frame_id""", views=("headers",))
def prj_header_fields(spark, sf_dir):
    c = fits.cards(view(spark, sf_dir, "headers"), "frame_id", "header")
    return fits.fields(c, "frame_id").select("frame_id", "object", "width", F.col("height").cast("int").alias("height"), F.col("planes").cast("int").alias("planes"), F.round("cdelt", 9).alias("cdelt"))


@query(f""", w AS (SELECT DISTINCT frame_id, 314.0 + CAST(frame_id % 50 AS DOUBLE) / 10 AS crval1, 45.0 AS crval2, CASE WHEN frame_id % 10 = 3 THEN 0 ELSE -0.00102 END AS cd11, 0.00001 AS cd12, 0.00002 AS cd21, CASE WHEN frame_id % 10 = 3 THEN 0 ELSE 0.00101 END AS cd22 FROM frames WHERE frame_id % 7 <> 0)
 SELECT frame_id, round(sqrt(abs(cd11 * cd22 - cd12 * cd21)) * 3600, 6) AS scale, round(degrees(atan2(cd21, cd22)), 6) AS rotation, round(0.5 * sqrt(CAST(2160 * 2160 + 3840 * 3840 AS DOUBLE)) * sqrt(abs(cd11 * cd22 - cd12 * cd21)) * 1.05, 6) AS radius, CASE WHEN frame_id % 4 = 0 THEN 2 ELSE 0 END AS terms FROM w WHERE abs(cd11 * cd22 - cd12 * cd21) >= 1e-20""", views=("frames",))
def prj_wcs_params(spark, sf_dir):
    f = view(spark, sf_dir, "frames")
    i = F.col("frame_id")
    flat = i % 10 == 3
    number = {"CRVAL1": F.when(i % 7 != 0, 314.0 + i % 50 / 10.0), "CRVAL2": F.lit(45.0), "CRPIX1": F.lit(1.0), "CRPIX2": F.lit(1.0), "CD1_1": F.when(flat, 0.0).otherwise(-0.00102), "CD1_2": F.lit(0.00001), "CD2_1": F.lit(0.00002), "CD2_2": F.when(flat, 0.0).otherwise(0.00101)}
    number |= {"A_0_2": F.lit(1e-7), "A_1_1": F.lit(2e-7), "A_2_0": F.lit(0.0), "A_3_0": F.lit(5e-9)}
    cards = F.create_map(*[x for k, v in number.items() for x in (F.lit(k), v)])
    rows = f.select("frame_id", cards.alias("cards")).withColumn("w", W.wcs_of_cards(F.col("cards"))).where("w is not null")
    terms = W.sip_terms(F.col("cards"), "A", F.when(i % 4 == 0, 2).otherwise(0))
    w = F.col("w")
    return rows.select("frame_id", F.round(W.scale_arcsec(w), 6).alias("scale"), F.round(W.rotation_deg(w), 6).alias("rotation"), F.round(W.radius_deg(w, F.lit(2160.0), F.lit(3840.0)), 6).alias("radius"), F.size(terms).alias("terms"))


@query(f""", a AS (SELECT frame_id, ecc, flux, star_id, 0.4 + CAST(star_id % 41 AS DOUBLE) / 100 AS r, 0.5 + CAST(star_id % 31 AS DOUBLE) / 100 AS b FROM stars WHERE NOT saturated), m AS (SELECT frame_id, count(*) AS n, {MED.format('r')} AS mr, {MED.format('b')} AS mb FROM a GROUP BY 1) SELECT frame_id, n AS stars, round(mr, 6) AS r0, round(mb, 6) AS b0 FROM m WHERE n >= 30""")
def agg_white_plain(spark, sf_dir):
    """The first round of the field-star white: plain medians of both ratios."""
    a = ratios(spark, sf_dir)
    m = a.groupBy("frame_id").agg(F.count("*").alias("stars"), upper_median("r").alias("r0"), upper_median("b").alias("b0"))
    return m.where("stars >= 30").select("frame_id", "stars", F.round("r0", 6).alias("r0"), F.round("b0", 6).alias("b0"))


def ratios(spark, sf_dir):
    i = F.col("star_id")
    return view(spark, sf_dir, "stars").where("not saturated").select("frame_id", "star_id", (0.4 + i % 41 / 100.0).alias("r"), (0.5 + i % 31 / 100.0).alias("b"), (i % 45 / 10.0 - 0.5).alias("colour"))


@query()
def agg_white_fieldstars(spark, sf_dir):
    w = St.white_fieldstars(ratios(spark, sf_dir), "frame_id", sigma=1.2)
    return w.select("frame_id", "used", F.round("r", 6).alias("r"), F.round("b", 6).alias("b"))


@query()
def agg_white_catalogue(spark, sf_dir):
    w = St.white_catalogue(ratios(spark, sf_dir), "frame_id", white=0.82)
    return w.select("frame_id", "status", "used", F.round("r", 6).alias("r"), F.round("b", 6).alias("b"), *[F.round(c, 6).alias(c) for c in ("slope_r", "scatter_r", "scatter_b", "span", "colour")])


@query(""", w AS (SELECT frame_id, avg(CASE WHEN star_id % 2 = 0 THEN flux END) / 100 AS s0, avg(CASE WHEN star_id % 2 = 1 THEN flux END) / 90 AS s1, avg(flux) / 95 AS s2, 0.7 + CAST(frame_id % 5 AS DOUBLE) / 10 AS r, 0.8 + CAST(frame_id % 3 AS DOUBLE) / 10 AS b FROM stars GROUP BY 1),
 g AS (SELECT *, 1 / greatest(r, 1e-4) AS g0, 1.0 AS g1, 1 / greatest(b, 1e-4) AS g2 FROM w), n AS (SELECT *, g0 / greatest(greatest(g0, g1, g2), 1e-6) AS k0, g1 / greatest(greatest(g0, g1, g2), 1e-6) AS k1, g2 / greatest(greatest(g0, g1, g2), 1e-6) AS k2 FROM g), l AS (SELECT *, least(s0 * k0, s1 * k1, s2 * k2) AS level FROM n)
 SELECT frame_id, round(k0, 6) AS gain0, round(k1, 6) AS gain1, round(k2, 6) AS gain2, round(s0 - level / greatest(k0, 1e-6), 6) AS offset0, round(s1 - level / greatest(k1, 1e-6), 6) AS offset1, round(s2 - level / greatest(k2, 1e-6), 6) AS offset2, round(level, 6) AS level FROM l""")
def agg_color_gains(spark, sf_dir):
    i = F.col("star_id")
    w = view(spark, sf_dir, "stars").groupBy("frame_id").agg((F.avg(F.when(i % 2 == 0, F.col("flux"))) / 100).alias("s0"), (F.avg(F.when(i % 2 == 1, F.col("flux"))) / 90).alias("s1"), (F.avg("flux") / 95).alias("s2"))
    w = w.withColumns({"r": 0.7 + F.col("frame_id") % 5 / 10.0, "b": 0.8 + F.col("frame_id") % 3 / 10.0})
    out = St.color_gains(w, F.col("r"), F.col("b"))
    return out.select("frame_id", *[F.round(f"{n}{k}", 6).alias(f"{n}{k}") for n in ("gain", "offset") for k in range(3)], F.round("level", 6).alias("level"))


@query(""", ap AS (SELECT p.frame_id, s.star_id, p.x AS px, p.y AS py, p.v, (CAST(s.star_id % 5 AS INTEGER) + 1.5) AS cx, (CAST(s.star_id % 4 AS INTEGER) + 2.0) AS cy FROM pixels p JOIN (SELECT frame_id, frame_id AS star_id FROM (SELECT DISTINCT frame_id FROM pixels)) s USING (frame_id))
 SELECT frame_id, star_id, round(sum(v), 6) AS flux, count(*) AS pixels FROM ap WHERE (px - cx) * (px - cx) + (py - cy) * (py - cy) <= 9 GROUP BY 1, 2""", views=("pixels",))
def agg_aperture_sums(spark, sf_dir):
    p = view(spark, sf_dir, "pixels")
    i = F.col("frame_id")
    stars = p.select("frame_id").distinct().select("frame_id", i.alias("star_id"), (i % 5 + 1.5).alias("x"), (i % 4 + 2.0).alias("y"), F.lit(3.0).alias("radius"))
    return St.aperture_sums(stars, p.select("frame_id", "y", "x", "v")).withColumn("flux", F.round("flux", 6))


@query()
def agg_star_colours(spark, sf_dir):
    from nightloom.operators.pixels import debayer_half

    rgb = debayer_half(view(spark, sf_dir, "pixels"))
    i = F.col("frame_id")
    stars = rgb.select("frame_id").distinct().select("frame_id", i.alias("star_id"), F.lit(1.5).alias("x"), F.lit(1.5).alias("y"), F.lit(0.5).alias("hfr"))
    return St.star_colours(stars, rgb, width=4, height=4, limit=2.0, edge=0.0, radius=1.5).select("frame_id", "star_id", F.round("r", 6).alias("r"), F.round("b", 6).alias("b"))


PLANE = 224  # pixels a side of the planes that stars are painted on


def painted(spark, sf_dir):
    """Planes frame_id, y, x, r, g, b of ten frames' brightest-set stars each, and these stars (frame_id, source_id, px, py, colour), whose log ratios follow from their colour."""
    s = view(spark, sf_dir, "stars").where("hfr > 2.45")
    at = lambda k: 4 + F.pmod(F.xxhash64("star_id", F.lit(k)), F.lit(1000)) / 1000.0 * (PLANE - 8)
    s = s.select(F.floor(F.col("frame_id") / 10).alias("frame_id"), F.col("star_id").alias("source_id"), at(1).alias("px"), at(2).alias("py"), (F.col("star_id") % 40 / 20.0).alias("colour"), (0.05 + F.col("flux") / 300.0).alias("light"))
    around = lambda c: F.sequence(F.floor(c) - 5, F.floor(c) + 5)
    near = s.withColumn("y", F.explode(around("py"))).withColumn("x", F.explode(around("px"))).where(F.col("y").between(0, PLANE - 1) & F.col("x").between(0, PLANE - 1))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    v = F.col("light") * F.exp(-(dx * dx + dy * dy) / (2 * 1.4**2))
    ten = lambda a, b: F.pow(F.lit(10.0), a + b * F.col("colour"))
    near = near.select("frame_id", "y", "x", (v * ten(0.30, -0.20)).alias("r"), v.alias("g"), (v * ten(-0.25, 0.15)).alias("b"))
    side = F.sequence(F.lit(0).cast("long"), F.lit(PLANE - 1).cast("long"))
    sky = s.select("frame_id").distinct().withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    grain = lambda k: F.pmod((F.col("y") * PLANE + F.col("x") + k) * 7919 + F.col("frame_id") * 104729, F.lit(1000)) / 1000.0 * 6e-4
    sky = sky.select("frame_id", "y", "x", *[(level + grain(k)).alias(c) for k, (c, level) in enumerate(zip("rgb", (0.030, 0.020, 0.026)))])
    rgb = near.unionByName(sky).groupBy("frame_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(*[F.sum(c).alias(c) for c in "rgb"])
    return staged(rgb, "painted"), s.drop("light")


def _calibration(out):
    numbers = [c for c in out.columns if c not in ("frame_id", "status", "found", "used")]
    return out.select("frame_id", "status", "found", "used", *[F.round(c, 6).alias(c) for c in sorted(numbers)])


@query()
def agg_colour_calibration(spark, sf_dir):
    """Calibration against the catalogue of painted planes: of four, one has no solution and one a catalogue of forty."""
    rgb, stars = painted(spark, sf_dir)
    k = F.col("frame_id") % 4
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("source_id"))
    sources = stars.withColumn("place", place).where((k != 1) | (F.col("place") <= 40)).drop("place")
    return _calibration(C.calibrate(rgb, PLANE, PLANE, "catalogue", stars.where(k != 3).select("frame_id").distinct(), sources, white=0.82, side=32))


@query()
def agg_colour_field(spark, sf_dir):
    """Calibration of painted planes by their own stars."""
    return _calibration(C.calibrate(painted(spark, sf_dir)[0], PLANE, PLANE, "stars", side=32))
