"""Queries of pixel tables over the derived 8 x 8 frames, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.fixtures import view, with_views
from nightloom.functions import develop as D
from nightloom.operators import pixels as P
from nightloom.operators import stack as S
from nightloom.operators import tiles as Ti

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

MED = "list_sort(list({0}))[CAST(floor(count({0}) / 2) AS BIGINT) + 1]"
CLAMP = "least(greatest({0}, 0), 1)"
MTF = "CASE WHEN {1} <= 0 THEN 0 WHEN {1} >= 1 THEN 1 WHEN abs({0} - 0.5) < 1e-6 THEN {1} ELSE ({0} - 1) * {1} / ((2 * {0} - 1) * {1} - {0}) END"
R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def query(sql: str | None = None, views: tuple[str, ...] = ("pixels",)):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(*views, body=sql)
        return f

    return put


def pixels(spark, sf_dir):
    return view(spark, sf_dir, "pixels")


COLOUR = "CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN x % 2 = 0 THEN 2 ELSE 1 END END"
RGB = f""", rgb AS (SELECT frame_id, master_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, avg(CASE WHEN {COLOUR} = 0 THEN v END) AS r, avg(CASE WHEN {COLOUR} = 1 THEN v END) AS g, avg(CASE WHEN {COLOUR} = 2 THEN v END) AS b FROM pixels GROUP BY ALL),
 ch AS (SELECT frame_id, master_id, 0 AS channel, y, x, r AS v FROM rgb UNION ALL SELECT frame_id, master_id, 1, y, x, g FROM rgb UNION ALL SELECT frame_id, master_id, 2, y, x, b FROM rgb)"""


def rgb(spark, sf_dir):
    return P.debayer_half(pixels(spark, sf_dir), keys=("frame_id", "master_id"))


def planes(spark, sf_dir):
    return P.channels(rgb(spark, sf_dir), keys=("frame_id", "master_id"))


@query(" SELECT frame_id, y, x, round(" + CLAMP.format("(v * 40000 - 500) / 65035") + ", 6) AS measured, round((v * 40000 - 500) / 65035, 6) AS stacked FROM pixels")
def prj_normalise(spark, sf_dir):
    dn = F.col("v") * 40000
    return pixels(spark, sf_dir).select("frame_id", "y", "x", F.round(D.normalise(dn, 500), 6).alias("measured"), F.round(D.normalise(dn, 500, clip=False), 6).alias("stacked"))


@query(""", p AS (SELECT frame_id, y, x, v * 300 AS v, [8, 16, -32][CAST(frame_id % 3 AS INTEGER) + 1] AS bitpix, CASE WHEN frame_id % 7 = 0 THEN 100000.0 ELSE 50.0 END AS pedestal FROM pixels),
 m AS (SELECT frame_id, max(v) AS most FROM p GROUP BY 1), q AS (SELECT p.*, CASE WHEN pedestal > most THEN 0 ELSE pedestal END AS ped, CASE bitpix WHEN 8 THEN 255 WHEN 16 THEN 65535 ELSE greatest(most, 1) END AS full_scale FROM p JOIN m USING (frame_id))
 SELECT frame_id, y, x, round(""" + CLAMP.format("(v - ped) / greatest(full_scale - ped, CASE WHEN bitpix < 0 THEN 1e-6 ELSE 1 END)") + ", 6) AS v FROM q")
def prj_display_scale(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("v", F.col("v") * 300)
    bitpix = F.when(F.col("frame_id") % 3 == 0, 8).when(F.col("frame_id") % 3 == 1, 16).otherwise(-32)
    pedestal = F.when(F.col("frame_id") % 7 == 0, 100000.0).otherwise(50.0)
    return P.display_scale(p, bitpix, pedestal).select("frame_id", "y", "x", *R6("v"))


@query(f" SELECT frame_id, y, x, round({MTF.format('(CAST(1 + frame_id % 9 AS DOUBLE) / 10)', 'v')}, 6) AS v FROM pixels")
def prj_mtf(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("v", D.mtf((1 + F.col("frame_id") % 9) / 10, F.col("v"))).select("frame_id", "y", "x", *R6("v"))


STF = f""", md AS (SELECT frame_id, channel, {MED.format('v')} AS median FROM ch GROUP BY 1, 2), dv AS (SELECT frame_id, channel, median, abs(v - median) AS d FROM ch JOIN md USING (frame_id, channel)),
 st0 AS (SELECT frame_id, channel, median, {MED.format('d')} * 1.4826 AS mad FROM dv GROUP BY 1, 2, 3), st1 AS (SELECT *, {CLAMP.format('median - 2.8 * mad')} AS shadows FROM st0),
 st AS (SELECT *, {MTF.format('0.25', '(' + CLAMP.format('median - shadows') + ')')} AS midtone FROM st1)"""


@query(RGB + STF + " SELECT frame_id, channel, round(median, 6) AS median, round(mad, 6) AS mad, round(shadows, 6) AS shadows, round(midtone, 6) AS midtone FROM st")
def agg_auto_stf(spark, sf_dir):
    return P.auto_stf(planes(spark, sf_dir), ["frame_id", "channel"]).select("frame_id", "channel", *R6("median", "mad", "shadows", "midtone"))


@query(RGB + STF + f", a AS (SELECT frame_id, channel, y, x, midtone, {CLAMP.format('(v - shadows) / greatest(1 - shadows, 1e-6)')} AS c FROM ch JOIN st USING (frame_id, channel)) SELECT frame_id, channel, y, x, round({MTF.format('midtone', 'c')}, 6) AS v FROM a")
def prj_stf_apply(spark, sf_dir):
    p = planes(spark, sf_dir)
    stf = P.auto_stf(p, ["frame_id", "channel"]).select("frame_id", "channel", "shadows", "midtone")
    return p.join(stf, ["frame_id", "channel"]).select("frame_id", "channel", "y", "x", F.round(D.stf(F.col("shadows"), F.col("midtone"), F.col("v")), 6).alias("v"))


ALGORITHMS = ["none", "stf", "arcsinh", "hyperbolic", "log", "equalise"]
LUT = [((i / 255) ** 0.5) for i in range(256)]


def _stretch_sql() -> str:
    out = ", a AS (SELECT *, ['" + "','".join(ALGORITHMS) + "'][CAST(frame_id % 6 AS INTEGER) + 1] AS alg FROM rgb), c AS (SELECT frame_id, y, x, alg"
    for n in "rgb":
        out += f", {CLAMP.format(f'({n} - 0.3) / 0.7')} AS {n}"
    out += " FROM a), o AS (SELECT frame_id, y, x, alg"
    for n in "rgb":
        gh = CLAMP.format(f"(asinh(8.0 * ({n} - 0.2)) / asinh(8.0 * 0.8)) * 0.8 + 0.2")
        o = f"CASE alg WHEN 'stf' THEN {MTF.format('0.3', n)} WHEN 'arcsinh' THEN asinh(8.0 * {n}) / asinh(8.0) WHEN 'hyperbolic' THEN {gh} WHEN 'log' THEN ln(1 + 8.0 * {n}) / ln(1 + 8.0) WHEN 'equalise' THEN sqrt(floor({n} * 255) / 255) ELSE {n} END"
        out += f", {n} + ({CLAMP.format(o)} - {n}) * 0.8 AS {n}"
    out += " FROM c), g AS (SELECT *, r * 0.2126 + g * 0.7152 + b * 0.0722 AS grey FROM o) SELECT frame_id, y, x"
    for n in "rgb":
        out += f", round({CLAMP.format(f'grey + ({n} - grey) * 1.2')}, 6) AS {n}"
    return out + " FROM g"


@query(RGB + _stretch_sql())
def prj_stretch_family(spark, sf_dir):
    c = rgb(spark, sf_dir)
    algorithm = F.get(F.array(*[F.lit(a) for a in ALGORITHMS]), (F.col("frame_id") % 6).cast("int"))
    lut = F.array(*[F.lit(v) for v in LUT])
    out = D.stretched({n: F.col(n) for n in "rgb"}, algorithm, F.lit(0.3), F.lit(0.3), F.lit(8.0), F.lit(0.2), lut, F.lit(0.8), F.lit(1.2))
    return c.select("frame_id", "y", "x", *[F.round(v, 6).alias(n) for n, v in out.items()])


@query(RGB + STF + f""", w AS (SELECT frame_id, max(CASE WHEN channel = 0 THEN shadows END) AS s0, max(CASE WHEN channel = 1 THEN shadows END) AS s1, max(CASE WHEN channel = 2 THEN shadows END) AS s2,
 max(CASE WHEN channel = 0 THEN midtone END) AS m0, max(CASE WHEN channel = 1 THEN midtone END) AS m1, max(CASE WHEN channel = 2 THEN midtone END) AS m2 FROM st GROUP BY 1),
 b AS (SELECT frame_id, frame_id % 2 = 0 AS linked, least(greatest(s0 + 0.01, 0), 0.99) AS s0, least(greatest(s1 + 0.01, 0), 0.99) AS s1, least(greatest(s2 + 0.01, 0), 0.99) AS s2, CASE WHEN m1 > 1e-6 THEN 0.2 / m1 ELSE 1 END AS ratio, m0, m1, m2 FROM w)
 SELECT frame_id, linked, {', '.join(f'round(CASE WHEN linked THEN (s0 + s1 + s2) / 3 ELSE s{k} END, 6) AS shadows{k}, round(CASE WHEN linked THEN 0.2 ELSE least(greatest(m{k} * ratio, 0.001), 0.999) END, 6) AS midtone{k}' for k in range(3))} FROM b""")
def prj_stretch_params(spark, sf_dir):
    stf = P.auto_stf(planes(spark, sf_dir), ["frame_id", "channel"])
    at = lambda c, k: F.max(F.when(F.col("channel") == k, F.col(c)))
    w = stf.groupBy("frame_id").agg(*[at("shadows", k).alias(f"s{k}") for k in range(3)], *[at("midtone", k).alias(f"m{k}") for k in range(3)])
    linked, black, midtone = F.col("frame_id") % 2 == 0, 0.01, 0.2
    ratio = F.when(F.col("m1") > 1e-6, midtone / F.col("m1")).otherwise(1.0)
    s = [D.clamp(F.col(f"s{k}") + black, 0.0, 0.99) for k in range(3)]
    out = []
    for k in range(3):
        out.append(F.round(F.when(linked, (s[0] + s[1] + s[2]) / 3).otherwise(s[k]), 6).alias(f"shadows{k}"))
        out.append(F.round(F.when(linked, midtone).otherwise(D.clamp(F.col(f"m{k}") * ratio, 0.001, 0.999)), 6).alias(f"midtone{k}"))
    return w.select("frame_id", linked.alias("linked"), *out)


@query(RGB + " SELECT frame_id, y, x, round((r - 0.05) * 0.9, 6) AS r, round((g - 0.04) * 1.0, 6) AS g, round((b - 0.06) * 0.8, 6) AS b FROM rgb")
def prj_calibrate(spark, sf_dir):
    cal = {"r": (0.05, 0.9), "g": (0.04, 1.0), "b": (0.06, 0.8)}
    return rgb(spark, sf_dir).select("frame_id", "y", "x", *[F.round((F.col(n) - o) * k, 6).alias(n) for n, (o, k) in cal.items()])


@query(RGB + " SELECT frame_id, y, x, round(r, 6) AS r, round(0.5 * r + 0.25 * g + 0.25 * b, 6) AS g, round(0.5 * g + 0.5 * b, 6) AS b FROM rgb")
def prj_palette(spark, sf_dir):
    mixed = D.palette("sho", F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, sf_dir).select("frame_id", "y", "x", *[F.round(v, 6).alias(n) for n, v in zip("rgb", mixed, strict=True)])


ZONES = [0.5, 1.5, 1.0, 1.0, 0.8]


@query(f""", z0 AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE greatest(0.01, s[k + 1] * (1 - f) + s[least(k + 2, 5)] * f) END AS step FROM (SELECT i, {ZONES} AS s, least(CAST(floor(i * 4 / 255.0) AS INTEGER), 4) AS k, i / 255.0 * 4 - least(floor(i * 4 / 255.0), 4) AS f FROM (SELECT unnest(range(256)) AS i))),
 z1 AS (SELECT i, sum(step) OVER (ORDER BY i) AS run FROM z0), z AS (SELECT i, run / (SELECT max(run) FROM z1) AS value FROM z1), t AS (SELECT frame_id, y, x, {CLAMP.format('v')} * 255 AS t FROM pixels)
 SELECT frame_id, y, x, round(a.value + (b.value - a.value) * (t - floor(t)), 6) AS v FROM t JOIN z a ON a.i = floor(t) JOIN z b ON b.i = least(floor(t) + 1, 255)""")
def prj_zone_curve(spark, sf_dir):
    table = F.array(*[F.lit(v) for v in D.zone_table(ZONES)])
    return pixels(spark, sf_dir).select("frame_id", "y", "x", F.round(D.curve(table, F.col("v")), 6).alias("v"))


def _tone_sql() -> str:
    s = 2 ** (0.5 * 0.72)
    return RGB + f""", t0 AS (SELECT *, r * 0.2126 + g * 0.7152 + b * 0.0722 AS base FROM rgb), t1 AS (SELECT *, base * {s!r} / (1 + base * ({s!r} - 1)) AS l FROM t0),
 t2 AS (SELECT *, {CLAMP.format('l')} AS k FROM t1), t3 AS (SELECT *, k + 4 * (0.48 * 0.3) * (k - 0.5) * k * (1 - k) AS l3 FROM t2), t4 AS (SELECT *, greatest((l3 - {0.2 * 0.22!r}) / (1 - {0.2 * 0.22!r}), 0) AS l4 FROM t3),
 t5 AS (SELECT *, l4 / {1 - 0.1 * 0.22!r} AS l5, pow({CLAMP.format('(base - 0.25) / 0.75')}, 1.3) AS hm, pow({CLAMP.format('(0.5 - base) / 0.5')}, 1.3) AS sm FROM t4),
 t6 AS (SELECT *, l5 + (l5 / (1 + 0.4 * 3 * hm * l5) - l5) * (hm * 0.4) AS l6 FROM t5), t7 AS (SELECT *, {CLAMP.format('l6 + 0.3 * sm * ' + CLAMP.format('1 - l6') + ' * 0.5')} AS toned, {CLAMP.format('base / 0.05')} AS w FROM t6),
 t8 AS (SELECT frame_id, y, x, {', '.join(CLAMP.format(f'({n} + (toned - base)) + ({n} * (toned / greatest(base, 1e-4)) - ({n} + (toned - base))) * (w * w * (3 - 2 * w))') + f' AS {n}' for n in 'rgb')} FROM t7),
 t9 AS (SELECT *, r * 0.2126 + g * 0.7152 + b * 0.0722 AS grey, 1 + 0.5 * 1.8 * (1 - (greatest(r, g, b) - least(r, g, b)) / greatest(greatest(r, g, b), 1e-5)) AS amount FROM t8),
 u AS (SELECT frame_id, y, x, {', '.join(CLAMP.format(f'grey + ({n} - grey) * amount') + f' AS {n}' for n in 'rgb')} FROM t9)
 SELECT frame_id, y, x, round(r, 6) AS r, round(g + (least(g, 0.5 * (r + b)) - g) * 0.7, 6) AS g, round(b, 6) AS b FROM u"""


@query(_tone_sql())
def prj_tone(spark, sf_dir):
    out = D.toned(F.col("r"), F.col("g"), F.col("b"), exposure=0.5, contrast=0.3, blacks=-0.2, whites=0.1, highlights=-0.4, shadows=0.3, vibrance=0.5, scnr=0.7)
    return rgb(spark, sf_dir).select("frame_id", "y", "x", *[F.round(v, 6).alias(n) for n, v in zip("rgb", out, strict=True)])


@query(" SELECT frame_id, y, x, round(v, 6) AS v FROM pixels WHERE (x + 0.5) / 8 BETWEEN 0.2 AND 0.8 AND (y + 0.5) / 8 BETWEEN 0.1 AND 0.9")
def flt_crop(spark, sf_dir):
    return P.cropped(pixels(spark, sf_dir), 8, 8, 0.8, 0.1, 0.2, 0.9).select("frame_id", "y", "x", *R6("v"))


@query(RGB + f""", s AS (SELECT frame_id, greatest(max(v), 1.0) AS scale FROM ch GROUP BY 1), p AS (SELECT frame_id, channel, y, x, scale, {CLAMP.format('v / scale')} AS v FROM ch JOIN s USING (frame_id)),
 m0 AS (SELECT frame_id, channel, {MED.format('v')} AS median FROM p WHERE (y * 4 + x) % 7 = 0 GROUP BY 1, 2), m AS (SELECT frame_id, channel, {MTF.format('0.25', 'median')} AS m FROM m0),
 q AS (SELECT frame_id, channel, y, x, scale, m, {MTF.format('m', 'v')} AS s FROM p JOIN m USING (frame_id, channel)) SELECT frame_id, channel, y, x, round(s, 6) AS stretched, round(({MTF.format('(1 - m)', 's')}) * scale, 6) AS restored FROM q""")
def prj_prestretch(spark, sf_dir):
    p = P.prestretched(planes(spark, sf_dir), 4)
    back = D.mtf(1 - F.col("m"), F.col("v")) * F.col("scale")
    return p.select("frame_id", "channel", "y", "x", F.round("v", 6).alias("stretched"), F.round(back, 6).alias("restored"))


@query(RGB + " SELECT frame_id, 2 - channel AS channel, y, x, round(v, 6) AS v FROM ch")
def prj_swap_rb(spark, sf_dir):
    return P.swap_red_blue(planes(spark, sf_dir)).select("frame_id", "channel", "y", "x", *R6("v"))


@query(RGB + " SELECT frame_id, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM rgb")
def agg_debayer_half(spark, sf_dir):
    return rgb(spark, sf_dir).select("frame_id", "y", "x", *R6("r", "g", "b"))


def _neighbour(dy: int, dx: int) -> str:
    return f"max(CASE WHEN dy = {dy} AND dx = {dx} THEN nv END)"


@query(f""", o AS (SELECT unnest([-1, 0, 1]) AS dy), oo AS (SELECT dy, unnest([-1, 0, 1]) AS dx FROM o), n AS (SELECT p.frame_id, p.y, p.x, dy, dx, q.v AS nv FROM pixels p CROSS JOIN oo JOIN pixels q ON q.frame_id = p.frame_id AND q.y = least(greatest(p.y + dy, 0), 7) AND q.x = least(greatest(p.x + dx, 0), 7)),
 m AS (SELECT frame_id, y, x, {COLOUR} AS c, {_neighbour(0, 0)} AS own, ({_neighbour(0, -1)} + {_neighbour(0, 1)}) / 2 AS h, ({_neighbour(-1, 0)} + {_neighbour(1, 0)}) / 2 AS vv, ({_neighbour(-1, -1)} + {_neighbour(-1, 1)} + {_neighbour(1, -1)} + {_neighbour(1, 1)}) / 4 AS d FROM n GROUP BY frame_id, y, x)
 SELECT frame_id, y, x, round(CASE WHEN c = 0 THEN own WHEN c = 1 THEN CASE WHEN y % 2 = 0 THEN h ELSE vv END ELSE d END, 6) AS r, round(CASE WHEN c = 1 THEN own ELSE (h + vv) / 2 END, 6) AS g, round(CASE WHEN c = 2 THEN own WHEN c = 1 THEN CASE WHEN y % 2 = 0 THEN vv ELSE h END ELSE d END, 6) AS b FROM m""")
def agg_debayer_full(spark, sf_dir):
    return P.debayer_full(pixels(spark, sf_dir), rows=4).select("frame_id", "y", "x", *R6("r", "g", "b"))


@query(RGB + f" SELECT master_id, channel, CAST(floor({CLAMP.format('v')} * 255) AS INTEGER) AS bin, count(*) AS n FROM ch GROUP BY ALL")
def agg_histogram(spark, sf_dir):
    return P.histogram(planes(spark, sf_dir), ["master_id", "channel"])


HIST = RGB + f", hs AS (SELECT master_id, channel, CAST(floor({CLAMP.format('v')} * 255) AS INTEGER) AS bin, count(*) AS n FROM ch GROUP BY ALL)"


@query(HIST + " SELECT master_id, channel, bin, n, round(CAST(sum(n) OVER (PARTITION BY master_id, channel ORDER BY bin) AS DOUBLE) / sum(n) OVER (PARTITION BY master_id, channel), 6) AS cdf FROM hs")
def win_hist_cdf(spark, sf_dir):
    return P.cumulative(P.histogram(planes(spark, sf_dir), ["master_id", "channel"]), ["master_id", "channel"]).withColumn("cdf", F.round("cdf", 6))


@query(HIST + """, ev AS (SELECT master_id, channel, unnest(range(256)) AS bin FROM (SELECT DISTINCT master_id, channel FROM hs)), fl AS (SELECT master_id, channel, CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM ev LEFT JOIN hs USING (master_id, channel, bin))
 SELECT master_id, channel, bin, n, round(avg(n) OVER (PARTITION BY master_id, channel ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM fl""")
def win_hist_smooth(spark, sf_dir):
    return P.smoothed(P.histogram(planes(spark, sf_dir), ["master_id", "channel"]), ["master_id", "channel"]).withColumn("smooth", F.round("smooth", 6))


@query(RGB + STF + f""", bx AS (SELECT frame_id, channel, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, avg(v) AS v FROM ch GROUP BY ALL), c AS (SELECT frame_id, channel, 1 - y AS y, x, midtone, {CLAMP.format('(v - shadows) / greatest(1 - shadows, 1e-6)')} AS c FROM bx JOIN st USING (frame_id, channel)),
 s AS (SELECT frame_id, channel, y, x, CAST(floor(round({MTF.format('midtone', 'c')}, 9) * 255 + 0.5) AS INTEGER) AS v FROM c) SELECT frame_id, y, x, max(CASE WHEN channel = 0 THEN v END) AS r, max(CASE WHEN channel = 1 THEN v END) AS g, max(CASE WHEN channel = 2 THEN v END) AS b FROM s GROUP BY 1, 2, 3""")
def agg_thumbnail(spark, sf_dir):
    c = rgb(spark, sf_dir)
    stf = P.auto_stf(P.channels(c), ["frame_id", "channel"]).select("frame_id", "channel", "shadows", "midtone")
    return P.thumbnail(c, stf, 2, 4, 4)


@query(f""", i AS (SELECT frame_id, CAST(y // 2 AS INTEGER) AS ty, CAST(x // 2 AS INTEGER) AS tx, v FROM pixels WHERE (y // 2) * 2 < 6 AND (x // 2) * 2 < 6), m AS (SELECT frame_id, ty, tx, {MED.format('v')} AS m FROM i GROUP BY 1, 2, 3),
 d AS (SELECT frame_id, ty, tx, abs(v - m) AS d FROM i JOIN m USING (frame_id, ty, tx)), s AS (SELECT frame_id, ty, tx, {MED.format('d')} * 1.4826 AS mad FROM d GROUP BY 1, 2, 3)
 SELECT frame_id, round(list_sort(list(mad))[CAST(floor(count(*) / 10) AS BIGINT) + 1], 6) AS noise FROM s GROUP BY 1""")
def agg_tile_noise(spark, sf_dir):
    return P.tile_noise(pixels(spark, sf_dir), 8, 8, side=2).select("frame_id", *R6("noise"))


def _tiles_sql() -> str:
    out = ", v0 AS (SELECT frame_id, CAST(y // 4 AS INTEGER) AS ty, CAST(x // 4 AS INTEGER) AS tx, v FROM pixels)"
    # A tile whose sigma is 0 stays as it is; clipping by sigma 0 is skipped for it.
    for k in range(3):
        out += f""", m{k} AS (SELECT frame_id, ty, tx, {MED.format('v')} AS median FROM v{k} GROUP BY 1, 2, 3), s{k} AS (SELECT frame_id, ty, tx, median, {MED.format('d')} * 1.4826 AS sigma FROM (SELECT frame_id, ty, tx, median, abs(v - median) AS d FROM v{k} JOIN m{k} USING (frame_id, ty, tx)) GROUP BY 1, 2, 3, 4),
 v{k + 1} AS (SELECT frame_id, ty, tx, v FROM v{k} JOIN s{k} USING (frame_id, ty, tx) WHERE sigma <= 0 OR abs(v - median) <= 3 * sigma)"""
    return out + f""", last AS (SELECT frame_id, ty, tx, {MED.format('v')} AS median, count(*) AS n FROM v3 GROUP BY 1, 2, 3 HAVING count(*) >= 8)"""


@query(_tiles_sql() + " SELECT frame_id, ty, tx, round(last.median, 6) AS median, round(s2.sigma, 6) AS sigma, n FROM last JOIN s2 USING (frame_id, ty, tx)")
def agg_bg_tiles(spark, sf_dir):
    t = P.clipped_tiles(pixels(spark, sf_dir), 4, 8, 8)
    return t.select("frame_id", "ty", "tx", *R6("median", "sigma"), F.col("n").cast("long").alias("n"))


def tiny_models(spark, sf_dir):
    """Planes through the 16 blocks of 2 x 2 pixels of each frame: enough tiles for a fit of degree 1."""
    blocks = pixels(spark, sf_dir).groupBy("frame_id", F.floor(F.col("y") / 2).cast("int").alias("ty"), F.floor(F.col("x") / 2).cast("int").alias("tx")).agg(F.avg("v").alias("median"))
    return P.fit_background(blocks, 2, 8, 8, degree=1, tolerance=1e9)


# The normal equations of a plane on a symmetric grid of 4 x 4 centres at -5/7, -1/7, 3/7, 1 (they aren't centred, so sums stay).
FIT = """, bl AS (SELECT frame_id, 2.0 * ((x // 2) * 2 + 1) / 7 - 1 AS bx, 2.0 * ((y // 2) * 2 + 1) / 7 - 1 AS byy, avg(v) AS v FROM pixels GROUP BY ALL),
 fx AS (SELECT frame_id, covar_pop(v, bx) / var_pop(bx) AS cx, covar_pop(v, byy) / var_pop(byy) AS cy, avg(v) AS mv, avg(bx) AS mx, avg(byy) AS my FROM bl GROUP BY 1), md AS (SELECT frame_id, mv - cx * mx - cy * my AS c0, cy, cx, mv AS level FROM fx)"""


@query(FIT + " SELECT frame_id, round(c0, 6) AS c0, round(cy, 6) AS cy, round(cx, 6) AS cx, 16 AS samples, round(level, 6) AS level FROM md")
def agg_bg_fit(spark, sf_dir):
    m = tiny_models(spark, sf_dir)
    return m.select("frame_id", *[F.round(F.get("coeffs", k), 6).alias(n) for k, n in enumerate(("c0", "cy", "cx"))], "samples", *R6("level"))


@query(FIT + " SELECT frame_id, y, x, round(v - (c0 + cy * (2.0 * y / 7 - 1) + cx * (2.0 * x / 7 - 1)) + level, 6) AS v FROM pixels JOIN md USING (frame_id)")
def agg_bg_subtract(spark, sf_dir):
    m = tiny_models(spark, sf_dir).withColumn("coeffs", F.concat("coeffs", F.array(*[F.lit(0.0)] * 3)))
    return P.subtract_background(pixels(spark, sf_dir), m, 8, 8).select("frame_id", "y", "x", *R6("v"))


@query(FIT + " SELECT frame_id, round(2 * abs(cx) + 2 * abs(cy), 6) AS amplitude FROM md")
def agg_gradient_amplitude(spark, sf_dir):
    m = tiny_models(spark, sf_dir).withColumn("coeffs", F.concat("coeffs", F.array(*[F.lit(0.0)] * 3)))
    return P.gradient_amplitude(m).select("frame_id", *R6("amplitude"))


def samples(spark, sf_dir):
    bg, noise = 0.55 + F.col("frame_id") % 5 / 100.0, 0.1 + F.col("frame_id") % 3 / 50.0
    p = pixels(spark, sf_dir)
    return p.select("master_id", "frame_id", "y", "x", S.matched(F.col("v"), bg, noise, F.lit(0.55), F.lit(0.1)).alias("v"), (1.0 + F.col("frame_id") % 4).alias("weight"))


#: At most so many frames set mean and sigma: fewer than the default of 60, so that the step is at work in small tables.
SAMPLED = 20

MATCHED = """, sm AS (SELECT master_id, frame_id, y, x, (v - (0.55 + CAST(frame_id % 5 AS DOUBLE) / 100)) * (CAST(0.1 AS DOUBLE) / (0.1 + CAST(frame_id % 3 AS DOUBLE) / 50)) + 0.55 AS v, 1.0 + frame_id % 4 AS weight FROM pixels)"""

ORDERED = f""",
 fo AS (SELECT master_id, frame_id, row_number() OVER (PARTITION BY master_id ORDER BY frame_id) - 1 AS ord, count(*) OVER (PARTITION BY master_id) AS n FROM (SELECT DISTINCT master_id, frame_id FROM pixels)),
 su AS (SELECT sm.*, ord % greatest(n // {SAMPLED}, 1) = 0 AS sampled FROM sm JOIN fo USING (master_id, frame_id))"""


def _stk(rows: str, used: str = "") -> str:
    """The stack of a table of samples; used: which of them set mean and sigma, all by default."""
    return f""",
 ss AS (SELECT master_id, y, x, avg(v) AS mean, stddev_samp(v) AS sigma FROM {rows}{used} GROUP BY 1, 2, 3), sc AS (SELECT {rows}.*, mean, sigma, coalesce(sigma > 0, false) AND (v - mean > 2.5 * sigma OR mean - v > 2 * sigma) AS gone FROM {rows} JOIN ss USING (master_id, y, x)),
 stk AS (SELECT master_id, y, x, CASE WHEN sum(CASE WHEN NOT gone THEN weight END) > 0 THEN sum(CASE WHEN NOT gone THEN CAST(weight AS DOUBLE) * v END) / sum(CASE WHEN NOT gone THEN CAST(weight AS DOUBLE) END) ELSE max(mean) END AS v, count(*) FILTER (WHERE gone) AS clipped, count(*) AS seen FROM sc GROUP BY 1, 2, 3)"""


CLIPPED = MATCHED + _stk("sm")
CLIPPED_BY_SAMPLE = MATCHED + ORDERED + _stk("su", " WHERE sampled")


@query(CLIPPED + " SELECT master_id, y, x, round(v, 6) AS v, clipped, seen FROM stk")
def agg_stack_sigma_clip(spark, sf_dir):
    return S.sigma_clip(samples(spark, sf_dir), ["master_id", "y", "x"], low=2.0, high=2.5).select("master_id", "y", "x", *R6("v"), "clipped", "seen")


@query(CLIPPED_BY_SAMPLE + " SELECT master_id, y, x, round(v, 6) AS v FROM stk")
def agg_stack_tiles(spark, sf_dir):
    """The bulk form of the stack, mean and sigma set by every so many frames, read back from its tiles."""
    s = samples(spark, sf_dir)
    tiles = Ti.to_tiles(s, 4, keys=("master_id", "frame_id"))
    frames = s.select("master_id", "frame_id", "weight").distinct()
    out = Ti.stack_tiles(tiles, frames, low=2.0, high=2.5, most_sampled=SAMPLED)
    return Ti.from_tiles(out, 4, keys=("master_id",)).select("master_id", "y", "x", *R6("v"))


@query(CLIPPED + """, mm AS (SELECT master_id, avg(v) AS stack_mean, stddev_samp(v) AS stack_noise, CAST(sum(clipped) AS DOUBLE) / sum(seen) * 100 AS clipped_pct FROM stk GROUP BY 1), ff AS (SELECT master_id, frame_id, stddev_samp(v) AS noise FROM sm GROUP BY 1, 2), f1 AS (SELECT master_id, arg_min(noise, frame_id) AS frame_noise, count(*) AS frames FROM ff GROUP BY 1)
 SELECT master_id, frames, round(clipped_pct, 6) AS clipped_pct, round(frame_noise / stack_noise, 4) AS noise_ratio, round(frames * 60 / 3600.0, 6) AS integration_h FROM mm JOIN f1 USING (master_id)""")
def agg_stack_compare(spark, sf_dir):
    """Each master against its first frame: how much quieter, of how many frames and hours."""
    s = samples(spark, sf_dir)
    stack = S.sigma_clip(s, ["master_id", "y", "x"], low=2.0, high=2.5)
    m = stack.groupBy("master_id").agg(F.stddev_samp("v").alias("stack_noise"), (F.sum("clipped") / F.sum("seen") * 100).alias("clipped_pct"))
    f = s.groupBy("master_id", "frame_id").agg(F.stddev_samp("v").alias("noise"))
    first = f.groupBy("master_id").agg(F.min_by("noise", "frame_id").alias("frame_noise"), F.count("*").alias("frames"))
    j = m.join(first, "master_id")
    return j.select("master_id", "frames", *R6("clipped_pct"), F.round(F.col("frame_noise") / F.col("stack_noise"), 4).alias("noise_ratio"), F.round(F.col("frames") * 60 / 3600.0, 6).alias("integration_h"))


SHIFT = "CAST(frame_id % 3 AS DOUBLE) / 4"


DRIZZLED = f""", sp AS (SELECT master_id, {COLOUR} AS channel, (x + {SHIFT}) * 2 AS cx, (y + CAST(frame_id % 2 AS DOUBLE) / 2) * 2 AS cy, v, 1.0 + frame_id % 4 AS weight FROM pixels),
 o AS (SELECT *, unnest(range(CAST(floor(cy - 0.35) AS BIGINT), CAST(floor(cy + 0.35) AS BIGINT) + 1)) AS oy FROM sp), oo AS (SELECT *, unnest(range(CAST(floor(cx - 0.35) AS BIGINT), CAST(floor(cx + 0.35) AS BIGINT) + 1)) AS ox FROM o),
 a AS (SELECT *, (least(cx + 0.35, ox + 1) - greatest(cx - 0.35, ox)) AS sx, (least(cy + 0.35, oy + 1) - greatest(cy - 0.35, oy)) AS sy FROM oo WHERE oy >= 0 AND oy < 16 AND ox >= 0 AND ox < 16)"""


@query(DRIZZLED + """
 SELECT master_id, channel, oy, ox, round(sum(v * sx * sy * weight) / sum(sx * sy * weight), 6) AS v, round(sum(sx * sy * weight), 6) AS weight FROM a WHERE sx > 0 AND sy > 0 GROUP BY 1, 2, 3, 4""")
def agg_drizzle(spark, sf_dir):
    return drizzled(spark, sf_dir).select("master_id", "channel", "oy", "ox", *R6("v", "weight"))


@query(DRIZZLED + """
 SELECT master_id, round(100 - 100 * count(*) / CAST(3 * 16 * 16 AS DOUBLE), 6) AS empty_pct FROM (SELECT DISTINCT master_id, channel, oy, ox FROM a WHERE sx > 0 AND sy > 0) GROUP BY 1""")
def agg_drizzle_empty(spark, sf_dir):
    return S.drizzle_empty(drizzled(spark, sf_dir), ["master_id"], 2, 8, 8).select("master_id", *R6("empty_pct"))


def drizzled(spark, sf_dir):
    p = pixels(spark, sf_dir)
    shifted = p.select("master_id", P.mosaic_channel().alias("channel"), (F.col("x") + F.expr(SHIFT)).alias("px"), (F.col("y") + F.col("frame_id") % 2 / 2).alias("py"), "v", (1.0 + F.col("frame_id") % 4).alias("weight"))
    return S.drizzle(shifted, ["master_id"], 2, 8, 8)


def _cubic(values: list[str], t: str) -> str:
    a, b, c, d = values
    return f"0.5 * ((2 * {b}) + (-({a}) + ({c})) * {t} + (2 * {a} - 5 * {b} + 4 * {c} - ({d})) * {t} * {t} + (-({a}) + 3 * {b} - 3 * {c} + ({d})) * {t} * {t} * {t})"


@query(f""", t AS (SELECT frame_id, y, x, x - (0.25 + frame_id % 2) AS sx, y - 0.5 AS sy FROM pixels), u AS (SELECT *, CAST(floor(sx) AS INTEGER) AS x1, CAST(floor(sy) AS INTEGER) AS y1 FROM t WHERE floor(sx) >= 1 AND floor(sy) >= 1 AND floor(sx) + 2 < 8 AND floor(sy) + 2 < 8),
 k AS (SELECT u.frame_id, u.y, u.x, sx - x1 AS fx, sy - y1 AS fy, p.y - y1 + 1 AS j, max(CASE WHEN p.x = x1 - 1 THEN v END) AS a, max(CASE WHEN p.x = x1 THEN v END) AS b, max(CASE WHEN p.x = x1 + 1 THEN v END) AS c, max(CASE WHEN p.x = x1 + 2 THEN v END) AS d FROM u JOIN pixels p ON p.frame_id = u.frame_id AND p.y BETWEEN y1 - 1 AND y1 + 2 AND p.x BETWEEN x1 - 1 AND x1 + 2 GROUP BY ALL),
 l AS (SELECT frame_id, y, x, fy, j, {_cubic(['a', 'b', 'c', 'd'], 'fx')} AS row FROM k), m AS (SELECT frame_id, y, x, fy, max(CASE WHEN j = 0 THEN row END) AS a, max(CASE WHEN j = 1 THEN row END) AS b, max(CASE WHEN j = 2 THEN row END) AS c, max(CASE WHEN j = 3 THEN row END) AS d FROM l GROUP BY 1, 2, 3, 4)
 SELECT frame_id, y, x, round({_cubic(['a', 'b', 'c', 'd'], 'fy')}, 6) AS v FROM m""")
def agg_resample(spark, sf_dir):
    p = pixels(spark, sf_dir)
    t = p.select("frame_id").distinct().select("frame_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), (0.25 + F.col("frame_id") % 2).alias("tx"), F.lit(0.5).alias("ty"))
    return Ti.resample(p.select("frame_id", "y", "x", "v"), t, side=4).select("frame_id", "y", "x", *R6("v"))


@query(""", f AS (SELECT project_id, frame_id % 20 <> 0 AS ok, CAST(frame_id % 100 AS DOUBLE) / 50 AS rotation, CAST(frame_id % 7 AS DOUBLE) AS tx, CAST(frame_id % 11 AS DOUBLE) / 2 AS ty, exptime FROM frames)
 SELECT project_id, count(*) FILTER (WHERE ok) AS used, count(*) FILTER (WHERE NOT ok) AS failed, min(rotation) FILTER (WHERE ok) AS rotation_min, max(rotation) FILTER (WHERE ok) AS rotation_max, round(max(sqrt(tx * tx + ty * ty)) FILTER (WHERE ok), 6) AS drift, sum(exptime) FILTER (WHERE ok) AS integration_s FROM f GROUP BY 1""", views=("frames",))
def agg_stack_metrics(spark, sf_dir):
    f = view(spark, sf_dir, "frames")
    i = F.col("frame_id")
    rows = f.select("project_id", (i % 20 != 0).alias("ok"), (i % 100 / 50).alias("rotation"), (i % 7).cast("double").alias("tx"), (i % 11 / 2).alias("ty"), "exptime")
    return S.metrics(rows, ["project_id"]).withColumn("drift", F.round("drift", 6))


@query(RGB + """, m AS (SELECT channel, y, x, avg(CASE WHEN frame_id % 2 = 0 THEN v END) AS a, avg(CASE WHEN frame_id % 2 = 1 THEN v END) AS b, avg(v) AS m FROM ch GROUP BY 1, 2, 3)
 SELECT channel, round(avg(abs(1 - (1 - a) * (1 - b) - m)), 6) AS mean_error, round(max(abs(1 - (1 - a) * (1 - b) - m)), 6) AS worst_error FROM m GROUP BY 1""")
def jn_screen_merge(spark, sf_dir):
    p = planes(spark, sf_dir)
    mean = lambda d: d.groupBy("channel", "y", "x").agg(F.avg("v").alias("v"))
    return P.screen_merge(mean(p.where("frame_id % 2 = 0")), mean(p.where("frame_id % 2 = 1")), mean(p)).select("channel", *R6("mean_error", "worst_error"))


def _fit_sql() -> str:
    """The root in closed brackets: bisection unrolled as a recursive query."""
    f = {"arcsinh": "asinh(m * bg) / asinh(m)", "log": "ln(1 + m * bg) / ln(1 + m)"}
    return f""", bgs AS (SELECT DISTINCT frame_id, 0.01 + CAST(frame_id % 50 AS DOUBLE) / 1000 AS bg FROM pixels), it AS (SELECT * FROM (WITH RECURSIVE r(frame_id, alg, bg, lo, hi, k) AS (
 SELECT frame_id, alg, bg, CAST(1 AS DOUBLE), CAST(1e6 AS DOUBLE), 0 FROM bgs CROSS JOIN (SELECT unnest(['arcsinh', 'log']) AS alg)
 UNION ALL SELECT frame_id, alg, bg, CASE WHEN low THEN m ELSE lo END, CASE WHEN low THEN hi ELSE m END, k + 1 FROM (SELECT *, CASE alg WHEN 'arcsinh' THEN {f['arcsinh']} ELSE {f['log']} END < 0.25 AS low FROM (SELECT *, sqrt(lo * hi) AS m FROM r WHERE k < 60)))
 SELECT * FROM r WHERE k = 60)) SELECT frame_id, round(max(CASE WHEN alg = 'arcsinh' THEN sqrt(lo * hi) END), 4) AS arcsinh, round(max(CASE WHEN alg = 'log' THEN sqrt(lo * hi) END), 4) AS log FROM it GROUP BY 1"""


@query(_fit_sql())
def agg_fit_stretch(spark, sf_dir):
    bg = pixels(spark, sf_dir).select("frame_id", (0.01 + F.col("frame_id") % 50 / 1000).alias("bg")).distinct()
    return bg.select("frame_id", *[F.round(D.fit_stretch(a, F.col("bg")), 4).alias(a) for a in ("arcsinh", "log")])


@query(""", s AS (SELECT frame_id, list_sort(list(flux))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS flux, list_sort(list(hfr))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS hfr, count(*) AS n FROM stars GROUP BY 1)
 SELECT f.frame_id, round(CASE WHEN coalesce(n, 0) = 0 OR noise <= 0 THEN 0 ELSE (flux * sqrt(n) / noise) * (flux * sqrt(n) / noise) / (greatest(s.hfr, 0.25) * greatest(s.hfr, 0.25)) / 1e12 END, 6) AS weight FROM frames f LEFT JOIN s USING (frame_id)""", views=("frames", "stars"))
def agg_frame_weight(spark, sf_dir):
    w = S.frame_weights(view(spark, sf_dir, "stars"), view(spark, sf_dir, "frames").select("frame_id", "noise"))
    return w.select("frame_id", F.round(F.col("weight") / 1e12, 6).alias("weight"))
