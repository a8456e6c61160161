"""Pixel tables in the long form (frame_id, y, x, v): demosaic, statistics, tiles, backgrounds.

Everything groups by frame and place, so a frame's pixels may lie in many tasks. Medians of whole planes sort in a window; those of small
tiles use arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.develop import TARGET, bound, clamp, mtf
from nightloom.functions.robust import SIGMA, mad_of, median_of, wide_mad, wide_median
from nightloom.operators.tiles import banded

CHANNELS = "rgb"


def mosaic_channel(pattern: str = "GRBG") -> Column:
    """0 red, 1 green, 2 blue of a pixel by the parity of y and x."""
    at = ["RGB".index(c) for c in pattern]
    return F.when(F.col("y") % 2 == 0, F.when(F.col("x") % 2 == 0, at[0]).otherwise(at[1])).otherwise(F.when(F.col("x") % 2 == 0, at[2]).otherwise(at[3]))


def debayer_half(pixels: DataFrame, pattern: str = "GRBG", keys=("frame_id",)) -> DataFrame:
    """keys, y, x, r, g, b: each 2 x 2 block as one pixel, a colour's samples averaged."""
    c = mosaic_channel(pattern)
    block = pixels.select(*keys, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), c.alias("c"), "v")
    return block.groupBy(*keys, "y", "x").agg(*[F.coalesce(F.avg(F.when(F.col("c") == k, F.col("v"))), F.lit(0.0)).alias(n) for k, n in enumerate(CHANNELS)])


def demosaic(plane: np.ndarray, pattern: str = "GRBG", row: int = 0) -> np.ndarray:
    """Bilinear (h, w, 3) of a mosaic whose first line is `row` of the pattern's, edges repeated."""
    p = np.pad(plane, 1, mode="edge")
    shift = lambda dy, dx: p[1 + dy : 1 + dy + plane.shape[0], 1 + dx : 1 + dx + plane.shape[1]]
    horizontal, vertical = (shift(0, -1) + shift(0, 1)) / 2, (shift(-1, 0) + shift(1, 0)) / 2
    diagonal = (shift(-1, -1) + shift(-1, 1) + shift(1, -1) + shift(1, 1)) / 4
    yy, xx = np.indices(plane.shape)
    yy = yy + row
    own = np.array(["RGB".index(c) for c in pattern])[(yy % 2) * 2 + xx % 2]
    beside = np.array(["RGB".index(c) for c in pattern])[(yy % 2) * 2 + (xx + 1) % 2]  # the colour of the row's other pixels
    out = np.empty((*plane.shape, 3))
    for c in range(3):
        cross = np.where(own == 1, np.where(beside == c, horizontal, vertical), np.where(c == 1, (horizontal + vertical) / 2, diagonal))
        out[:, :, c] = np.where(own == c, plane, cross)
    return out


def debayer_full(pixels: DataFrame, pattern: str = "GRBG", rows: int = 32) -> DataFrame:
    """frame_id, y, x, r, g, b at full size, in bands of rows: each band also gets the line above and the line below it from its neighbours; edges of the frame are repeated."""

    def one(key, band):
        import pandas as pd

        top = int(band["y"].min())
        plane = np.zeros((int(band["y"].max()) - top + 1, int(band["x"].max()) + 1))
        plane[band["y"] - top, band["x"]] = band["v"]
        first = key[1] * rows - top  # 1 where there is a line above
        rgb = demosaic(plane, pattern, top)[first : first + rows]
        yy, xx = np.indices(rgb.shape[:2])
        return pd.DataFrame({"frame_id": key[0], "y": yy.ravel() + key[1] * rows, "x": xx.ravel(), **{n: rgb[:, :, k].ravel() for k, n in enumerate(CHANNELS)}})

    # A line below the last band makes no band of its own: a band has a row that isn't rim.
    b = banded(pixels.select("frame_id", "y", "x", "v"), rows)
    last = pixels.groupBy("frame_id").agg(F.floor(F.max("y") / rows).cast("int").alias("last"))
    return b.join(last, "frame_id").where("band <= last").groupBy("frame_id", "band").applyInPandas(one, "frame_id long, y int, x int, r double, g double, b double")


def channels(rgb: DataFrame, keys=("frame_id",)) -> DataFrame:
    """Long form (keys, channel, y, x, v) of r, g, b columns."""
    each = F.array(*[F.struct(F.lit(k).alias("channel"), F.col(n).alias("v")) for k, n in enumerate(CHANNELS)])
    return rgb.select(*keys, "y", "x", F.explode(each).alias("p")).select(*keys, F.col("p.channel").alias("channel"), "y", "x", F.col("p.v").alias("v"))


def strided(pixels: DataFrame, width: int, stride: int) -> DataFrame:
    """Every stride-th pixel of the flat index, as the sampled statistics take them."""
    return pixels.where((F.col("y") * width + F.col("x")) % stride == 0)


def auto_stf(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median, mad, shadows, midtone from values(keys, v): the sky goes to the target, what lies 2.8 sigma below it to black."""
    s = wide_mad(values, keys, "v", "median", "mad")
    s = s.withColumn("shadows", clamp(F.col("median") - 2.8 * F.col("mad")))
    return s.withColumn("midtone", mtf(F.lit(TARGET), clamp(F.col("median") - F.col("shadows"))))


def display_scale(pixels: DataFrame, bitpix: Column, pedestal: Column, forced: float = 0.0) -> DataFrame:
    """v scaled to [0, 1] for display; a pedestal above all data is ignored. pixels has frame_id and v; bitpix and pedestal are of its columns."""
    most = pixels.groupBy("frame_id").agg(F.max("v").alias("most"))
    p = pixels.join(most, "frame_id")
    ped = F.when(pedestal > F.col("most"), 0.0).otherwise(pedestal)
    full = F.lit(float(forced)) if forced > 0 else F.when(bitpix == 8, 255.0).when(bitpix == 16, 65535.0).otherwise(F.greatest(F.col("most"), F.lit(1.0)))
    span = F.greatest(full - ped, F.when(bitpix < 0, 1e-6).otherwise(1.0))
    return p.withColumn("v", clamp((F.col("v") - ped) / span)).drop("most")


def prestretched(planes: DataFrame, width: int, keys=("frame_id",)) -> DataFrame:
    """keys, channel, y, x, v, m, scale: planes stretched without a black point so that mtf(1 - m) undoes it."""
    scale = planes.groupBy(*keys).agg(F.greatest(F.max("v"), F.lit(1.0)).alias("scale"))
    p = planes.join(scale, list(keys)).withColumn("v", clamp(F.col("v") / F.col("scale")))
    m = wide_median(strided(p, width, 7), [*keys, "channel"], "v", "median").withColumn("m", mtf(F.lit(TARGET), clamp(F.col("median")))).drop("median")
    return p.join(m, [*keys, "channel"]).withColumn("v", mtf(F.col("m"), F.col("v")))


def histogram(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, n: 256 bins of values in [0, 1]; only bins that have any."""
    return values.groupBy(*keys, F.floor(clamp(F.col("v")) * 255).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cdf, the equalising table: share of pixels up to a bin. Windows of 256 rows."""
    w = Window.partitionBy(*keys)
    return hist.withColumn("cdf", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))


def smoothed(hist: DataFrame, keys: list[str], reach: int = 2) -> DataFrame:
    """All 256 bins (empty ones as 0) with the mean of those within reach, truncated at the ends."""
    every = hist.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    full = every.join(hist, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("smooth", F.avg("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(-reach, reach)))


def thumbnail(rgb: DataFrame, stf: DataFrame, step: int, width: int, height: int) -> DataFrame:
    """frame_id, y, x, r, g, b as bytes: boxes of step x step, stretched by stf(frame_id, channel, shadows, midtone), first row at the top."""
    tw, th = width // step, height // step
    boxes = channels(rgb).select("frame_id", "channel", F.floor(F.col("y") / step).cast("int").alias("y"), F.floor(F.col("x") / step).cast("int").alias("x"), "v").where((F.col("y") < th) & (F.col("x") < tw))
    mean = boxes.groupBy("frame_id", "channel", "y", "x").agg(F.avg("v").alias("v")).join(stf, ["frame_id", "channel"])
    shown = mean.withColumn("v", mtf(F.col("midtone"), clamp((F.col("v") - F.col("shadows")) / F.greatest(1 - F.col("shadows"), F.lit(1e-6)))))
    flipped = shown.withColumn("y", F.lit(th - 1) - F.col("y"))
    return flipped.groupBy("frame_id", "y", "x").agg(*[F.max(F.when(F.col("channel") == k, F.floor(F.col("v") * 255 + 0.5).cast("int"))).alias(n) for k, n in enumerate(CHANNELS)])


def tile_noise(pixels: DataFrame, width: int, height: int, side: int = 32, keys=("frame_id",)) -> DataFrame:
    """keys, noise: of the tiles' sigmas the one at a tenth. Tiles start below size - side, so an exact multiple loses its last row and column."""
    ty, tx = F.floor(F.col("y") / side), F.floor(F.col("x") / side)
    inside = pixels.withColumns({"ty": ty, "tx": tx}).where((F.col("ty") * side < height - side) & (F.col("tx") * side < width - side))
    mads = inside.groupBy(*keys, "ty", "tx").agg(mad_of(F.collect_list("v")).alias("mad"))
    w = Window.partitionBy(*keys)
    ranked = mads.withColumns({"r": F.row_number().over(w.orderBy("mad", "ty", "tx")), "n": F.count("*").over(w)})
    return ranked.where(F.col("r") == F.floor(F.col("n") / 10) + 1).select(*keys, F.col("mad").alias("noise"))


def clipped_tiles(pixels: DataFrame, side: int, width: int, height: int, keys=("frame_id",), rounds: int = 3) -> DataFrame:
    """keys, ty, tx, median, sigma, n: medians of whole tiles after up to three rounds of 3-sigma clipping; tiles left with fewer than 8 values are dropped."""
    ty, tx = F.floor(F.col("y") / side), F.floor(F.col("x") / side)
    whole = pixels.withColumns({"ty": ty.cast("int"), "tx": tx.cast("int")}).where(((F.col("ty") + 1) * side <= height) & ((F.col("tx") + 1) * side <= width))
    t = whole.groupBy(*keys, "ty", "tx").agg(F.collect_list("v").alias("vals")).where(F.size("vals") >= 8)

    def clip(a, _):
        """One round on struct(vals, median, sigma, open); a tile whose sigma is 0, or that is too thin, stays as it is."""

        def with_sigma(s):
            go = a["open"] & (s > 0)
            kept = F.filter(a["vals"], lambda v: F.abs(v - a["median"]) <= 3 * s)
            return bound(F.when(go, kept).otherwise(a["vals"]), lambda k: F.struct(k.alias("vals"), F.when(go, median_of(k)).otherwise(a["median"]).alias("median"), F.when(a["open"], s).otherwise(a["sigma"]).alias("sigma"), (go & (F.size(k) >= 8)).alias("open")))

        return bound(mad_of(a["vals"]), with_sigma)

    start = F.struct(F.col("vals"), median_of(F.col("vals")).alias("median"), F.lit(0.0).alias("sigma"), F.lit(True).alias("open"))
    t = t.withColumn("s", F.reduce(F.sequence(F.lit(1), F.lit(rounds)), start, clip))
    return t.where(F.size("s.vals") >= 8).select(*keys, "ty", "tx", "s.median", "s.sigma", F.size("s.vals").alias("n"))


def terms(x, y, degree: int = 2) -> list:
    """Polynomial basis x^i y^(t - i) for t = 0..degree, i = 0..t; of numbers, arrays or columns."""
    power = lambda v, n: 1.0 if n == 0 else v if n == 1 else v * power(v, n - 1)
    return [power(x, i) * power(y, t - i) for t in range(degree + 1) for i in range(t + 1)]


def fit_background(tiles: DataFrame, side: int, width: int, height: int, keys=("frame_id",), degree: int = 2, tolerance: float = 2.0, refits: int = 2) -> DataFrame:
    """keys, coeffs, samples, level: least squares over tile medians; refits drop what lies more than tolerance sigmas above, since nebulae only add light.

    A group is the tiles of one plane, some thousands at most.
    """
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema}

    def one(key, frame):
        import pandas as pd

        frame = frame.sort_values(["ty", "tx"])
        x = 2.0 * (frame["tx"].to_numpy() * side + side // 2) / (width - 1) - 1
        y = 2.0 * (frame["ty"].to_numpy() * side + side // 2) / (height - 1) - 1
        a = np.stack([np.broadcast_to(t, x.shape) for t in terms(x, y, degree)], axis=1)
        v = frame["median"].to_numpy()
        least = 2 * a.shape[1]
        empty = pd.DataFrame(columns=[*keys, "coeffs", "samples", "level"])
        if len(v) < least:
            return empty
        solved = lambda: np.linalg.solve(a.T @ a, a.T @ v)
        try:
            c = solved()
            for _ in range(max(1, refits)):
                left = v - a @ c
                sigma = np.sort(np.abs(left))[len(v) // 2] * SIGMA
                keep = left <= tolerance * sigma
                if sigma <= 0 or keep.all() or keep.sum() < least:
                    break
                a, v = a[keep], v[keep]
                c = solved()
        except np.linalg.LinAlgError:
            return empty
        return pd.DataFrame([[*key, c.tolist(), len(v), float((a @ c).mean())]], columns=[*keys, "coeffs", "samples", "level"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", coeffs array<double>, samples int, level double"
    return tiles.groupBy(*keys).applyInPandas(one, schema)


def model_at(coeffs: Column, x: Column, y: Column, degree: int = 2) -> Column:
    out = F.lit(0.0)
    for k, t in enumerate(terms(x, y, degree)):
        out = out + F.get(coeffs, k) * t
    return out


def subtract_background(pixels: DataFrame, models: DataFrame, width: int, height: int, keys=("frame_id",), restore: bool = True) -> DataFrame:
    """v less its model, the model's level put back; models is a row a plane."""
    p = pixels.join(models.select(*keys, "coeffs", "level"), list(keys))
    x, y = 2.0 * F.col("x") / (width - 1) - 1, 2.0 * F.col("y") / (height - 1) - 1
    v = F.col("v") - model_at(F.col("coeffs"), x, y)
    return p.withColumn("v", v + F.col("level") if restore else v).drop("coeffs", "level")


def gradient_amplitude(models: DataFrame, keys=("frame_id",), points: int = 17) -> DataFrame:
    """keys, amplitude: highest less lowest value of a model on a grid over the plane."""
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: 2.0 * i / (points - 1) - 1)
    grid = models.select(*keys, "coeffs", F.explode(at).alias("gx")).select(*keys, "coeffs", "gx", F.explode(at).alias("gy"))
    return grid.withColumn("m", model_at(F.col("coeffs"), F.col("gx"), F.col("gy"))).groupBy(*keys).agg((F.max("m") - F.min("m")).alias("amplitude"))


def screen_merge(stars: DataFrame, starless: DataFrame, master: DataFrame, keys=("channel", "y", "x")) -> DataFrame:
    """channel, mean_error, worst_error of 1 - (1 - a)(1 - b) against the master."""
    j = stars.select(*keys, F.col("v").alias("a")).join(starless.select(*keys, F.col("v").alias("b")), list(keys)).join(master.select(*keys, F.col("v").alias("m")), list(keys))
    error = F.abs(1 - (1 - F.col("a")) * (1 - F.col("b")) - F.col("m"))
    return j.groupBy("channel").agg(F.avg(error).alias("mean_error"), F.max(error).alias("worst_error"))


def cropped(pixels: DataFrame, width: int, height: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Pixels in an ordered rectangle in shares of the size; one of .02 or less on a side changes nothing."""
    x0, x1 = sorted(min(1.0, max(0.0, v)) for v in (x0, x1))
    y0, y1 = sorted(min(1.0, max(0.0, v)) for v in (y0, y1))
    if x1 - x0 <= 0.02 or y1 - y0 <= 0.02:
        return pixels
    u, v = (F.col("x") + 0.5) / width, (F.col("y") + 0.5) / height
    return pixels.where((u >= x0) & (u <= x1) & (v >= y0) & (v <= y1))


def swap_red_blue(planes: DataFrame) -> DataFrame:
    return planes.withColumn("channel", F.lit(2) - F.col("channel"))
