"""Stacks: weights, sigma-clipped combination, drizzle, metrics.

This is the long form, which groups single samples; the bulk form over tiles is in tiles.py. Both give the same master.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions.robust import upper_median


def frame_weights(stars: DataFrame, noise: DataFrame) -> DataFrame:
    """frame_id, weight: squared signal to noise over squared HFR, so a blurred frame cannot lead; 0 without stars or noise."""
    s = stars.groupBy("frame_id").agg(upper_median("flux").alias("flux"), upper_median("hfr").alias("hfr"), F.count("*").alias("n"))
    j = noise.join(s, "frame_id", "left")
    snr = F.col("flux") * F.sqrt("n") / F.col("noise")
    w = F.pow(snr, F.lit(2)) / F.pow(F.greatest(F.col("hfr"), F.lit(0.25)), F.lit(2))
    return j.select("frame_id", F.when((F.coalesce("n", F.lit(0)) == 0) | (F.col("noise") <= 0), 0.0).otherwise(w).alias("weight"))


def matched(v: Column, background: Column, noise: Column, ref_background: Column, ref_noise: Column) -> Column:
    """A frame's value on the scale of the reference frame."""
    return (v - background) * (ref_noise / F.greatest(noise, F.lit(1e-9))) + ref_background


def sigma_clip(samples: DataFrame, keys: list[str], low: float = 3.0, high: float = 3.0, sample_step: Column | None = None) -> DataFrame:
    """keys, v, clipped, seen from samples(keys, v, weight): weighted mean of what lies within the limits of the plain mean and sample sigma; the mean where nothing does.

    sample_step: true for the samples that set mean and sigma (all by default). Two aggregations on the same keys: one shuffle of the samples, as partial sums.
    """
    use = F.col("v") if sample_step is None else F.when(sample_step, F.col("v"))
    stats = samples.groupBy(*keys).agg(F.avg(use).alias("mean"), F.stddev_samp(use).alias("sigma"))
    d = F.col("v") - F.col("mean")
    out = F.coalesce(F.col("sigma") > 0, F.lit(False)) & ((d > high * F.col("sigma")) | (-d > low * F.col("sigma")))
    j = samples.join(stats, keys).withColumn("out", out)
    kept = F.when(~F.col("out"), F.col("weight"))
    g = j.groupBy(*keys).agg(
        F.sum(kept * F.col("v")).alias("sum"), F.sum(kept).alias("weights"), F.max("mean").alias("mean"), F.count(F.when(F.col("out"), 1)).alias("clipped"), F.count("*").alias("seen")
    )
    return g.select(*keys, F.when(F.col("weights") > 0, F.col("sum") / F.col("weights")).otherwise(F.col("mean")).alias("v"), "clipped", "seen")


def combine(cube: np.ndarray, weights: np.ndarray, low: float, high: float, sampled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of (n, ...) samples in memory, NaN where a frame has none: the combined tile and how many were clipped."""
    import warnings

    with warnings.catch_warnings(), np.errstate(invalid="ignore", divide="ignore"):
        warnings.simplefilter("ignore", RuntimeWarning)
        mean = np.nanmean(cube[sampled], axis=0)
        seen = (~np.isnan(cube[sampled])).sum(axis=0)
        sigma = np.where(seen > 1, np.nanstd(cube[sampled], axis=0, ddof=1), 0.0)
        d = cube - mean
        out = (sigma > 0) & ((d > high * sigma) | (-d > low * sigma))
        use = ~out & ~np.isnan(cube)
        w = weights.reshape(-1, *[1] * (cube.ndim - 1)) * use
        total = w.sum(axis=0)
        value = np.where(total > 0, np.where(use, cube * w, 0).sum(axis=0) / total, mean)
    return value, out.sum(axis=0)


def drizzle(samples: DataFrame, keys: list[str], scale: int, width: int, height: int, pixfrac: float = 0.7) -> DataFrame:
    """keys, channel, oy, ox, v, weight from samples(keys, channel, px, py, v, weight), px and py on the reference grid.

    Each sample falls as a square of side pixfrac on a grid `scale` times finer, its area shared by overlap: at most four cells, as partial sums.
    """
    half = min(max(pixfrac * 0.5, 0.05), 0.5)
    s = samples.withColumns({"cx": F.col("px") * scale, "cy": F.col("py") * scale})
    cells = lambda c: F.sequence(F.floor(F.col(c) - half), F.floor(F.col(c) + half))
    s = s.withColumn("oy", F.explode(cells("cy"))).withColumn("ox", F.explode(cells("cx")))
    s = s.where((F.col("oy") >= 0) & (F.col("oy") < height * scale) & (F.col("ox") >= 0) & (F.col("ox") < width * scale))
    side = lambda c, o: F.least(F.col(c) + half, F.col(o) + 1) - F.greatest(F.col(c) - half, F.col(o).cast("double"))
    s = s.withColumns({"sx": side("cx", "ox"), "sy": side("cy", "oy")}).where("sx > 0 and sy > 0")
    area = F.col("sx") * F.col("sy") * F.col("weight")
    return s.groupBy(*keys, "channel", "oy", "ox").agg((F.sum(F.col("v") * area) / F.sum(area)).alias("v"), F.sum(area).alias("weight"))


def drizzle_empty(drizzled: DataFrame, keys: list[str], scale: int, width: int, height: int, channels: int = 3) -> DataFrame:
    """keys, empty_pct: the percentage of a drizzled grid's cells, over all channels, that no sample reached."""
    cells = channels * width * scale * height * scale
    return drizzled.groupBy(*keys).agg((100 * (1 - F.count(F.when(F.col("weight") > 0, 1)) / F.lit(float(cells)))).alias("empty_pct"))


def metrics(frames: DataFrame, by: list[str]) -> DataFrame:
    """by, used, failed, rotation range, drift and integration from frames(by, ok, rotation, tx, ty, exptime)."""
    ok = lambda c: F.when(F.col("ok"), c)
    drift = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    return frames.groupBy(*by).agg(
        F.count(ok(F.lit(1))).alias("used"),
        F.count(F.when(~F.col("ok"), 1)).alias("failed"),
        F.min(ok(F.col("rotation"))).alias("rotation_min"),
        F.max(ok(F.col("rotation"))).alias("rotation_max"),
        F.max(ok(drift)).alias("drift"),
        F.sum(ok(F.col("exptime"))).alias("integration_s"),
    )
