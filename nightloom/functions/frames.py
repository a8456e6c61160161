"""Column builders of the frame catalogue: nights, keys, classes, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of narrow or multi-band filters, letters and digits only.
NARROWBAND = ["HA", "HALPHA", "OIII", "O3", "SII", "S2", "NARROW", "DUAL", "DUO", "TRIBAND", "QUADBAND", "LEXTREME", "LENHANCE", "LULTIMATE", "ALPT", "NBZ", "NB"]


def night(ts: Column) -> Column:
    """Observing night, noon to noon."""
    return F.to_date(ts - F.expr("INTERVAL 12 HOURS"))


def second(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def pseudo_second(ts: Column) -> Column:
    """Ordinal second of a calendar of 372-day years and 31-day months: sorts like time, counts short months as long ones."""
    days = F.year(ts) * 372 + F.month(ts) * 31 + F.dayofmonth(ts)
    return days.cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def date_obs(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def identity(ts: Column, obj: Column, exptime: Column) -> Column:
    """What makes a frame the same frame wherever its file lies."""
    return F.concat_ws("|", date_obs(ts), obj, F.bround(exptime, 1).cast("string"))


def group_key(obj: Column, night_: Column, filter_: Column, exptime: Column) -> Column:
    return F.concat_ws("|", obj, night_.cast("string"), filter_, F.bround(exptime).cast("long").cast("string"))


def master_key(obj: Column) -> Column:
    return F.concat_ws("|", F.lit("master"), obj)


def classify(planes: Column, width: Column, height: Column, stack_count: Column | None = None, image_type: Column | None = None, bayer: Column | None = None) -> Column:
    """struct(kind, reason): Master where it counts stacked frames or has three planes, even without dimensions; else Unreadable without them, else Light.
    The reason names the header values that decided."""
    absent = F.lit(None).cast("string")
    count = absent if stack_count is None else stack_count
    header = lambda c, none: F.trim(F.coalesce(absent if c is None else c, F.lit(none)))
    rules = [
        (count.isNotNull(), "Master", F.format_string("STACKCNT = %s, NAXIS3 = %s", count.cast("string"), planes.cast("string"))),
        (planes == 3, "Master", F.format_string("NAXIS3 = %s, already colour", planes.cast("string"))),
        ((width <= 0) | (height <= 0), "Unreadable", F.lit("no image dimensions")),
        (F.lit(True), "Light", F.format_string("IMAGETYP = %s, single plane, BAYERPAT = %s", header(image_type, "?"), header(bayer, "none"))),
    ]
    kind, reason = (F.coalesce(*[F.when(rule[0], rule[k]) for rule in rules]) for k in (1, 2))
    return F.struct(kind.alias("kind"), reason.alias("reason"))


def is_narrowband(name: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]", "")).rlike("|".join(NARROWBAND))


def quality_band(quality: Column) -> Column:
    """0 (worst) to 4 (best), cut at .2, .4, .6, .8."""
    return F.when(quality < 0.2, 0).when(quality < 0.4, 1).when(quality < 0.6, 2).when(quality < 0.8, 3).otherwise(4)


def pixel_scale(pixel_um: Column, focal_mm: Column) -> Column:
    """Arc seconds a pixel, 0 without a focal length."""
    return F.when(focal_mm > 0, F.lit(206.265) * pixel_um / focal_mm).otherwise(0.0)


def master_name(obj: Column, exposure: Column, filter_: Column, night_: Column, count: Column | None = None) -> Column:
    """File name of a master; the frame count is left out unless given, so a better stack keeps the name."""
    target = F.when(obj == "", "Stack").otherwise(F.regexp_replace(obj, " ", ""))
    band = F.when(filter_ == "", "LP").otherwise(filter_)
    when = F.when(night_ == "", "").otherwise(F.concat(F.lit("_"), F.regexp_replace(night_, "-", "")))
    frames = F.concat(F.lit("_"), count.cast("string"), F.lit("x")) if count is not None else F.lit("")
    return F.concat(target, frames, F.lit("_"), F.bround(exposure).cast("long").cast("string"), F.lit("s_"), band, when, F.lit(".fit"))
