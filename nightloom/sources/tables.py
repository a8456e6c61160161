"""Catalogue and star tables as text files whose header line is the schema, and the stored catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the frame catalogue, with type and default.
CATALOGUE = [
    ("frame_id", "long", 0), ("project_id", "long", 0), ("object", "string", ""), ("filter", "string", ""), ("exptime", "double", 0.0), ("night", "string", ""), ("second", "long", 0),
    ("stars", "long", 0), ("hfr", "double", 0.0), ("ecc", "double", 0.0), ("background", "double", 0.0), ("noise", "double", 0.0), ("trails", "long", 0), ("quality", "double", 0.0),
    ("rejected", "boolean", False), ("has_wcs", "boolean", False), ("width", "long", 0), ("height", "long", 0), ("bytes", "long", 0),
]


def write_catalogue(frames: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet by night, or tab-separated text with a header; flags become 1 and 0 there."""
    kept = frames.select(*[n for n, _, _ in CATALOGUE if n in frames.columns])
    if form == "parquet":
        kept.repartition("night").write.partitionBy("night").parquet(path)
    else:
        kept.withColumns({n: F.col(n).cast("int") for n, t, _ in CATALOGUE if t == "boolean" and n in kept.columns}).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """By column name: missing columns and cells that don't parse get defaults, unknown columns are dropped, '1' is true."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    out = []
    for n, t, default in CATALOGUE:
        value = F.lit(None) if n not in raw.columns else (F.col(n) == "1") if t == "boolean" else F.expr(f"try_cast(`{n}` AS {t})")
        out.append(F.coalesce(value.cast(t), F.lit(default).cast(t)).alias(n))
    return raw.select(*out)


def read_star_csv(spark: SparkSession, path: str) -> DataFrame:
    """ra, dec, g, bp, rp by header name; rows with a field that doesn't parse are dropped, without a required column there are none."""
    raw = spark.read.csv(path, header=True)
    names = {"ra": "ra", "dec": "dec", "phot_g_mean_mag": "g", "phot_bp_mean_mag": "bp", "phot_rp_mean_mag": "rp"}
    if not set(names) <= set(raw.columns):
        return spark.createDataFrame([], "ra double, dec double, g double, bp double, rp double")
    return raw.select(*[F.expr(f"try_cast(`{n}` AS double)").alias(a) for n, a in names.items()]).dropna()
