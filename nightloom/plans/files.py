"""Queries that write files or streams of the derived tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.fixtures import view, with_views
from nightloom.functions import frames as ff
from nightloom.operators import pixels as P
from nightloom.operators.tiles import from_tiles
from nightloom.operators.triage import frame_ids
from nightloom.plans.frames import F2, KEYED, RANKED, keyed, ranked
from nightloom.sources import fits, fits_tiles, tables
from nightloom.sources.staging import staged, staging_dir
from nightloom.streaming import imports

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ("frames",)):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(*views, body=sql)
        return f

    return put


CATALOGUE_SQL = RANKED + """ SELECT frame_id, project_id, object, filter, exptime, night, second, stars, round(hfr, 6) AS hfr, CAST(trails AS BIGINT) AS trails, round(quality, 6) AS quality, rejected, has_wcs, CAST(bytes AS BIGINT) AS bytes FROM q"""


def _catalogue_columns(df):
    return df.select("frame_id", "project_id", "object", "filter", "exptime", "night", "second", "stars", F.round("hfr", 6).alias("hfr"), F.col("trails").cast("long").alias("trails"), F.round("quality", 6).alias("quality"), "rejected", "has_wcs", F.col("bytes").cast("long").alias("bytes"))


@query(CATALOGUE_SQL)
def sink_catalog(spark, sf_dir):
    path = staging_dir(spark, "catalogue")
    tables.write_catalogue(ranked(spark, sf_dir), path)
    return _catalogue_columns(spark.read.parquet(path).withColumn("night", F.col("night").cast("string")))


@query(CATALOGUE_SQL)
def src_catalog_tsv(spark, sf_dir):
    path = staging_dir(spark, "catalogue-tsv")
    tables.write_catalogue(ranked(spark, sf_dir), path, "tsv")
    return _catalogue_columns(tables.read_catalogue(spark, path))


@query(" SELECT round(ra, 6) AS ra, round(dec, 6) AS dec, round(g, 6) AS g FROM sky WHERE source_id % 50 <> 0", views=("sky",))
def src_gaia_csv(spark, sf_dir):
    path = staging_dir(spark, "stars-csv")
    sky = view(spark, sf_dir, "sky")
    broken = F.when(F.col("source_id") % 50 == 0, "null").otherwise(F.col("bp").cast("string"))
    sky.select("source_id", "dec", "ra", F.col("g").alias("phot_g_mean_mag"), broken.alias("phot_bp_mean_mag"), F.col("rp").alias("phot_rp_mean_mag")).write.option("header", True).csv(path)
    return tables.read_star_csv(spark, path).select(*[F.round(c, 6).alias(c) for c in ("ra", "dec", "g")])


def masters(spark, sf_dir):
    """One file a master: the mean of its frames in three channels. Returns the folder and the table of what was written."""
    folder = staging_dir(spark, "masters")
    rgb = P.debayer_half(view(spark, sf_dir, "pixels"), keys=("frame_id", "master_id"))
    mean = P.channels(rgb, keys=("master_id",)).groupBy("master_id", "channel", "y", "x").agg(F.avg("v").alias("v"))
    return folder, fits.write_masters(mean, folder, extra=[("OBJECT", "'NGC 7000'", "target"), ("STACKCNT", "50", "")], rows=3)


MASTER_SQL = """, rgb AS (SELECT master_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, frame_id, CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN x % 2 = 0 THEN 2 ELSE 1 END END AS channel, v FROM pixels),
 h AS (SELECT master_id, frame_id, channel, y, x, avg(v) AS v FROM rgb GROUP BY ALL), m AS (SELECT master_id, channel, y, x, avg(v) AS v FROM h GROUP BY 1, 2, 3, 4)"""


@query(MASTER_SQL + " SELECT master_id, CAST(2880 * 2 AS BIGINT) AS bytes FROM (SELECT DISTINCT master_id FROM m)", views=("pixels",))
def sink_fits_master(spark, sf_dir):
    return masters(spark, sf_dir)[1].select("master_id", "bytes")


@query(MASTER_SQL + " SELECT CAST(master_id AS VARCHAR) || '.fits' AS file, channel, y, x, round(v, 4) AS v FROM m", views=("pixels",))
def src_fits_pixels(spark, sf_dir):
    folder, _ = masters(spark, sf_dir)
    p = from_tiles(fits_tiles.read_tiles(spark, folder).where("error is null"), keys=("path", "channel"))
    return p.select(F.substring_index("path", "/", -1).alias("file"), "channel", "y", "x", F.round("v", 4).alias("v"))


@query(MASTER_SQL + " SELECT CAST(master_id AS VARCHAR) || '.fits' AS file, y, x, round(v, 4) AS v FROM m WHERE channel = 1 AND y BETWEEN 1 AND 2 AND x >= 2", views=("pixels",))
def src_fits_crop(spark, sf_dir):
    """A crop of one plane: tiles of two pixels a side, of which the reader takes those that the crop needs."""
    folder, _ = masters(spark, sf_dir)
    green = fits_tiles.read_tiles(spark, folder, side=2).where("channel = 1")
    return fits_tiles.crop(green, 1, 3, 2, 4, side=2).select(F.substring_index("path", "/", -1).alias("file"), "y", "x", F.round("v", 4).alias("v"))


@query(MASTER_SQL + " SELECT CAST(master_id AS VARCHAR) || '.fits' AS file, CAST(5760 AS BIGINT) AS bytes FROM (SELECT DISTINCT master_id FROM m)", views=("pixels",))
def src_fits_files(spark, sf_dir):
    folder, _ = masters(spark, sf_dir)
    return fits.files(spark, folder).select(F.substring_index("path", "/", -1).alias("file"), "bytes")


@query(MASTER_SQL + " SELECT CAST(master_id AS VARCHAR) || '.fits' AS file, row_number() OVER (ORDER BY master_id * 7919 % 1000 DESC, CAST(master_id AS VARCHAR) || '.fits') - 1 AS place FROM (SELECT DISTINCT master_id FROM m)", views=("pixels",))
def srt_masters(spark, sf_dir):
    """Masters newest first, after their files have been given times that follow from their numbers."""
    folder, rows = masters(spark, sf_dir)
    staged(fits.dated(rows.select("path", (1_700_000_000 + F.col("master_id") * 7919 % 1000 * 60).cast("double").alias("second"))), "dated")
    newest = fits.files(spark, folder).select((-F.unix_micros("modified")).alias("age"), "path")
    return frame_ids(newest, ["age", "path"], "place").select(F.substring_index("path", "/", -1).alias("file"), "place")


@query(MASTER_SQL + " SELECT CAST(master_id AS VARCHAR) || '.fits' AS file, 'NGC 7000' AS object, CAST(4 AS BIGINT) AS width, CAST(3 AS BIGINT) AS planes, CAST(50 AS BIGINT) AS stack_count FROM (SELECT DISTINCT master_id FROM m)", views=("pixels",))
def src_fits_headers(spark, sf_dir):
    folder, _ = masters(spark, sf_dir)
    spark.dataSource.register(fits.HeaderSource)
    f = fits.fields(fits.cards(spark.read.format("fits_headers").load(folder), "path", "header"), "path")
    return f.select(F.substring_index("path", "/", -1).alias("file"), "object", "width", F.col("planes").cast("long").alias("planes"), "stack_count")


@query(F2 + """, g AS (SELECT object, filter, night, count(*) AS n FROM f WHERE NOT rejected GROUP BY 1, 2, 3) SELECT object, filter, night, 'STACKCNT' AS key, CAST(n AS VARCHAR) AS value, 'frames combined' AS comment FROM g
 UNION ALL SELECT object, filter, night, 'HISTORY', '''sigma clip 3.0/3.0''', '' FROM g UNION ALL SELECT object, filter, night, 'OBJECT', '''' || object || '''', 'target' FROM g""")
def prj_provenance(spark, sf_dir):
    f = keyed(spark, sf_dir).where("not rejected").withColumns({"date_obs": ff.date_obs(F.col("ts")), "pixel_um": F.lit(2.9), "focal_mm": F.lit(160.0), "binning": F.lit(2)})
    g = f.withColumnsRenamed({"object": "o", "filter": "fl"}).withColumns({"object": F.col("o"), "filter": F.col("fl")})
    cards = fits.provenance(g, ["o", "fl", "night"])
    some = cards.where("key in ('STACKCNT', 'OBJECT') or value like '%sigma clip%'")
    return some.select(F.col("o").alias("object"), F.col("fl").alias("filter"), "night", "key", "value", "comment")


@query(" SELECT frame_id, key, value FROM (SELECT frame_id, 'OBJECT' AS key, 'O''' || o.o_orderpriority AS value FROM headers JOIN orders o ON o.o_orderkey = frame_id UNION ALL SELECT frame_id, 'ROWORDER', 'TOP-DOWN' FROM headers)", views=("headers",))
def prj_export_master(spark, sf_dir):
    c = fits.export_cards(fits.cards(view(spark, sf_dir, "headers"), "frame_id", "header"), bottom_up=False, keep_pedestal=False)
    return c.where("v_string is not null").select("frame_id", "key", F.col("v_string").alias("value"))


def stream(spark, sf_dir, name):
    """The frames as a stream of staged files, some of them twice. One trigger reads all that is there, so no order of files makes a frame late."""
    folder = staging_dir(spark, name)
    f = keyed(spark, sf_dir)
    again = f.where("frame_id % 10 = 0")
    f.unionByName(again).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    return folder, spark.readStream.schema(schema).parquet(f"{folder}/in")


@query(KEYED + " SELECT DISTINCT identity FROM k WHERE identity NOT IN (SELECT identity FROM k WHERE frame_id % 3 <> 0)")
def str_import_dedup(spark, sf_dir):
    """What a stream of arriving frames adds to a catalogue that holds two thirds of them."""
    folder, s = stream(spark, sf_dir, "import")
    held = keyed(spark, sf_dir).where("frame_id % 3 <> 0").withColumn("ts", F.col("ts").cast("timestamp"))
    catalogue = imports.Catalogue(f"{folder}/catalogue")
    catalogue.begin(held)
    catalogue.import_stream(s, f"{folder}/state", "60 days")
    return catalogue.read(spark).where(F.col("batch") >= 0).select("identity")


@query(MASTER_SQL + " SELECT CAST(master_id AS VARCHAR) || '.fits' AS file, 'NGC 7000' AS object, CAST(4 AS BIGINT) AS width, CAST(50 AS BIGINT) AS stack_count FROM (SELECT DISTINCT master_id FROM m) WHERE master_id % 3 = 0", views=("pixels",))
def str_import_headers(spark, sf_dir):
    """What a stream of the headers of a folder adds to a catalogue that holds two thirds of its files; the second run begins where the first one ended."""
    folder, rows = masters(spark, sf_dir)
    root = staging_dir(spark, "import-headers")
    spark.dataSource.register(fits.HeaderSource)
    headers = spark.readStream.format("fits_headers").load(folder)
    own = F.concat(F.lit(f"{folder}/"), F.col("master_id").cast("string"), F.lit(".fits"))
    catalogue = imports.Catalogue(f"{root}/catalogue")
    none = F.lit(None)
    catalogue.begin(rows.where("master_id % 3 <> 0").select(own.alias("identity"), none.cast("string").alias("object"), none.cast("long").alias("width"), none.cast("long").alias("stack_count")))
    for _ in range(2):
        catalogue.import_headers(headers, f"{root}/state")
    return catalogue.read(spark).where("batch >= 0").select(F.substring_index("identity", "/", -1).alias("file"), "object", "width", "stack_count")


SESSIONS = """, d AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE frame_id % 10 = 0), b AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 120000000 THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY project_id ORDER BY ts)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b), g AS (SELECT project_id, run, min(ts) AS lo, max(ts) AS hi, count(*) AS frames, sum(exptime) AS exposure FROM r GROUP BY 1, 2)"""


@query(F2 + SESSIONS + " SELECT project_id, count(*) AS sessions, CAST(sum(frames) AS BIGINT) AS frames, sum(exposure) AS exposure FROM g WHERE epoch_us(hi) + 120000000 < (SELECT max(epoch_us(ts)) FROM f) - 600000000 GROUP BY 1")
def str_sessions(spark, sf_dir):
    """Sessions that the watermark has closed, summed by project."""
    folder, s = stream(spark, sf_dir, "sessions")
    done = imports.drained(imports.live_sessions(s), folder)
    return done.groupBy("project_id").agg(F.count("*").alias("sessions"), F.sum("frames").alias("frames"), F.sum("exposure").alias("exposure"))


@query(F2 + """, d AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE frame_id % 10 = 0) SELECT night, count(*) AS frames, count(*) FILTER (WHERE NOT rejected) AS kept, sum(exptime) FILTER (WHERE NOT rejected) AS integration FROM d
 WHERE CAST(night AS DATE) + INTERVAL 36 HOUR <= (SELECT max(ts) FROM f) - INTERVAL 1 HOUR GROUP BY 1""")
def str_night_totals(spark, sf_dir):
    folder, s = stream(spark, sf_dir, "nights")
    return imports.drained(imports.night_totals(s), folder).withColumn("night", F.col("night").cast("string"))


@query(F2 + """, d AS (SELECT CAST(night AS DATE) + INTERVAL 36 HOUR <= (SELECT max(ts) FROM f) - INTERVAL 1 HOUR AS over, frame_id % 10 = 0 AS again FROM f), c AS (SELECT over, again, count(*) AS n FROM d GROUP BY ALL)
 SELECT CAST(sum(n) + sum(CASE WHEN again THEN n ELSE 0 END) AS BIGINT) AS sent, CAST(0 AS BIGINT) AS untimed, CAST(sum(CASE WHEN over THEN n ELSE 0 END) AS BIGINT) AS closed, CAST(sum(CASE WHEN over THEN 0 WHEN again THEN 2 * n ELSE n END) AS BIGINT) AS open,
 CAST(sum(CASE WHEN over AND again THEN n ELSE 0 END) AS BIGINT) AS late FROM c""")
def str_night_ledger(spark, sf_dir):
    """Where the frames of a stream went when a tenth of them come again after their nights are closed."""
    folder = staging_dir(spark, "ledger")
    f = keyed(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (f, f.where("frame_id % 10 = 0")):
        part.write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        _, went = imports.counted_night_totals(s, f"{folder}/nights-{folder[-8:]}")
    return went
