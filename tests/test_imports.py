"""Streams of arriving frames into a catalogue, and headers of a folder of folders."""

import datetime as dt
import os
import tempfile

import numpy as np

from nightloom.sources import fits
from nightloom.streaming.imports import Catalogue

SCHEMA = "identity string, ts timestamp, n int"
DAY = dt.datetime(2024, 5, 1)


def tmp():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_old_repeats_and_replays_add_nothing(spark):
    root = tmp()
    catalogue = Catalogue(f"{root}/catalogue")
    catalogue.begin(spark.createDataFrame([("old", DAY - dt.timedelta(days=400), 0)], SCHEMA))

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        catalogue.import_stream(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), f"{root}/state", "10 minutes")  # begins where the last one ended

    names = lambda: sorted(r["identity"] for r in catalogue.read(spark).collect())
    arrive([("a", DAY, 1), ("a", DAY, 2), ("b", DAY, 3), ("old", DAY, 4), ("", DAY, 5)])
    assert names() == ["", "a", "b", "old"]
    arrive([("c", DAY + dt.timedelta(days=9), 6)])
    # Days after the watermark has left them behind, and again in a later run.
    arrive([("a", DAY + dt.timedelta(days=9), 7), ("b", DAY + dt.timedelta(days=10), 8), ("d", DAY + dt.timedelta(days=10), 9)])
    assert names() == ["", "a", "b", "c", "d", "old"]
    batches = {r["batch"] for r in catalogue.read(spark).select("batch").distinct().collect()}
    last = catalogue.read(spark).where(f"batch = {max(batches)}").drop("batch")
    again = spark.createDataFrame([tuple(r) for r in last.select("identity", "ts", "n").collect()] + [("a", DAY, 1)], SCHEMA)
    catalogue.merge(again, max(batches))
    assert names() == ["", "a", "b", "c", "d", "old"]


def test_headers_of_many_folders(spark):
    root = tmp()
    for n, sub in enumerate(["", "night1", "night2/deep", ".hidden"]):
        os.makedirs(f"{root}/{sub}", exist_ok=True)
        for k in range(3):
            with open(f"{root}/{sub}/f{n}{k}.{'FITS' if k else 'fit'}", "wb") as f:
                f.write(fits.image_bytes(np.zeros((1, 2, 3)), [("OBJECT", f"'o{n}{k}'", "")]))
    open(f"{root}/night1/readme.txt", "w").close()
    spark.dataSource.register(fits.HeaderSource)
    df = spark.read.format("fits_headers").load(root)
    got = {r["object"] for r in fits.fields(fits.cards(df, "path", "header"), "path").collect()}
    assert got == {f"o{n}{k}" for n in range(3) for k in range(3)}
    assert df.rdd.getNumPartitions() == 3
