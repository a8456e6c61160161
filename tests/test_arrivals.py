"""FITS tiles by byte range, headers as a stream, and frames that come too late for their night."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, StringContains

from nightloom.operators.tiles import from_tiles
from nightloom.sources import fits, fits_tiles
from nightloom.streaming import imports

RNG = np.random.default_rng(5)


def tmp():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def whole_numbers(image, bitpix, scale, zero):
    """A file of integers or doubles, with BSCALE and BZERO."""
    head = [("SIMPLE", "T"), ("BITPIX", str(bitpix)), ("NAXIS", "2"), ("NAXIS1", str(image.shape[1])), ("NAXIS2", str(image.shape[0])), ("BSCALE", str(scale)), ("BZERO", str(zero))]
    text = "".join(fits.card(k, v) for k, v in head) + "END".ljust(80)
    return text.ljust(2880).encode() + image.astype(fits.KINDS[bitpix]).tobytes()


@pytest.fixture(scope="module")
def folder():
    root = tmp()
    images = {f"{root}/a.fits": RNG.random((3, 21, 17)).astype(np.float32), f"{root}/night/deep/b.fit": RNG.random((1, 8, 9)).astype(np.float32)}
    for path, image in images.items():
        put(path, fits.image_bytes(image))
    for bitpix in (8, 16, 32, 64, -64):
        path, image = f"{root}/night/k{bitpix}.fits", RNG.integers(0, 100, (5, 6))
        put(path, whole_numbers(image, bitpix, 2, 32768))
        images[path] = image[None] * 2.0 + 32768
    data = fits.image_bytes(RNG.random((2, 30, 30)))
    put(f"{root}/cut.fits", data[:-2880])
    put(f"{root}/night/none.fits", b"")
    put(f"{root}/night/text.fits", b"x" * 6000)
    put(f"{root}/.hidden/c.fits", data)
    put(f"{root}/readme.txt", data)
    return root, images


def test_tiles_are_the_images(spark, folder):
    root, images = folder
    t = fits_tiles.read_tiles(spark, root, side=8)
    got = {}
    for r in from_tiles(t.where("error is null"), 8, ("path", "channel")).collect():
        got.setdefault(r["path"], {})[r["channel"], r["y"], r["x"]] = r["v"]
    assert {p: len(v) for p, v in got.items()} == {p: i.size for p, i in images.items()}
    assert all(got[p][at] == v for p, i in images.items() for at, v in np.ndenumerate(i.astype(float)))
    bad = {os.path.basename(r["path"]): r["error"] for r in t.where("error is not null").collect()}
    assert set(bad) == {"cut.fits", "none.fits", "text.fits"} and all(bad.values())
    assert t.where("channel >= 0").count() == t.where("error is null").count()  # an error has no channel


def test_filters_are_met_by_the_reader(spark, folder):
    root, images = folder
    t = fits_tiles.read_tiles(spark, root, side=8)
    some = t.where("channel = 1 and ty >= 1 and tx in (0, 2) and path like '%a.fits'")
    left = [line for line in some._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter " in line]
    assert len(left) == 1 and "path#" in left[0] and not any(f"{c}#" in left[0] for c in ("channel", "ty", "tx"))  # what Spark is left with
    assert {(r["ty"], r["tx"], r["h"], r["w"]) for r in some.collect()} == {(1, 0, 8, 8), (1, 2, 8, 1), (2, 0, 5, 8), (2, 2, 5, 1)}
    a = images[f"{root}/a.fits"]
    part = fits_tiles.crop(t.where(F.col("path") == f"{root}/a.fits"), 6, 18, 3, 17, side=8).collect()
    assert {(r["channel"], r["y"], r["x"]): r["v"] for r in part} == {(c, y, x): float(a[c, y, x]) for c in range(3) for y in range(6, 18) for x in range(3, 17)}
    assert fits_tiles.crop(t, 5, 5, 0, 9, side=8).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    empty = tmp()
    assert fits_tiles.read_tiles(spark, empty).count() == 0


def test_a_crop_reads_its_bytes_only(folder, monkeypatch):
    root, _ = folder
    big = f"{tmp()}/big.fits"
    put(big, fits.image_bytes(np.zeros((3, 640, 500))))
    read = []
    store = fits._store

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            read.append(n)
            return self.file.read(n)

        def __getattr__(self, name):
            return getattr(self.file, name)

    class Store:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, at):
            return Counted(self.inner.open_input_file(at))

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(fits_tiles, "_store", lambda p: (Store(store(p)[0]), store(p)[1]))
    reader = fits_tiles.TileReader({"path": os.path.dirname(big), "side": "64"})
    other = StringContains(("path",), "big")
    assert list(reader.pushFilters([IsNotNull(("channel",)), EqualTo(("channel",), 2), GreaterThanOrEqual(("ty",), 3), LessThan(("ty",), 5), In(("tx",), (0, 1)), other])) == [other]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in rows] == [(2, t, x, 64, 64) for t in (3, 4) for x in (0, 1)]
    assert sum(read) == 2880 + 2 * 64 * 500 * 4
    # Shares of a large file have each band once.
    monkeypatch.setattr(fits_tiles, "SHARE", 200_000)
    reader = fits_tiles.TileReader({"path": os.path.dirname(big), "side": "64"})
    parts = reader.partitions()
    assert len(parts) > 10
    assert sorted(r[1:4] for p in parts for r in reader.read(p)) == [(c, t, x) for c in range(3) for t in range(10) for x in range(8)]


def test_headers_stream_into_a_catalogue(spark):
    root = tmp()
    spark.dataSource.register(fits.HeaderSource)
    catalogue = imports.Catalogue(f"{root}/catalogue")
    catalogue.begin(spark.createDataFrame([(f"{root}/in/held.fits", "held")], "identity string, object string"))
    file = lambda at, name: put(f"{root}/in/{at}", fits.image_bytes(np.zeros((1, 2, 3)), [("OBJECT", f"'{name}'", "")]))

    def run(state="state", **options):
        s = spark.readStream.format("fits_headers").options(**options).load(f"{root}/in")
        catalogue.import_headers(s, f"{root}/{state}")
        return sorted((r["object"], r["batch"]) for r in catalogue.read(spark).where("batch >= 0").collect())

    file("held.fits", "held")
    file("a.fits", "a")
    file("night/deep/b.fit", "b")
    file("night/.b.txt", "no image")
    first = run()
    assert [o for o, _ in first] == ["a", "b"]
    assert run() == first
    file("c.fits", "c")
    file("a.fits", "a changed")
    file("night2/d.fits", "d")
    second = run()
    assert [o for o, _ in second] == ["a", "b", "c", "d"] and second[:2] == first
    # What became visible late, with an old time, is found by the overlap.
    file("night/late.fits", "late")
    os.utime(f"{root}/in/night/late.fits", (os.path.getmtime(f"{root}/in/c.fits") - 5,) * 2)
    assert [o for o, _ in run()] == ["a", "b", "c", "d"]
    assert [o for o, _ in run(overlap=60)] == ["a", "b", "c", "d", "late"]
    assert [o for o, _ in run("new state", settle=3600)] == ["a", "b", "c", "d", "late"]


def test_kept_and_late_frames_are_all_that_were_sent(spark):
    root = tmp()
    schema = "ts timestamp, rejected boolean, exptime double"
    noon = dt.datetime(2024, 5, 1, 12)

    def send(hours):
        spark.createDataFrame([(None if h is None else noon + dt.timedelta(hours=h), h is not None and int(h) % 5 == 0, 30.0) for h in hours], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        s = spark.readStream.schema(schema).parquet(f"{root}/in")
        totals, went = imports.counted_night_totals(s, f"{root}/nights")
        nights = {str(r["night"]): (r["frames"], r["kept"], r["integration"]) for r in totals.collect()}
        return nights, went.collect()[0].asDict()

    nights, went = send([1, 2, 3, 4, 5, None])
    assert nights == {} and went == {"sent": 6, "untimed": 1, "closed": 0, "open": 5, "late": 0}
    nights, went = send([6, 30, 31, 50])  # the first night is closed
    assert nights == {"2024-05-01": (6, 5, 150.0), "2024-05-02": (2, 1, 30.0)} and went == {"sent": 10, "untimed": 1, "closed": 8, "open": 1, "late": 0}
    nights, went = send([7, 8, 9, 32, 51, None])  # four come too late, three of one night in one task
    assert len(nights) == 2 and went == {"sent": 16, "untimed": 2, "closed": 8, "open": 2, "late": 4}
