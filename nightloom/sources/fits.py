"""FITS: header cards as rows, a header-only reader, pixels, and masters written back."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from nightloom.operators.tiles import each_row
from nightloom.sources.staging import staged

CARD, BLOCK = 80, 2880
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, modified of all FITS files below a folder, in the order of paths; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return found.where(F.lower("path").rlike(r"\.(fit|fits|fts)$")).orderBy("path")


def _card_rows(df: DataFrame, key: str, header: str) -> DataFrame:
    """key, seq, card up to END."""
    n = F.ceil(F.length(header) / CARD).cast("int")
    split = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(header), i * CARD + 1, F.lit(CARD)))
    end = F.coalesce(F.array_position(F.transform("cards", lambda c: F.rtrim(c) == "END"), True), F.lit(0))
    cut = df.select(F.col(key), split.alias("cards"))
    kept = F.when(end > 0, F.slice("cards", F.lit(1), (end - 1).cast("int"))).otherwise(F.col("cards"))
    return cut.select(F.col(key), F.posexplode(kept).alias("seq", "card"))


def cards(df: DataFrame, key: str, header: str) -> DataFrame:
    """key, seq, key name, vtype and typed values: quoted strings with '' for a quote, T or F, whole numbers before real ones (D exponents too). What has no value or none that parses is left out."""
    c = _card_rows(df, key, header).where(F.substring("card", 9, 1) == "=").withColumn("name", F.trim(F.substring("card", 1, 8)))
    c = c.where(~F.col("name").isin("", "COMMENT", "HISTORY")).withColumn("body", F.ltrim(F.expr("substring(card, 10)")))
    quoted = F.col("body").startswith("'")
    text = F.rtrim(F.replace(F.regexp_extract("body", r"^'((?:[^']|'')*)", 1), F.lit("''"), F.lit("'")))
    bare = F.trim(F.substring_index("body", "/", 1))
    whole = bare.rlike(r"^[+-]?[0-9]+$")
    real = F.expr("try_cast(translate(trim(substring_index(body, '/', 1)), 'Dd', 'EE') AS double)")
    c = c.withColumns(
        {
            "v_bool": F.when(~quoted & bare.isin("T", "F"), bare == "T"),
            "v_long": F.when(~quoted & whole, F.expr("try_cast(trim(substring_index(body, '/', 1)) AS bigint)")),
            "v_double": F.when(~quoted & ~whole & ~bare.isin("T", "F"), real),
            "v_string": F.when(quoted, text),
        }
    )
    vtype = F.when(quoted, "string").when(F.col("v_bool").isNotNull(), "bool").when(F.col("v_long").isNotNull(), "long").when(F.col("v_double").isNotNull(), "double")
    return c.select(key, "seq", F.col("name").alias("key"), vtype.alias("vtype"), "v_bool", "v_long", "v_double", "v_string").where("vtype is not null")


def header_text(df: DataFrame, key: str, header: str) -> DataFrame:
    """key, text: cards that aren't blank, one a line, trailing blanks cut; 16 blocks at most."""
    c = _card_rows(df, key, header).where((F.trim("card") != "") & (F.col("seq") < 16 * BLOCK // CARD))
    lines = F.array_sort(F.collect_list(F.struct("seq", F.rtrim("card").alias("line"))))
    return c.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def lookup(name: str, column: str) -> Column:
    """Aggregate: the first card of a name that has a value of a type."""
    return F.min_by(column, F.when((F.col("key") == name) & F.col(column).isNotNull(), F.col("seq")))


def fields(c: DataFrame, key: str) -> DataFrame:
    """key and the scan's typed fields with their defaults."""
    number = lambda name: F.coalesce(lookup(name, "v_double"), lookup(name, "v_long").cast("double"))
    return c.groupBy(key).agg(
        F.trim(F.coalesce(lookup("OBJECT", "v_string"), F.lit(""))).alias("object"),
        F.trim(F.coalesce(lookup("FILTER", "v_string"), F.lit(""))).alias("filter"),
        F.coalesce(number("EXPTIME"), F.lit(0.0)).alias("exptime"),
        F.coalesce(lookup("DATE-OBS", "v_string"), F.lit("")).alias("date_obs"),
        F.coalesce(lookup("NAXIS1", "v_long"), F.lit(0)).alias("width"),
        F.coalesce(lookup("NAXIS2", "v_long"), F.lit(0)).alias("height"),
        F.when(F.coalesce(lookup("NAXIS", "v_long"), F.lit(0)) >= 3, F.coalesce(lookup("NAXIS3", "v_long"), F.lit(1))).otherwise(1).alias("planes"),
        lookup("STACKCNT", "v_long").alias("stack_count"),
        number("CDELT").alias("cdelt"),
    )


def _is_end(block: bytes) -> bool:
    return any(block[k : k + CARD].rstrip() == b"END" for k in range(0, len(block), CARD))


def _store(path: str):
    """(file system, path in it) of a local path or a URI that Arrow reaches: file, s3, gs, hdfs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def read_header(path: str) -> str | None:
    """A file's blocks up to the one with END, as text; pixels are not read. None if it can't be opened."""
    store, at = _store(path)
    text = b""
    try:
        with store.open_input_file(at) as f:
            while block := f.read(BLOCK):
                text += block
                if _is_end(block):
                    break
    except OSError:
        return None
    return text.decode("ascii", "replace")


def headers(paths: DataFrame) -> DataFrame:
    """path, header of a table of paths, read where its rows are; files that can't be opened are left out."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(p, h) for p in batch.column(0).to_pylist() if p is not None and (h := read_header(p)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["path", "header"])

    return paths.select("path").mapInArrow(read, "path string, header string")


def _is_image(x) -> bool:
    return x.is_file and x.extension.lower() in ("fit", "fits", "fts")


def dated(files: DataFrame) -> DataFrame:
    """path of files(path, second) on a mounted file system, whose modification times become those seconds."""

    def one(r):
        store, at = _store(r["path"])
        if store.type_name == "local":
            os.utime(at, (r["second"], r["second"]))
        yield (r["path"],)

    return each_row(files.select("path", "second"), one, "path string")


class _Part(InputPartition):
    def __init__(self, folder=None, paths=()):
        self.folder, self.paths = folder, paths


PART = 1000  # paths


class HeaderReader(DataSourceReader):
    """Headers of the FITS files below a folder. The driver lists the folder alone: each of its subfolders is a part, listed by the task that reads it, and its own files are parts of PART paths."""

    def __init__(self, options):
        self.folder = options["path"]

    def _listed(self, at: str, recursive: bool):
        from pyarrow import fs

        store, root = _store(self.folder)
        head = self.folder[: len(self.folder) - len(root)] if self.folder.endswith(root) else ""
        return head, store.get_file_info(fs.FileSelector(at or root, recursive=recursive))

    def partitions(self):
        head, found = self._listed("", False)
        paths = sorted(head + x.path for x in found if _is_image(x))
        parts = [_Part(paths=paths[k : k + PART]) for k in range(0, len(paths), PART)]
        return parts + [_Part(folder=x.path) for x in found if x.type.name == "Directory" and not x.base_name.startswith(".")] or [_Part()]

    def read(self, partition):
        paths = partition.paths
        if partition.folder is not None:
            head, found = self._listed(partition.folder, True)
            paths = sorted(head + x.path for x in found if _is_image(x))
        for path in paths:
            header = read_header(path)
            if header is not None:
                yield path, header


class HeaderSource(DataSource):
    """spark.read.format("fits_headers").load(folder), and spark.readStream for those that arrive (options settle, overlap)."""

    @classmethod
    def name(cls):
        return "fits_headers"

    def schema(self):
        return "path string, header string"

    def reader(self, schema):
        return HeaderReader(self.options)

    def streamReader(self, schema):
        from nightloom.sources.fits_tiles import HeaderStreamReader

        return HeaderStreamReader(self.options)


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """Bare values by key (first match) and where the data begin."""
    found: dict[str, str] = {}
    for k in range(0, len(data), CARD):
        card = data[k : k + CARD].decode("ascii", "replace")
        if card.rstrip() == "END":
            return found, -(-(k + CARD) // BLOCK) * BLOCK
        if card[8:9] == "=":
            found.setdefault(card[:8].strip(), card[9:].split("/")[0].strip())
    raise ValueError("no END card")


def read_image(data: bytes) -> np.ndarray:
    """(planes, height, width) as float64, scaled by BSCALE and BZERO."""
    h, at = parse_header(data)
    axes = [int(h.get(f"NAXIS{k + 1}", 1)) for k in range(int(h.get("NAXIS", 0)))]
    if int(h.get("BITPIX", 0)) not in KINDS or len(axes) < 2:
        raise ValueError("no image")
    shape = (int(np.prod(axes[2:])) if len(axes) > 2 else 1, axes[1], axes[0])
    values = np.frombuffer(data, KINDS[int(h["BITPIX"])], int(np.prod(shape)), at).reshape(shape).astype(np.float64)
    return values * float(h.get("BSCALE", 1)) + float(h.get("BZERO", 0))


def card(key: str, value: str, comment: str = "") -> str:
    return f"{key:<8}= {value:>20}{' / ' + comment if comment else ''}"[:CARD].ljust(CARD)


def image_header(planes: int, height: int, width: int, extra: list[tuple[str, str, str]] = ()) -> bytes:
    """Header blocks of an image of 32-bit floats."""
    head = [card("SIMPLE", "T"), card("BITPIX", "-32"), card("NAXIS", "3" if planes > 1 else "2"), card("NAXIS1", str(width)), card("NAXIS2", str(height))]
    head += [card("NAXIS3", str(planes))] * (planes > 1) + [card(*e) for e in extra] + ["END".ljust(CARD)]
    text = "".join(head).encode("ascii", "replace")
    return text.ljust(-(-len(text) // BLOCK) * BLOCK)


def image_bytes(image: np.ndarray, extra: list[tuple[str, str, str]] = ()) -> bytes:
    """A FITS file of 32-bit floats, planes one after another."""
    data = image.astype(">f4").tobytes()
    return image_header(*image.shape, extra) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


STRUCTURAL = ["SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "BSCALE", "BZERO", "END"]


def export_cards(c: DataFrame, bottom_up: bool, keep_pedestal: bool) -> DataFrame:
    """Cards of a re-written master: structural ones go, ROWORDER is set, BIAS goes unless kept."""
    gone = [*STRUCTURAL, "ROWORDER", *([] if keep_pedestal else ["BIAS"])]
    order = c.select(c.columns[0]).distinct().select(c.columns[0], F.lit(1 << 20).alias("seq"), F.lit("ROWORDER").alias("key"), F.lit("string").alias("vtype"), F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("long").alias("v_long"), F.lit(None).cast("double").alias("v_double"), F.lit("BOTTOM-UP" if bottom_up else "TOP-DOWN").alias("v_string"))
    return c.where(~F.col("key").isin(*gone)).unionByName(order)


def provenance(frames: DataFrame, by: list[str], drizzle: int = 0, full_resolution: bool = True, pixfrac: float = 0.7, low: float = 3.0, high: float = 3.0, gradient: bool = True) -> DataFrame:
    """by, seq, key, value, comment: the cards that tell how a master came about, from its accepted frames(object, filter, date_obs, exptime, pixel_um, focal_mm, binning)."""
    path = f"'drizzle {drizzle}x, pixfrac {pixfrac:.2f}'" if drizzle > 1 else "'full-res GRBG bilinear demosaic'" if full_resolution else "'half-res GRBG bin, no interpolation'"
    first = lambda c: F.min_by(c, F.col("date_obs"))
    g = frames.groupBy(*by).agg(F.count("*").alias("n"), *[first(c).alias(c) for c in ("object", "filter", "exptime", "pixel_um", "focal_mm", "binning")], F.min("date_obs").alias("date_obs"))
    quoted = lambda c: F.concat(F.lit("'"), F.trim(c), F.lit("'"))
    made = [("CREATOR", F.lit("'nightloom'"), ""), ("STACKCNT", F.col("n").cast("string"), "frames combined"), ("ROWORDER", F.lit("'BOTTOM-UP'"), "FITS convention"), ("OBJECT", quoted("object"), "target"), ("FILTER", quoted("filter"), ""), ("DATE-OBS", quoted("date_obs"), "first frame")]
    pitch = F.col("pixel_um") * F.col("binning")
    made += [("XPIXSZ", F.format_string("%.4f", pitch), "um, after binning"), ("YPIXSZ", F.format_string("%.4f", pitch), "um, after binning"), ("SCALE", F.when(F.col("focal_mm") > 0, F.format_string("%.4f", 206.265 * pitch / F.col("focal_mm"))), "arcsec/pixel")]
    made += [("XBINNING", F.col("binning").cast("long").cast("string"), ""), ("EXPTIME", F.col("exptime").cast("string"), "per frame, s"), ("LIVETIME", (F.col("exptime") * F.col("n")).cast("string"), "total, s")]
    made += [("HISTORY", F.lit(path), ""), ("HISTORY", F.lit("'star-based similarity registration'"), ""), ("HISTORY", F.lit(f"'sigma clip {low:.1f}/{high:.1f}'"), "")] + [("HISTORY", F.lit("'background gradient removed'"), "")] * gradient
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(c).alias("comment")) for k, v, c in made])
    return g.select(*by, F.posexplode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("seq", "c")).select(*by, "seq", "c.key", "c.value", "c.comment")


@dataclass
class _Written(WriterCommitMessage):
    token: str


class PartsWriter(DataSourceWriter):
    """Bands (master, channel, band, data) as one file each in a folder of the task's own. Commit makes the lists of tasks that count visible; abort removes all that the job has written."""

    def __init__(self, options):
        self.run = options["path"]

    def write(self, iterator):
        store, at = _store(self.run)
        token = uuid.uuid4().hex  # of this attempt
        store.create_dir(f"{at}/{token}")
        lines = []
        for n, row in enumerate(iterator):
            with store.open_output_stream(f"{at}/{token}/{n}") as f:
                f.write(bytes(row["data"]))
            lines.append(json.dumps({"master": row["master"], "channel": row["channel"], "band": row["band"], "file": f"{token}/{n}"}))
        with store.open_output_stream(f"{at}/{token}/list") as f:
            f.write("\n".join(lines).encode())
        return _Written(token)

    def commit(self, messages):
        store, at = _store(self.run)
        store.create_dir(f"{at}/lists")
        for m in messages:
            store.move(f"{at}/{m.token}/list", f"{at}/lists/{m.token}.json")

    def abort(self, messages):
        store, at = _store(self.run)
        if store.get_file_info(at).type.name == "Directory":
            store.delete_dir(at)


class PartsSink(DataSource):
    """df.write.format("fits_parts").mode("append").save(folder)."""

    @classmethod
    def name(cls):
        return "fits_parts"

    def writer(self, schema, overwrite):
        return PartsWriter(self.options)


BAND = 64  # rows


def _bands(planes: DataFrame, by: str, rows: int) -> DataFrame:
    """master (the key as text), channel, band, data: the pixels of so many rows as big-endian floats, rows full and places without a pixel 0."""

    def one(r):
        cells = r["cells"]
        data = np.zeros((min(rows, r["height"] - r["band"] * rows), r["width"]), dtype=">f4")
        data[cells["y"] - r["band"] * rows, cells["x"]] = cells["v"]
        yield r["master"], r["channel"], r["band"], data.tobytes()

    cells = planes.groupBy(F.col(by).cast("string").alias("master"), F.col("channel").cast("int").alias("channel"), F.floor(F.col("y") / rows).cast("int").alias("band")).agg(F.collect_list(F.struct("y", "x", "v")).alias("cells"))
    return each_row(cells.join(_sizes(planes, by).drop(by), "master"), one, "master string, channel int, band int, data binary")


def _sizes(planes: DataFrame, by: str) -> DataFrame:
    most = lambda c, n: (F.max(c) + 1).cast("int").alias(n)
    return planes.groupBy(by).agg(most("channel", "planes"), most("y", "height"), most("x", "width")).withColumn("master", F.col(by).cast("string"))


def write_masters(planes: DataFrame, folder: str, by: str = "master_id", extra: list[tuple[str, str, str]] = (), rows: int = BAND) -> DataFrame:
    """by, path, bytes: each master's pixels(by, channel, y, x, v) as one FITS file in a folder of a store that Arrow reaches.

    Tasks write bands of rows, each a part of its own; once all are committed, the parts of a master are copied one after another behind its header. So a task holds a band, never a master. A file
    appears whole under its name or not at all: if a task fails for good, the parts go and no file is made.
    """
    spark = planes.sparkSession
    spark.dataSource.register(PartsSink)
    run = f"{folder.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    bands = _bands(planes, by, rows)
    bands.write.format("fits_parts").mode("append").save(run)
    parts = spark.read.schema("master string, channel int, band int, file string").json(f"{run}/lists")
    parts = parts.groupBy("master").agg(F.collect_list(F.struct("channel", "band", "file")).alias("parts"))

    def joined(r):
        store, at = _store(run)
        head = image_header(r["planes"], r["height"], r["width"], extra)
        files = {(int(c), int(b)): f for c, b, f in zip(r["parts"]["channel"], r["parts"]["band"], r["parts"]["file"])}
        goal, size = f"{at.rsplit('/', 1)[0]}/{r['master']}.fits", len(head)
        name = f"{at}/whole-{uuid.uuid4().hex}"
        with store.open_output_stream(name) as out:
            out.write(head)
            for c in range(r["planes"]):
                for b in range(-(-r["height"] // rows)):
                    n = 4 * r["width"] * min(rows, r["height"] - b * rows)
                    if (c, b) in files:
                        with store.open_input_stream(f"{at}/{files[c, b]}") as part:
                            out.write(part.read())
                    else:
                        out.write(bytes(n))
                    size += n
            out.write(bytes(-size % BLOCK))
        store.move(name, goal)
        yield r[by], f"{folder.rstrip('/')}/{r['master']}.fits", size + -size % BLOCK

    kind = planes.schema[by].dataType.simpleString()
    made = staged(each_row(_sizes(planes, by).join(parts, "master"), joined, f"{by} {kind}, path string, bytes long"), "masters")
    store, at = _store(run)
    store.delete_dir(at)
    return made
