"""FITS pixels as tiles, read band by band, and a stream of the headers that arrive in a folder."""

from __future__ import annotations

import operator
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from nightloom.operators.tiles import SIDE, each_row
from nightloom.sources.fits import BLOCK, KINDS, PART, HeaderReader, _is_end, _is_image, _Part, _store, parse_header, read_header

SHARE = 64 << 20  # bytes of a file that one part reads
DEALS = 16  # parts of a subfolder

COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class _Share(InputPartition):
    """Files (path, k of n shares), or every n-th file of a folder from k on."""

    def __init__(self, files=(), folder=None, k=0, n=1):
        self.files, self.folder, self.k, self.n = files, folder, k, n


class TileReader(HeaderReader):
    """Tiles of the images below a folder. Files of the folder itself are cut into shares of SHARE bytes; a subfolder is listed by the tasks that read it.

    Comparisons of path, channel, ty and tx with constants are met before anything is read: a task reads the bands (rows ty * side and on, of a channel) that pass, each in one piece, and no other pixels.
    """

    def __init__(self, options):
        super().__init__(options)
        self.side = int(options.get("side", SIDE))
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            name, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
            if name not in ("path", "channel", "ty", "tx"):
                yield f
            elif type(f) in COMPARED and value is not None:
                self.tests.append((name, COMPARED[type(f)], value))
            elif isinstance(f, In):
                self.tests.append((name, _among, frozenset(f.value)))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, operator.is_not, None))
            else:
                yield f

    def passes(self, **known) -> bool:
        """Whether the filters on these columns hold; none does on null."""
        return all(known[n] is not None and test(known[n], v) for n, test, v in self.tests if n in known)

    def partitions(self):
        head, found = self._listed("", False)
        parts = []
        for x in sorted((x for x in found if _is_image(x)), key=lambda x: x.path):
            if self.passes(path=head + x.path):
                n = max(1, -(-x.size // SHARE))
                parts += [(x.size / n, (head + x.path, k, n)) for k in range(n)]
        out, held = [], SHARE
        for size, share in parts:  # small files go together
            if held + size > SHARE:
                out.append(_Share([]))
                held = 0
            out[-1].files.append(share)
            held += size
        folders = [x.path for x in found if x.type.name == "Directory" and not x.base_name.startswith(".")]
        return out + [_Share(folder=f, k=k, n=DEALS) for f in folders for k in range(DEALS)] or [_Share()]

    def read(self, partition):
        files = partition.files
        if partition.folder is not None:
            head, found = self._listed(partition.folder, True)
            files = [(p, 0, 1) for p in sorted(head + x.path for x in found if _is_image(x))[partition.k :: partition.n]]
        for path, k, n in files:
            if self.passes(path=path):
                yield from self.tiles(path, k, n)

    def tiles(self, path: str, k: int = 0, n: int = 1):
        """Rows of the bands of a file's k-th share of n. A file that can't be read is one row with its error, of its first share."""
        try:
            store, at = _store(path)
            with store.open_input_file(at) as f:
                image = Image(f)
                bands = [(c, t) for c in range(image.planes) for t in range(-(-image.height // self.side))]
                for c, t in bands[len(bands) * k // n : len(bands) * (k + 1) // n]:
                    across = [x for x in range(-(-image.width // self.side)) if self.passes(tx=x)]
                    if not across or not self.passes(channel=c, ty=t):
                        continue
                    rows = image.rows(c, t * self.side, min((t + 1) * self.side, image.height))
                    for x in across:
                        cut = np.ascontiguousarray(rows[:, x * self.side : (x + 1) * self.side])
                        yield path, c, t, x, *cut.shape, cut.tobytes(), None
        except (OSError, ValueError, KeyError) as e:
            if k == 0 and self.passes(channel=None, ty=None, tx=None):
                yield path, None, None, None, None, None, None, str(e)


def _among(value, values) -> bool:
    return value in values


class Image:
    """An open file's image: its size, and rows of a plane by byte range."""

    def __init__(self, file):
        head = b""
        while not (head and _is_end(head[-BLOCK:])):
            block = file.read(BLOCK)
            if not block:
                raise ValueError("no END card")
            head += block
        h, self.at = parse_header(head)
        axes = [int(h.get(f"NAXIS{k + 1}", 1)) for k in range(int(h.get("NAXIS", 0)))]
        if int(h.get("BITPIX", 0)) not in KINDS or len(axes) < 2:
            raise ValueError("no image")
        self.file, self.kind = file, np.dtype(KINDS[int(h["BITPIX"])])
        self.width, self.height, self.planes = axes[0], axes[1], int(np.prod(axes[2:])) if len(axes) > 2 else 1
        self.scale, self.zero = float(h.get("BSCALE", 1)), float(h.get("BZERO", 0))
        if file.size() < self.at + self.planes * self.height * self.width * self.kind.itemsize:
            raise ValueError("file ends within its pixels")

    def rows(self, plane: int, first: int, end: int) -> np.ndarray:
        line = self.width * self.kind.itemsize
        self.file.seek(self.at + (plane * self.height + first) * line)
        raw = np.frombuffer(self.file.read((end - first) * line), self.kind)
        return raw.reshape(end - first, self.width).astype(np.float64) * self.scale + self.zero


class TileSource(DataSource):
    """spark.read.format("fits_tiles").option("side", n).load(folder); see read_tiles."""

    @classmethod
    def name(cls):
        return "fits_tiles"

    def schema(self):
        return "path string, channel int, ty int, tx int, h int, w int, data binary, error string"

    def reader(self, schema):
        return TileReader(self.options)


def read_tiles(spark: SparkSession, folder: str, side: int = SIDE) -> DataFrame:
    """path, channel, ty, tx, h, w, data (as in tiles.py), error of the FITS images below a folder. An unreadable or cut file is one row with its error and nothing else.

    Filters on path, channel, ty and tx go to the reader; the session's switch for that is set here. Pixels that are NaN are places without a sample.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)
    return spark.read.format("fits_tiles").option("side", side).load(folder)


def crop(tiles: DataFrame, y0: int, y1: int, x0: int, x1: int, side: int = SIDE) -> DataFrame:
    """path, channel, y, x, v of the rows y0 to y1 - 1 and columns x0 to x1 - 1 of read_tiles, of which only these rows' bands are read; an empty range has no pixels."""

    def rows(r):
        data = np.frombuffer(r["data"]).reshape(r["h"], r["w"])
        top, left = r["ty"] * side, r["tx"] * side
        a, b = max(y0 - top, 0), max(x0 - left, 0)
        part = data[a : max(y1 - top, 0), b : max(x1 - left, 0)]
        y, x = np.nonzero(~np.isnan(part))
        return [(r["path"], r["channel"], *at) for at in zip((y + top + a).tolist(), (x + left + b).tolist(), part[y, x].tolist())]

    t, u = F.col("ty"), F.col("tx")
    near = tiles.where((t >= y0 // side) & (t <= (y1 - 1) // side) & (u >= x0 // side) & (u <= (x1 - 1) // side))
    return each_row(near.select("path", "channel", "ty", "tx", "h", "w", "data"), rows, "path string, channel int, y int, x int, v double")


class HeaderStreamReader(DataSourceStreamReader):
    """Headers of files as they arrive below a folder. An offset is a time: a batch has the files that changed after the last offset, up to the next one.

    The driver lists the folder itself alone, tasks list its subfolders. With `overlap` seconds, files are looked for that long before the last offset too: those that became visible late are found, and
    others come again, which a catalogue that merges by identity doesn't mind. Files younger than `settle` seconds are left to the next batch.
    """

    def __init__(self, options):
        self.batch = HeaderReader(options)
        self.settle, self.overlap = (int(1e6 * float(options.get(n, 0))) for n in ("settle", "overlap"))

    def initialOffset(self):
        return {"upto": 0}

    def latestOffset(self):
        return {"upto": time.time_ns() // 1000 - self.settle}

    def _arrived(self, found, after, upto, head):
        return sorted(head + x.path for x in found if _is_image(x) and after < x.mtime_ns // 1000 <= upto)

    def partitions(self, start, end):
        after, upto = start["upto"] - self.overlap, end["upto"]
        head, found = self.batch._listed("", False)
        paths = self._arrived(found, after, upto, head)
        parts = [_Arrivals(after, upto, paths=paths[k : k + PART]) for k in range(0, len(paths), PART)]
        return parts + [_Arrivals(after, upto, folder=x.path) for x in found if x.type.name == "Directory" and not x.base_name.startswith(".")]

    def read(self, partition):
        paths = partition.paths
        if partition.folder is not None:
            head, found = self.batch._listed(partition.folder, True)
            paths = self._arrived(found, partition.after, partition.upto, head)
        for path in paths:
            header = read_header(path)
            if header is not None:
                yield path, header


class _Arrivals(_Part):
    def __init__(self, after, upto, folder=None, paths=()):
        super().__init__(folder, paths)
        self.after, self.upto = after, upto
