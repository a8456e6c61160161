"""Packing by shortest-pack-first over the histogram of lengths, without padding.

Documents become pieces: full ones, which are sequences of their own, and a tail of fewer tokens. Packs alike in what is left in them are one pattern with a count.
Lengths are placed longest first, each into the packs with the most room (the shortest ones), whole patterns at a time; so what is worked on is the histogram, of at most as many rows as a
sequence has tokens, whatever the corpus. The pieces of a length have ranks, and each step of the placement says which ranks go to which packs: joined back, that
places all documents.

The room that packs have left is filled by tails that were kept out of the histogram: those of a share of the documents by hash, the smallest of a few
shares that suffices. They are laid end to end and cut where the room of a pack ends; what then remains becomes full sequences, and its end sequences whose lengths are the powers of
two of its size, which are not padded either.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm.common import map_lists, saved
from nightloom.llm.packing import _encoder

END = 1  # the id that closes every document
SHARES = 10  # of hash shares 1 / 1024, 1 / 512, ..., 1


def shortest_pack_first(sizes: dict[int, int], room: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int, int]], int]:
    """Packs of pieces given as length -> number: patterns (room left, first pack, packs), placements (length, first rank, f, packs, first pack, offset), and the number of packs.

    A placement puts f pieces of consecutive ranks side by side from offset on into each of its packs. f is more than 1 where the pieces of a length outnumber the packs that hold one.
    """
    patterns: list[tuple[int, int, int]] = []  # a heap of (-room left, first pack, packs)
    placements, packs = [], 0
    for length in sorted(sizes, reverse=True):
        first, left = 0, sizes[length]
        fit = sum(n for r, _, n in patterns if -r >= length)
        while left and patterns and -patterns[0][0] >= length:
            r, base, n = heapq.heappop(patterns)
            f = min(-r // length, max(1, left // fit))
            n, rest = min(n, left // f), n - min(n, left // f)
            placements.append((length, first, f, n, base, room + r))
            first, left = first + f * n, left - f * n
            if rest:
                heapq.heappush(patterns, (r, base + n, rest))
            if -r > f * length:
                heapq.heappush(patterns, (r + f * length, base, n))
        f = room // length
        for f, n in ((f, left // f), (left % f, 1)):  # new packs
            if f * n:
                placements.append((length, first, f, n, packs, 0))
                first, packs = first + f * n, packs + n
                if room > f * length:
                    heapq.heappush(patterns, (f * length - room, packs - n, n))
    return sorted((-r, base, n) for r, base, n in patterns), placements, packs


class Gaps:
    """A line of gaps in runs of equal ones: what packs have left, then full sequences, then powers of two, so that `tokens` fill it."""

    def __init__(self, patterns: list[tuple[int, int, int]], packs: int, room: int, tokens: int):
        runs = [(r, n, base, room - r) for r, base, n in reversed(patterns)]
        rest = tokens - sum(r * n for r, n, _, _ in runs)
        ends = [(room, rest // room), *((1 << b, rest % room >> b & 1) for b in range(room.bit_length() - 1, -1, -1))]
        for size, n in ends:
            if n:
                runs.append((size, n, packs, 0))
                packs += n
        self.size, self.n, self.base, self.offset = np.array(runs, dtype=np.int64).reshape(-1, 4).T
        self.start = np.cumsum(self.size * self.n) - self.size * self.n
        self.packs = packs

    def cut(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """The tokens from at on: (start, length, pack, offset in it), start counted from at."""
        out, done = [], 0
        run = int(np.searchsorted(self.start, at, side="right")) - 1
        while done < length:
            inside = at + done - int(self.start[run])
            k, used = divmod(inside, int(self.size[run]))
            if k >= self.n[run]:
                run += 1
                continue
            some = min(length - done, int(self.size[run]) - used)
            out.append((done, some, int(self.base[run]) + k, int(self.offset[run]) + used))
            done += some
        return out


def _ranked(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """rows with `place`: the sum of size over the rows before it, of equal `by`. Summed up in cells, as many as the root of all rows, so that no task sorts a whole group."""
    cells = max(1, math.isqrt(rows.count()))
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    sums = dealt.groupBy(*by, "cell").agg(F.sum(size).alias("sum"))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = saved(sums.select(*by, "cell", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before")), "cells")
    inside = F.sum(size).over(Window.partitionBy(*by, "cell").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return dealt.withColumn("inside", inside).join(sums, [*by, "cell"]).withColumn("place", F.col("before") + F.col("inside")).drop("before", "inside", "cell")


def tail_pieces(docs: DataFrame, room: int, key: str, text: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens of full pieces and tails; tails with their ids and the hash share from which on they are kept out."""

    def cut(b):
        encoder, rows = _encoder(vocabulary), []
        for k, t, share in zip(b["k"], b["t"], b["share"], strict=True):
            ids = (encoder.ids(t) if t else b"") + END.to_bytes(4, "little")
            n = len(ids) // 4
            for start in range(0, n, room):
                piece = ids[4 * start : 4 * (start + room)]
                tail = len(piece) < 4 * room
                rows.append((k, start, len(piece) // 4, zlib.crc32(piece), n, share if tail else None, piece if tail else None))
        return rows

    kind = docs.schema[key].dataType.simpleString()
    u = F.pmod(F.xxhash64(F.col(key), F.col(text).cast("string")), F.lit(1 << SHARES))
    share = F.when(u == 0, 0).otherwise(F.length(F.bin(u)))  # 0 for one of 1024, at most 1 for two of 1024, ...
    made = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), share.alias("share"))
    return map_lists(made, cut, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, share int, ids binary")


COLUMNS = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_by_histogram(docs: DataFrame, room: int = 2048, key: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset for the pieces of every row of docs; room is a power of two.

    Every sequence has `room` tokens, but for those of the powers of two of what remains at the end, one of each. Null or empty text is the closing id alone. Null keys stay null; repeated
    rows are packed each. Other columns are not carried. An empty table gives an empty one.
    """
    pieces = saved(tail_pieces(docs, room, key, text, vocabulary).withColumn("row", F.monotonically_increasing_id()), "histogram-pieces")
    tails = pieces.where("ids is not null")
    counts = tails.groupBy("length", "share").agg(F.count("*").alias("n")).collect()  # lengths * shares at most, whatever the corpus
    for out in range(-1, SHARES + 1):  # shares kept out of the histogram: the fewest that fill all gaps
        sizes: dict[int, int] = {}
        for r in counts:
            if r.share > out:
                sizes[r.length] = sizes.get(r.length, 0) + r.n
        filling = sum(r.length * r.n for r in counts if r.share <= out)
        patterns, placements, packs = shortest_pack_first(sizes, room)
        if filling >= sum(r * n for r, _, n in patterns):
            break
    gaps = Gaps(patterns, packs, room, filling)

    # Placements are as many as the steps of shortest_pack_first: about two a length.
    table = docs.sparkSession.createDataFrame(placements, "p_length long, first long, f long, n long, base long, at long")
    whole = _ranked(tails.where(F.col("share") > out).select(*COLUMNS[:5], "row").withColumn("one", F.lit(1).cast("long")), ["length"], "one")
    inside = F.col("place") - F.col("first")
    placed = whole.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (inside >= 0) & (inside < F.col("n") * F.col("f")))
    placed = placed.select(*COLUMNS[:5], (F.col("base") + F.floor(inside / F.col("f"))).alias("sequence_id"), (F.col("at") + F.pmod(inside, F.col("f")) * F.col("length")).alias("offset"))

    def cut(b):
        rows = []
        for k, start, length, tokens, ids, place in zip(b["k"], b["start"], b["length"], b["doc_tokens"], b["ids"], b["place"], strict=True):
            for a, n, pack, offset in gaps.cut(place, length):
                rows.append((k, start + a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), tokens, pack, offset))
        return rows

    laid = _ranked(tails.where(F.col("share") <= out).select("row", "length"), [], "length") if out >= 0 else None
    parts = [pieces.where("ids is null").select(*COLUMNS[:5], (F.lit(gaps.packs) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")), placed]
    if laid is not None:
        filling = tails.where(F.col("share") <= out).select("k", "start", "length", "doc_tokens", "ids", "row").join(laid.select("row", "place"), "row").drop("row")
        kind = pieces.schema["k"].dataType.simpleString()
        parts.append(map_lists(filling, cut, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made.withColumnRenamed("k", key)
