"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents become pieces of at most `room` tokens. In a round, the waiting pieces and the open gaps are sorted by size together, and a sweep from the largest down
gives every piece its best successor: the smallest gap that holds it and that no larger piece has taken. Gaps lie on a stack in this order, so
a prefix sum over the sweep says which levels of the stack each run of equal gaps fills and each run of equal pieces takes; conflicts between equal pieces go by rank.
Gaps are updated, pieces that no gap can hold any more open new sequences (as many as they need together at least, the largest first), and the rest goes
to the next round. Runs of equal size, not single pieces, are the rows of the sweeps, so a round's tables are bounded by `room` and the matches of
the rounds before, whatever the corpus. The pieces themselves get their ranks and places by a join on size and rank.
"""

from __future__ import annotations

import base64
import math
import re
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm.common import interpreted, map_lists, saved

END = 2  # the id that closes every document
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"  # one vocabulary in two forms

# Fixed value: the pre-tokenizer's pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RARE = re.compile(r"[^\x00-\u024f\u0370-\u03ff\u0400-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The same byte-level vocabulary lies there in two forms; its ranks are encoded several times faster than the tokenizer's own file, with
    the same ids (tests compare them). Characters whose class the two libraries may see otherwise, beyond the common blocks, and texts with the vocabulary's special tokens go to the tokenizer.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})

    def plain(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def ids(self, text: str) -> bytes:
        if _RARE.search(text) or self.special.search(text):
            return self.plain(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # a run of white space too long for the pattern's matcher
            return self.plain(text)


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(paths: tuple[str, str] | None) -> Encoder:
    if paths is None:
        import public_tokenizers

        paths = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def token_pieces(docs: DataFrame, room: int = 1024, key: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the closing id; longer ones cut, the first piece shorter."""

    def cut(b):
        encoder, rows = _encoder(vocabulary), []
        for k, t in zip(b["k"], b["t"], strict=True):
            ids = encoder.ids(t) + END.to_bytes(4, "little") if t else END.to_bytes(4, "little")
            n = len(ids) // 4
            start, end = 0, n % room or room
            for piece in range(-(-n // room)):
                rows.append((k, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                start, end = end, end + room
        return rows

    kind = docs.schema[key].dataType.simpleString()
    return map_lists(docs.selectExpr(f"`{key}` k", f"cast(`{text}` as string) t"), cut, f"k {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


COLUMNS = ["what", "value", "f", "length", "first", "n", "sequence", "offset"]


def _sweep(state: DataFrame, room: int, bundle: int) -> DataFrame:
    """One round over runs of gaps (value, sequence, n) and pieces (length, first, n): rows (what, value, f, length, first, n, sequence, offset) of flows, gaps and pieces.

    f pieces of a class side by side count as one item where the class outnumbers the gaps that hold it, and where `bundle` (of late rounds, with few pieces left) allows it: so
    many tiny pieces need few rounds. A flow puts pieces first .. first + n * f - 1 of a length into n sequences, f after one another from its offset on.
    """
    c, whole, none = F.col, F.floor(F.col("n") / F.col("f")), F.lit(None).cast("long")
    order = Window.orderBy(F.desc("value"), "kind", "base")  # over bounded tables: see above
    every = order.rowsBetween(Window.unboundedPreceding, 0)
    is_gap = c("what") == "gap"
    runs = state.where("what <> 'flow'").select(F.when(is_gap, c("value")).otherwise(c("length")).alias("value"), F.when(is_gap, 0).otherwise(1).alias("kind"), F.when(is_gap, c("sequence")).otherwise(c("first")).alias("base"), "n", "length")
    gaps = F.sum(F.when(c("kind") == 0, c("n")).otherwise(0)).over(every)
    widest = F.max(F.when(c("kind") == 0, c("value"))).over(every)
    wanted = F.greatest(F.floor(c("n") / (2 * F.greatest(gaps, F.lit(1)))), F.least(c("n"), F.lit(bundle)))
    f = F.greatest(F.lit(1), F.least(wanted, F.floor(F.least(F.lit(room // 2), widest) / c("length"))))
    runs = runs.withColumn("f", F.when((c("kind") == 1) & (gaps > 0), f).otherwise(F.lit(1)).cast("long"))
    parts = F.array(
        F.struct((c("value") * c("f")).alias("value"), c("f").alias("f"), c("base").alias("base"), whole.alias("n")),
        F.struct(c("value").alias("value"), F.lit(1).cast("long").alias("f"), (c("base") + whole * c("f")).alias("base"), (c("n") - whole * c("f")).alias("n")),
    )
    items = runs.select("kind", "length", F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias("p")).select("kind", "length", "p.*")
    # Height of the stack after each run: a prefix sum that never falls below 0.
    items = items.withColumn("sum", F.sum(F.when(c("kind") == 0, c("n")).otherwise(-c("n"))).over(every))
    items = items.withColumn("height", c("sum") + F.greatest(F.lit(0), -F.min("sum").over(every)))
    before = F.coalesce(F.lag("height").over(order), F.lit(0))
    items = items.withColumns({"at": F.row_number().over(order), "lo": F.least(before, c("height")), "hi": F.greatest(before, c("height"))})
    # Levels cut where any run begins or ends; a run becomes a row for each stretch of levels that it fills or takes, and one of its own (place 0).
    level = Window.orderBy("edge")
    edges = items.where("lo < hi").select(F.explode(F.array("lo", "hi")).alias("edge")).distinct()
    edges = F.broadcast(edges.select("edge", F.row_number().over(level).alias("place"), F.lead("edge").over(level).alias("next")))
    spans = items.join(edges.selectExpr("edge lo", "place a"), "lo", "left").join(edges.selectExpr("edge hi", "place b"), "hi", "left")
    inner = F.when(c("lo") < c("hi"), F.sequence("a", c("b") - 1)).otherwise(F.array().cast("array<int>"))
    spans = spans.withColumn("place", F.explode(F.concat(F.array(F.lit(0)), inner))).join(edges.selectExpr("place", "edge low", "next high"), "place", "left")
    by = Window.partitionBy("place").orderBy("at")
    spans = spans.withColumns({f"gap_{k}": F.lag(k).over(by) for k in ("value", "base", "lo")} | {"taken": F.lead("kind").over(by)})
    count, sequence, got = c("high") - c("low"), c("gap_base") + c("low") - c("gap_lo"), c("hi") - c("lo")

    def row(when, what, **at):
        return F.when(when, F.struct(F.lit(what).alias("what"), *[at.get(k, none).cast("long").alias(k) for k in COLUMNS[1:]]))

    inside, piece = c("place") > 0, c("kind") == 1
    made = F.array(
        row(inside & piece, "flow", f=c("f"), length=c("length"), first=c("base") + c("f") * (c("low") - c("lo")), n=count, sequence=sequence, offset=F.lit(room) - c("gap_value")),
        row(inside & piece & (c("gap_value") > c("value")), "gap", value=c("gap_value") - c("value"), n=count, sequence=sequence),
        row(inside & ~piece & c("taken").isNull(), "gap", value=c("value"), n=count, sequence=c("base") + c("low") - c("lo")),
        row(~inside & piece & (got < c("n")), "piece", length=c("length"), first=c("base") + c("f") * got, n=c("f") * (c("n") - got)),
    )
    return spans.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("x.*")


def _opened(swept: DataFrame, room: int, opened: int) -> tuple[DataFrame, int, bool]:
    """The state after pieces that no gap holds have opened sequences, how many sequences there are, and whether pieces are waiting."""
    c, none = F.col, F.lit(None).cast("long")
    most = F.broadcast(swept.where("what = 'gap'").agg(F.coalesce(F.max("value"), F.lit(0)).alias("most")))  # one row
    pieces = swept.where("what = 'piece'").join(most).withColumn("lone", c("length") > c("most"))
    of = lambda x: F.coalesce(F.sum(F.when(c("lone"), x)), F.lit(0))
    tokens, alone, lone, waiting = pieces.agg(of(c("length") * c("n")), of(F.when(2 * c("length") > room, c("n"))), of(c("n")), F.coalesce(F.sum("n"), F.lit(0))).first()
    need = max(-(-tokens // room), alone)
    # The first `need` of them in the order of size begin a sequence each.
    before = F.sum(F.when(c("lone"), c("n")).otherwise(0)).over(Window.orderBy(F.desc("length"), "first").rowsBetween(Window.unboundedPreceding, 0)) - c("n")
    took = F.when(c("lone"), F.greatest(F.lit(0), F.least(c("n"), F.lit(need) - c("before")))).otherwise(0)
    pieces = pieces.withColumn("before", before).withColumn("took", took)
    first, some = c("before") + F.lit(opened), c("took") > 0

    def row(when, what, **at):
        return F.when(when, F.struct(F.lit(what).alias("what"), *[at.get(k, none).cast("long").alias(k) for k in COLUMNS[1:]]))

    made = F.array(
        row(some, "flow", f=F.lit(1), length=c("length"), first=c("first"), n=c("took"), sequence=first, offset=F.lit(0)),
        row(some & (c("length") < room), "gap", value=F.lit(room) - c("length"), n=c("took"), sequence=first),
        row(c("took") < c("n"), "piece", length=c("length"), first=c("first") + c("took"), n=c("n") - c("took")),
    )
    made = pieces.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("x.*")
    return swept.where("what = 'gap'").select(*COLUMNS).union(made), opened + need, waiting > min(need, lone)


def _bundle(turn: int) -> int:
    """Pieces side by side that a round allows: singles and bundles in turn. Bundles of all classes grow to the widest gap, of which there may be one only; the narrower
    gaps take single pieces, which the next round offers them. The number stays a long, however many rounds there are."""
    return 2 ** min(62, max(0, turn - 2)) if turn % 2 else 1


def best_fit_rounds(sizes: DataFrame, room: int) -> DataFrame:
    """From length, n (pieces of a length): flows length, first, n, f, sequence, offset. Pieces ranked first .. first + n * f - 1 of a length go to sequences sequence, + 1, ...,
    f to each, one after another from offset on."""
    flow = lambda d: d.where("what = 'flow'").select("length", "first", "n", "f", "sequence", "offset")
    null = lambda name: F.lit(None).cast("long").alias(name)
    swept = sizes.select(F.lit("piece").alias("what"), null("value"), null("f"), "length", F.lit(0).cast("long").alias("first"), "n", null("sequence"), null("offset"))
    flows, opened, turn = None, 0, 0
    while True:
        state, opened, waiting = _opened(swept, room, opened)
        if waiting:
            state = _sweep(state, room, _bundle(turn)).union(state.where("what = 'flow'"))
        swept = saved(state.coalesce(1), "packing-round")
        flows = flow(swept) if flows is None else flows.union(flow(swept))
        if not waiting:
            return flows
        turn += 1


def pack(docs: DataFrame, room: int = 1024, key: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    Null or empty text is the closing id alone. Null keys stay null; repeated rows are packed each; equal lengths
    are told apart by row. Other columns are not carried. An empty table gives an empty one.
    """
    pieces = saved(token_pieces(docs, room, key, text, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    cells = max(1, math.isqrt(pieces.count()))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    # Ranks in a size: the place in a cell, and what the cells before hold; cells and their rows are as many as the root of all pieces.
    counts = dealt.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.select("length", "cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "cells")
    sizes = saved(counts.groupBy("length").agg(F.sum("n").alias("n")).coalesce(1), "sizes")  # a row a length
    with interpreted(docs.sparkSession):
        fits = best_fit_rounds(sizes, room)
    fits = fits.select(F.col("length").alias("f_length"), "first", (F.col("first") + F.col("n") * F.col("f")).alias("end"), "f", "sequence", F.col("offset").alias("from"))
    if fits.count() <= 50_000:  # bounded by the sizes and rounds, not by the corpus; 2 MB here
        fits = F.broadcast(fits)
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1
    ranked = dealt.withColumn("inside", inside).join(counts.select("length", "cell", "before"), ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside"))
    placed = ranked.join(fits, (F.col("length") == F.col("f_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    at = F.col("rank") - F.col("first")
    return placed.select(key, "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(at / F.col("f"))).alias("sequence_id"), (F.col("from") + F.pmod(at, F.col("f")) * F.col("length")).alias("offset"))
