"""Frame catalogue jobs: sessions, gaps, ranks, faults, sky events, selections, diffs.

Sessions are small (hundreds of frames), so windows are partitioned by project and night; nothing sorts a whole archive in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.robust import upper_mad, upper_median
from nightloom.operators.selection import met, select_median
from nightloom.sources.staging import staged


def quality(frames: DataFrame, keys=("night",)) -> DataFrame:
    """Adds quality: the row's place in its night by star count (ties by time, then id), from 0 to 1; a lone frame has 1."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy("stars", "second", "frame_id")) - 1
    n = F.count("*").over(w)
    return frames.withColumn("quality", F.when(n == 1, 1.0).otherwise(place / (n - 1)))


def night_triage(frames: DataFrame, by: str = "night") -> DataFrame:
    """by, median, best, worst, worst_frame, soft: HFR over all projects of a night, soft being how many lie above 1.25 times the median."""
    f = frames.select(by, "frame_id", "hfr")
    m = staged(select_median(f, [by], "hfr", "median"), "night-medians")
    worst = F.max_by("frame_id", F.struct("hfr", "frame_id")).alias("worst_frame")
    return met(f, m, [by]).groupBy(by, "median").agg(F.min("hfr").alias("best"), F.max("hfr").alias("worst"), worst, F.count(F.when(F.col("hfr") > 1.25 * F.col("median"), 1)).alias("soft"))


def gaps(frames: DataFrame, keys, threshold: int = 120) -> DataFrame:
    """keys, start, duration: breaks longer than threshold between successive frames."""
    w = Window.partitionBy(*keys).orderBy("second", "frame_id")
    after = F.lead("second").over(w)
    return frames.select(*keys, F.col("second").alias("start"), (after - F.col("second")).alias("duration")).where(F.col("duration") > threshold)


def sessions(frames: DataFrame, project: str = "project_id") -> DataFrame:
    """Runs of frames of one night: first frame, count, kept, exptime of the first, start and end.

    A night follows from the time, so the runs of a project are its nights: they are summed apart, and only these rows are numbered in order.
    """
    first = F.min(F.struct("second", "frame_id", "exptime"))
    nights = frames.groupBy(project, "night").agg(
        first.alias("f"),
        F.count("*").alias("frames"),
        F.sum(F.when(~F.col("rejected"), 1).otherwise(0)).alias("kept"),
        F.max("second").alias("end_second"),
    )
    out = nights.withColumn("session", F.row_number().over(Window.partitionBy(project).orderBy("f.second", "f.frame_id")).cast("long"))
    return out.select(project, "session", "night", F.col("f.frame_id").alias("first_frame"), F.col("f.exptime").alias("exptime"), "frames", "kept", F.col("f.second").alias("start_second"), "end_second")


def frame_ids(frames: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Dense ids in a global order: rows are dealt by ranges of the whole order, numbered within their part, and offset by the rows of the parts before.

    The ranges follow the rows, so a second with most of all frames is cut by what comes after it in the order. What was dealt is written once: the ids stay the same if a task is lost.
    """
    dealt = frames.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumns({"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "frame-ids")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # a row a part
    return dealt.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def defects(frames: DataFrame, keys=("project_id", "night"), least: int = 10) -> DataFrame:
    """Adds fault: the first that applies of seven, judged by the session's own medians; sessions of `least` frames or fewer have none."""
    stats = frames.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[upper_median(c).alias(f"m_{c}") for c in ("hfr", "ecc", "background")],
        *[upper_mad(c).alias(f"s_{c}") for c in ("hfr", "ecc", "background")],
        upper_median(F.col("stars").cast("double")).alias("m_stars"),
    )
    c = F.col
    fault = (
        F.when(c("n") <= least, None)
        .when(c("hfr") > c("m_hfr") + F.greatest(4 * c("s_hfr"), c("m_hfr") * 0.25), "out of focus")
        .when((c("s_ecc") > 0) & (c("ecc") > c("m_ecc") + 5 * c("s_ecc")), "trailed")
        .when((c("s_background") > 0) & (c("background") > c("m_background") + 6 * c("s_background")), "sky flooded")
        .when(c("stars") < c("m_stars") * 0.2, "lost the field")
        .when((c("stars") > 0) & (c("trails") / c("stars") > 0.015), "trailed, mount moved")
        .when(c("trails") >= 4, F.concat(c("trails").cast("string"), F.lit(" satellite trails")))
        .when(c("stars") < c("m_stars") * 0.7, "lost stars")
    )
    return frames.join(stats, list(keys)).withColumn("fault", fault).select(*frames.columns, "fault")


def sky_events(frames: DataFrame, keys=("project_id", "night"), least: int = 20, join_within: int = 300) -> DataFrame:
    """keys, label, start, end: twilight ending a session and thin cloud crossing it, from its star counts.

    Twilight is the last run below .75 of the session's median, of more than four frames; it never takes the first frame. Cloud is a run of three
    frames or more below .8 before that tail. Events of a label that follow each other within join_within seconds are one.
    """
    order = Window.partitionBy(*keys).orderBy("second", "frame_id")
    whole = Window.partitionBy(*keys)
    f = frames.select(*keys, "second", "frame_id", F.col("stars").cast("double").alias("stars"))
    f = f.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(whole)}).where(F.col("n") > least)
    middle = f.groupBy(*keys).agg(upper_median("stars").alias("median"))
    f = f.join(middle, list(keys)).where("median > 0")
    # The last frame that is bright enough, or the first frame, ends the body.
    last_ok = F.max(F.when((F.col("stars") >= F.col("median") * 0.75) | (F.col("i") == 0), F.col("i"))).over(whole)
    f = f.withColumn("tail", F.when(last_ok < F.col("n") - 5, last_ok + 1).otherwise(F.col("n")))
    twilight = f.where(F.col("i") >= F.col("tail")).groupBy(*keys).agg(F.min("second").alias("start"), F.max("second").alias("end")).withColumn("label", F.lit("astronomical twilight"))
    body = f.where(F.col("i") < F.col("tail")).withColumn("dim", F.col("stars") < F.col("median") * 0.8)
    body = body.withColumn("run", F.col("i") - F.sum(F.col("dim").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cloud = body.where("dim").groupBy(*keys, "run").agg(F.count("*").alias("len"), F.min("second").alias("start"), F.max("second").alias("end"))
    cloud = cloud.where("len >= 3").withColumn("label", F.lit("thin cloud"))
    events = cloud.select(*keys, "label", "start", "end").unionByName(twilight.select(*keys, "label", "start", "end"))
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    joined = (F.lag("label").over(by_start) == F.col("label")) & (F.col("start") <= F.lag("end").over(by_start) + join_within)
    events = events.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("part", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return events.groupBy(*keys, "part", "label").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def without_events(frames: DataFrame, events: DataFrame, keys=("project_id", "night")) -> DataFrame:
    """Frames outside all excluded spans (inclusive): an interval anti-join on the session."""
    e = events.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"e_{k}") for k in keys])
    return frames.join(e, same & F.col("second").between(F.col("e_start"), F.col("e_end")), "left_anti")


def unexplained_gaps(found: DataFrame, events: DataFrame, keys=("project_id", "night"), before: int = 120) -> DataFrame:
    """Gaps that don't begin in [event start - before, event end]."""
    e = events.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"e_{k}") for k in keys])
    return found.join(e, same & F.col("start").between(F.col("e_start") - before, F.col("e_end")), "left_anti")


def groups(scanned: DataFrame, threshold: int = 120) -> DataFrame:
    """Sessions of a scan (lights by object, night, filter and exposure; masters by object): frames, bytes, span, gaps, first reason."""
    w = Window.partitionBy("key").orderBy("second", "frame_id")
    gap = F.when(F.col("second") - F.lag("second").over(w) > threshold, 1).otherwise(0)
    g = scanned.where("kind <> 'Unreadable'").withColumn("key", F.when(F.col("kind") == "Master", F.col("master_key")).otherwise(F.col("group_key"))).withColumn("gap", gap)
    return g.groupBy("key").agg(
        F.max("kind").alias("kind"),
        F.min("night").alias("night"),
        F.count("*").alias("frames"),
        F.sum("bytes").alias("bytes"),
        (F.max("second") - F.min("second")).alias("span"),
        F.sum("gap").alias("gaps"),
        F.min_by("reason", F.struct("second", "frame_id")).alias("reason"),
    )


def fresh_present(scanned: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """By group: frames that the catalogue doesn't hold by identity and frames it does. Blank identities count as fresh."""
    known = held.select(F.col("identity").alias("held_identity")).where("held_identity <> ''").distinct()
    marked = scanned.join(known, scanned.identity == F.col("held_identity"), "left")
    is_held = F.col("held_identity").isNotNull()
    return marked.groupBy(*by).agg(F.count(F.when(~is_held, 1)).alias("fresh"), F.count(F.when(is_held, 1)).alias("present"))


def facets(frames: DataFrame) -> DataFrame:
    """facet, value, frames: what the catalogue can be filtered by."""
    pairs = F.array(
        F.struct(F.lit("exposure").alias("facet"), F.bround("exptime").cast("long").cast("string").alias("value")),
        F.struct(F.lit("filter").alias("facet"), F.col("filter").alias("value")),
        F.struct(F.lit("wcs").alias("facet"), F.when(F.col("has_wcs"), "solved").otherwise("unsolved").alias("value")),
        F.struct(F.lit("state").alias("facet"), F.when(F.col("rejected"), "rejected").otherwise("kept").alias("value")),
    )
    return frames.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("frames"))


def by_facets(frames: DataFrame, exposures=None, filters=None, solved=None, kept=None) -> DataFrame:
    """Frames that fit every given facet."""
    tests: list[Column] = []
    if exposures is not None:
        tests.append(F.bround("exptime").isin(*exposures))
    if filters is not None:
        tests.append(F.col("filter").isin(*filters))
    if solved is not None:
        tests.append(F.col("has_wcs") == solved)
    if kept is not None:
        tests.append(F.col("rejected") != kept)
    return frames.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def stack_inputs(frames: DataFrame, nights: DataFrame, exptime: float = 60.0, floor: float | None = None) -> DataFrame:
    """Kept frames of the chosen nights, within half a second of an exposure, at or above a quality floor if there is one."""
    out = frames.join(nights, "night", "left_semi").where(~F.col("rejected") & (F.abs(F.col("exptime") - exptime) <= 0.5))
    return out if floor is None else out.where(F.col("quality") >= floor)


def set_rejected(frames: DataFrame, flags: DataFrame) -> DataFrame:
    """Frames with rejected from flags(frame_id, rejected) where given."""
    return frames.join(flags.select("frame_id", F.col("rejected").alias("flag")), "frame_id", "left").withColumn("rejected", F.coalesce("flag", "rejected")).drop("flag")


def cull_below(frames: DataFrame, threshold: float) -> DataFrame:
    """rejected becomes quality < threshold, whatever it was."""
    return frames.withColumn("rejected", F.col("quality") < threshold)


def named_selections(frames: DataFrame) -> DataFrame:
    """name, frame_id: rule-made selections, in one pass."""
    names = F.array(
        F.when(~F.col("rejected"), F.lit("kept")),
        F.concat(F.lit("exposure "), F.bround("exptime").cast("long").cast("string")),
        F.concat(F.lit("filter "), F.col("filter")),
        F.when(F.col("has_wcs"), F.lit("solved")),
        F.when(F.col("quality") >= 0.6, F.lit("best")),
    )
    return frames.select(F.explode(names).alias("name"), "frame_id").where("name is not null")


def worst(frames: DataFrame, share: float, keys=("night",)) -> DataFrame:
    """The worst round(share * n) frames of each session by quality."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy("quality", "frame_id"))
    return frames.withColumns({"place": rank, "n": F.count("*").over(w)}).where(F.col("place") <= F.round(F.col("n") * share)).drop("n")


def recommend_strategy(frames: DataFrame, by: str, drift: Column) -> DataFrame:
    """by, frames, fwhm, sampling, full_resolution, drizzle from the median HFR (half-size pixels: FWHM is four times it)."""
    totals = frames.groupBy(by).agg(F.count("*").alias("frames"), drift.alias("drift"))
    g = met(totals, select_median(frames, [by], "hfr", "median"), [by], 1).withColumn("fwhm", F.col("median") * 4)
    sampling = F.when(F.col("fwhm") < 2.5, "under").when(F.col("fwhm") > 5, "over").otherwise("critical")
    finer = (F.col("fwhm") < 2.5) & (F.coalesce("drift", F.lit(0.5)) >= 0.5) & (F.col("frames") >= 50)
    return g.select(by, "frames", "fwhm", sampling.alias("sampling"), (F.col("fwhm") <= 5).alias("full_resolution"), F.when(finer, 2).otherwise(0).alias("drizzle"))


