"""Queries of the frame catalogue over the derived tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.fixtures import view, with_views
from nightloom.functions import frames as ff
from nightloom.functions.robust import upper_median
from nightloom.operators import triage as T
from nightloom.operators.selection import select_mad, select_median

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ("frames",)):
    """Register a function under its name, with the body of its oracle SQL over the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(*views, body=sql)
        return f

    return put


def frames(spark, sf_dir):
    """The derived frames with night and second, and rejected etc. as they are."""
    f = view(spark, sf_dir, "frames")
    return f.withColumns({"night": ff.night(F.col("ts")).cast("string"), "second": ff.second(F.col("ts"))})


#: The same, as a further common table expression.
F2 = """, f AS (SELECT *, CAST(CAST(ts - INTERVAL 12 HOUR AS DATE) AS VARCHAR) AS night, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM frames)"""
MED = "list_sort(list({0}))[CAST(floor(count({0}) / 2) AS BIGINT) + 1]"


@query(F2 + " SELECT frame_id, night FROM f")
def prj_night(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_id", "night")


@query(F2 + """ SELECT frame_id, second, CAST(year(ts) * 372 + month(ts) * 31 + day(ts) AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS pseudo FROM frames JOIN (SELECT frame_id, second FROM f) USING (frame_id)""")
def prj_second(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_id", "second", ff.pseudo_second(F.col("ts")).alias("pseudo"))


def keyed(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.withColumns(
        {
            "identity": ff.identity(F.col("ts"), F.col("object"), F.col("exptime")),
            "group_key": ff.group_key(F.col("object"), F.col("night"), F.col("filter"), F.col("exptime")),
            "master_key": ff.master_key(F.col("object")),
        }
    )


KEYED = F2 + """, k AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|' || object || '|' || CAST(round_even(exptime, 1) AS VARCHAR) AS identity,
 object || '|' || night || '|' || filter || '|' || CAST(CAST(round_even(exptime, 0) AS BIGINT) AS VARCHAR) AS group_key, 'master|' || object AS master_key FROM f)"""


@query(KEYED + " SELECT frame_id, identity, group_key, master_key FROM k")
def prj_keys(spark, sf_dir):
    return keyed(spark, sf_dir).select("frame_id", "identity", "group_key", "master_key")


def scanned(spark, sf_dir):
    i = F.col("frame_id")
    k = keyed(spark, sf_dir).withColumn("c", ff.classify(F.col("planes"), F.col("width"), F.col("height"), F.when(i % 500 == 11, i % 90), F.when(i % 6 > 0, "Light "), F.when(i % 7 > 0, "GRBG")))
    return k.withColumns({"kind": F.col("c.kind"), "reason": F.col("c.reason")}).drop("c")


SCANNED = KEYED + """, t AS (SELECT *, CASE WHEN frame_id % 500 = 11 THEN frame_id % 90 END AS stackcnt, CASE WHEN frame_id % 6 > 0 THEN 'Light' ELSE '?' END AS imagetyp, CASE WHEN frame_id % 7 > 0 THEN 'GRBG' ELSE 'none' END AS bayerpat FROM k),
 s AS (SELECT *, CASE WHEN stackcnt IS NOT NULL OR planes = 3 THEN 'Master' WHEN width = 0 OR height = 0 THEN 'Unreadable' ELSE 'Light' END AS kind,
 CASE WHEN stackcnt IS NOT NULL THEN 'STACKCNT = ' || stackcnt || ', NAXIS3 = ' || planes WHEN planes = 3 THEN 'NAXIS3 = 3, already colour' WHEN width = 0 OR height = 0 THEN 'no image dimensions'
 ELSE 'IMAGETYP = ' || imagetyp || ', single plane, BAYERPAT = ' || bayerpat END AS reason FROM t)"""


@query(SCANNED + " SELECT frame_id, kind, reason FROM s")
def prj_classify(spark, sf_dir):
    return scanned(spark, sf_dir).select("frame_id", "kind", "reason")


OPTICS = "2.9 + frame_id % 3", "160 * (frame_id % 4)"


@query(f", o AS (SELECT frame_id, has_wcs, {OPTICS[0]} AS px, {OPTICS[1]} AS fl FROM frames) SELECT frame_id, round(CASE WHEN fl > 0 THEN 206.265 * CAST(px AS DOUBLE) / fl ELSE 0 END, 6) AS scale, has_wcs FROM o")
def prj_pixel_scale(spark, sf_dir):
    f = view(spark, sf_dir, "frames")
    return f.select("frame_id", F.round(ff.pixel_scale(F.expr(OPTICS[0]).cast("double"), F.expr(OPTICS[1])), 6).alias("scale"), "has_wcs")


@query(" SELECT frame_id, filter, regexp_matches(upper(regexp_replace(filter, '[^A-Za-z0-9]', '', 'g')), '" + "|".join(ff.NARROWBAND) + "') AS narrowband FROM frames")
def prj_is_narrowband(spark, sf_dir):
    return view(spark, sf_dir, "frames").select("frame_id", "filter", ff.is_narrowband(F.col("filter")).alias("narrowband"))


RANKED = F2 + """, q AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY night) = 1 THEN 1.0 ELSE CAST(row_number() OVER (PARTITION BY night ORDER BY stars, second, frame_id) - 1 AS DOUBLE) / (count(*) OVER (PARTITION BY night) - 1) END AS quality FROM f)"""


def ranked(spark, sf_dir):
    return T.quality(frames(spark, sf_dir))


@query(RANKED + " SELECT frame_id, night, round(quality, 6) AS quality FROM q")
def win_quality(spark, sf_dir):
    return ranked(spark, sf_dir).select("frame_id", "night", F.round("quality", 6).alias("quality"))


@query(RANKED + " SELECT frame_id, CASE WHEN quality < 0.2 THEN 0 WHEN quality < 0.4 THEN 1 WHEN quality < 0.6 THEN 2 WHEN quality < 0.8 THEN 3 ELSE 4 END AS band FROM q")
def prj_quality_band(spark, sf_dir):
    return ranked(spark, sf_dir).select("frame_id", ff.quality_band(F.col("quality")).alias("band"))


@query(F2 + """ SELECT facet, value, count(*) AS frames FROM (
 SELECT 'exposure' AS facet, CAST(CAST(round_even(exptime, 0) AS BIGINT) AS VARCHAR) AS value FROM f UNION ALL SELECT 'filter', filter FROM f
 UNION ALL SELECT 'wcs', CASE WHEN has_wcs THEN 'solved' ELSE 'unsolved' END FROM f UNION ALL SELECT 'state', CASE WHEN rejected THEN 'rejected' ELSE 'kept' END FROM f) GROUP BY 1, 2""")
def flt_facets(spark, sf_dir):
    return T.facets(frames(spark, sf_dir))


@query(" SELECT frame_id, object, filter FROM frames WHERE round_even(exptime, 0) IN (60) AND filter IN ('Ha', 'LP') AND has_wcs AND NOT rejected")
def flt_by_facets(spark, sf_dir):
    return T.by_facets(view(spark, sf_dir, "frames"), exposures=[60], filters=["Ha", "LP"], solved=True, kept=True).select("frame_id", "object", "filter")


ODD_NIGHTS = "CAST(right(night, 2) AS INT) % 2 = 1"


@query(RANKED + f" SELECT frame_id, night, round(quality, 6) AS quality FROM q WHERE {ODD_NIGHTS} AND NOT rejected AND abs(exptime - 60) <= 0.5 AND quality >= 0.25")
def flt_stack_inputs(spark, sf_dir):
    q = ranked(spark, sf_dir)
    nights = q.select("night").where(ODD_NIGHTS).distinct()
    return T.stack_inputs(q, nights, 60.0, 0.25).select("frame_id", "night", F.round("quality", 6).alias("quality"))


@query(RANKED + """, m AS (SELECT frame_id, CASE WHEN frame_id % 9 = 0 THEN NOT rejected ELSE rejected END AS flagged, quality < 0.2 AS culled FROM q)
 SELECT frame_id, flagged, culled FROM m""")
def upd_reject(spark, sf_dir):
    q = ranked(spark, sf_dir)
    flags = q.where("frame_id % 9 = 0").select("frame_id", (~F.col("rejected")).alias("rejected"))
    flagged = T.set_rejected(q, flags).select("frame_id", F.col("rejected").alias("flagged"))
    return flagged.join(T.cull_below(q, 0.2).select("frame_id", F.col("rejected").alias("culled")), "frame_id")


@query(F2 + f""", g AS (SELECT object, filter, night, {MED.format('exptime')} AS exposure, count(*) AS n FROM f GROUP BY ALL)
 SELECT object, filter, night, replace(object, ' ', '') || '_' || CAST(CAST(round_even(exposure, 0) AS BIGINT) AS VARCHAR) || 's_' || filter || '_' || replace(night, '-', '') || '.fit' AS name,
 replace(object, ' ', '') || '_' || n || 'x_' || CAST(CAST(round_even(exposure, 0) AS BIGINT) AS VARCHAR) || 's_' || filter || '_' || replace(night, '-', '') || '.fit' AS export_name FROM g""")
def prj_master_name(spark, sf_dir):
    g = frames(spark, sf_dir).groupBy("object", "filter", "night").agg(upper_median("exptime").alias("exposure"), F.count("*").alias("n"))
    parts = F.col("object"), F.col("exposure"), F.col("filter"), F.col("night")
    return g.select("object", "filter", "night", ff.master_name(*parts).alias("name"), ff.master_name(*parts, F.col("n")).alias("export_name"))


@query(KEYED + """ SELECT group_key, count(*) FILTER (WHERE identity NOT IN (SELECT identity FROM k WHERE frame_id % 3 <> 0)) AS fresh,
 count(*) FILTER (WHERE identity IN (SELECT identity FROM k WHERE frame_id % 3 <> 0)) AS present FROM k GROUP BY 1""")
def jn_fresh_present(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return T.fresh_present(k, k.where("frame_id % 3 <> 0"), ["group_key"])


@query(F2 + f", n AS (SELECT DISTINCT night FROM f WHERE {ODD_NIGHTS}) SELECT night, count(*) AS frames FROM f WHERE night IN (SELECT night FROM n) OR NOT EXISTS (SELECT 1 FROM n) GROUP BY 1")
def jn_night_selection(spark, sf_dir):
    f = frames(spark, sf_dir)
    saved = f.select("night").where(ODD_NIGHTS).distinct().unionByName(spark.createDataFrame([("1999-01-01",)], "night string"))
    known = saved.join(f.select("night").distinct(), "night", "left_semi")
    some = known.agg((F.count("*") > 0).alias("some"))  # one row
    marked = f.join(known.withColumn("chosen", F.lit(True)), "night", "left").join(F.broadcast(some))
    return marked.where(F.coalesce("chosen", F.lit(False)) | ~F.col("some")).groupBy("night").agg(F.count("*").alias("frames"))


GAPS = """, gp AS (SELECT project_id, night, second AS start, lead(second) OVER w - second AS duration FROM f WINDOW w AS (PARTITION BY project_id, night ORDER BY second, frame_id))"""


@query(F2 + GAPS + " SELECT project_id, night, start, duration FROM gp WHERE duration > 120")
def win_gaps(spark, sf_dir):
    return T.gaps(frames(spark, sf_dir), ["project_id", "night"])


EVENTS = f""", e0 AS (SELECT project_id, night, second, frame_id, CAST(stars AS DOUBLE) AS stars, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY project_id, night) AS n FROM f WINDOW w AS (PARTITION BY project_id, night ORDER BY second, frame_id)),
e1 AS (SELECT * FROM e0 JOIN (SELECT project_id, night, {MED.format('stars')} AS median FROM e0 WHERE n > 20 GROUP BY ALL) USING (project_id, night) WHERE n > 20 AND median > 0),
e2 AS (SELECT *, max(CASE WHEN stars >= median * 0.75 OR i = 0 THEN i END) OVER (PARTITION BY project_id, night) AS ok FROM e1),
e3 AS (SELECT *, CASE WHEN ok < n - 5 THEN ok + 1 ELSE n END AS tail FROM e2),
e4 AS (SELECT *, i - sum(CASE WHEN stars < median * 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, night ORDER BY i) AS run FROM e3 WHERE i < tail),
e5 AS (SELECT project_id, night, 'thin cloud' AS label, min(second) AS start, max(second) AS stop FROM e4 WHERE stars < median * 0.8 GROUP BY project_id, night, run HAVING count(*) >= 3
 UNION ALL SELECT project_id, night, 'astronomical twilight', min(second), max(second) FROM e3 WHERE i >= tail GROUP BY project_id, night),
e6 AS (SELECT *, CASE WHEN lag(label) OVER w = label AND start <= lag(stop) OVER w + 300 THEN 0 ELSE 1 END AS fresh FROM e5 WINDOW w AS (PARTITION BY project_id, night ORDER BY start, stop)),
e7 AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id, night ORDER BY start, stop) AS part FROM e6),
ev AS (SELECT project_id, night, label, min(start) AS start, max(stop) AS "end" FROM e7 GROUP BY project_id, night, label, part)"""


@query(F2 + EVENTS + ' SELECT project_id, night, label, start, "end" FROM ev')
def win_sky_events(spark, sf_dir):
    return T.sky_events(frames(spark, sf_dir))


@query(F2 + EVENTS + """ SELECT frame_id, night FROM f WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.project_id = f.project_id AND ev.night = f.night AND f.second BETWEEN ev.start AND ev."end")""")
def jn_exclude_events(spark, sf_dir):
    f = frames(spark, sf_dir)
    return T.without_events(f, T.sky_events(f)).select("frame_id", "night")


@query(F2 + EVENTS + GAPS + """ SELECT project_id, night, start, duration FROM gp WHERE duration > 120 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.project_id = gp.project_id AND ev.night = gp.night AND gp.start BETWEEN ev.start - 120 AND ev."end")""")
def jn_unexplained_gaps(spark, sf_dir):
    f = frames(spark, sf_dir)
    return T.unexplained_gaps(T.gaps(f, ["project_id", "night"]), T.sky_events(f))


@query(SCANNED + """, g AS (SELECT *, CASE WHEN kind = 'Master' THEN master_key ELSE group_key END AS key FROM s WHERE kind <> 'Unreadable'),
 h AS (SELECT *, CASE WHEN second - lag(second) OVER (PARTITION BY key ORDER BY second, frame_id) > 120 THEN 1 ELSE 0 END AS gap, row_number() OVER (PARTITION BY key ORDER BY second, frame_id) AS r FROM g)
 SELECT key, max(kind) AS kind, min(night) AS night, count(*) AS frames, CAST(sum(bytes) AS BIGINT) AS bytes, max(second) - min(second) AS span, CAST(sum(gap) AS BIGINT) AS gaps, max(CASE WHEN r = 1 THEN reason END) AS reason FROM h GROUP BY key""")
def agg_sessions(spark, sf_dir):
    return T.groups(scanned(spark, sf_dir))


@query(SCANNED + """ SELECT max(kind) <> 'Light' AS is_master, coalesce(min(night), '') AS night, CASE WHEN kind = 'Master' THEN master_key ELSE group_key END AS key FROM s WHERE kind <> 'Unreadable' GROUP BY 3 ORDER BY 1, 2 DESC, 3""")
def srt_groups(spark, sf_dir):
    g = T.groups(scanned(spark, sf_dir))
    return g.select((F.col("kind") != "Light").alias("is_master"), F.coalesce("night", F.lit("")).alias("night"), "key").orderBy("is_master", F.desc("night"), "key")


@query(SCANNED + """ SELECT count(*) AS files, count(*) FILTER (WHERE kind = 'Light') AS lights, count(*) FILTER (WHERE kind = 'Master') AS masters, count(*) FILTER (WHERE kind = 'Unreadable') AS unreadable,
 count(DISTINCT CASE WHEN kind = 'Light' THEN group_key END) AS sessions, count(DISTINCT CASE WHEN kind = 'Light' THEN group_key WHEN kind = 'Master' THEN master_key END) AS groups, CAST(sum(bytes) AS BIGINT) AS bytes,
 array_to_string(list_sort(list_distinct(list(CAST(exptime AS VARCHAR)) FILTER (WHERE kind = 'Light'))), ',') AS exposures FROM s""")
def agg_scan_stats(spark, sf_dir):
    s = scanned(spark, sf_dir)
    light, master = F.col("kind") == "Light", F.col("kind") == "Master"
    return s.agg(
        F.count("*").alias("files"),
        F.count(F.when(light, 1)).alias("lights"),
        F.count(F.when(master, 1)).alias("masters"),
        F.count(F.when(F.col("kind") == "Unreadable", 1)).alias("unreadable"),
        F.count_distinct(F.when(light, F.col("group_key"))).alias("sessions"),
        F.count_distinct(F.when(light, F.col("group_key")).when(master, F.col("master_key"))).alias("groups"),
        F.sum("bytes").alias("bytes"),
        F.array_join(F.array_sort(F.collect_set(F.when(light, F.col("exptime").cast("string")))), ",").alias("exposures"),
    )


@query(F2 + " SELECT project_id, count(DISTINCT night) AS nights, count(*) AS frames, count(*) FILTER (WHERE NOT rejected) AS kept, max(second) AS last_second, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY 1")
def agg_project_summary(spark, sf_dir):
    kept = F.count(F.when(~F.col("rejected"), 1))
    return frames(spark, sf_dir).groupBy("project_id").agg(F.count_distinct("night").alias("nights"), F.count("*").alias("frames"), kept.alias("kept"), F.max("second").alias("last_second"), F.sum("bytes").alias("bytes"))


@query(F2 + " SELECT night, count(*) AS frames, min(stars) AS min_stars, max(stars) AS max_stars, round(avg(hfr), 6) AS mean_hfr FROM f GROUP BY 1")
def agg_night_report(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("night").agg(F.count("*").alias("frames"), F.min("stars").alias("min_stars"), F.max("stars").alias("max_stars"), F.round(F.avg("hfr"), 6).alias("mean_hfr"))


@query(F2 + f""", m AS (SELECT night, {MED.format('hfr')} AS median FROM f GROUP BY 1)
 SELECT night, round(median, 6) AS median, min(hfr) AS best, max(hfr) AS worst, arg_max(frame_id, hfr * 1e9 + frame_id) AS worst_frame, count(*) FILTER (WHERE hfr > 1.25 * median) AS soft FROM f JOIN m USING (night) GROUP BY night, median""")
def agg_triage(spark, sf_dir):
    return T.night_triage(frames(spark, sf_dir)).withColumn("median", F.round("median", 6))


@query(F2 + f" SELECT object, {MED.format('hfr')} AS hfr, {MED.format('stars')} AS stars FROM f GROUP BY 1")
def agg_upper_median(spark, sf_dir):
    f = frames(spark, sf_dir)
    return select_median(f, ["object"], "hfr", "hfr").join(select_median(f, ["object"], "stars", "stars"), "object")


@query(F2 + f""", m AS (SELECT object, {MED.format('hfr')} AS median FROM f GROUP BY 1), d AS (SELECT object, median, abs(hfr - median) AS away FROM f JOIN m USING (object))
 SELECT object, median, round({MED.format('away')} * 1.4826, 6) AS sigma FROM d GROUP BY object, median""")
def agg_mad(spark, sf_dir):
    return select_mad(frames(spark, sf_dir), ["object"], "hfr", "median", "sigma").withColumn("sigma", F.round("sigma", 6))


@query(F2 + " SELECT frame_id, row_number() OVER (ORDER BY second, frame_id) - 1 AS id FROM f")
def win_frame_ids(spark, sf_dir):
    return T.frame_ids(frames(spark, sf_dir).select("second", "frame_id"), ["second", "frame_id"]).select("frame_id", "id")


@query(F2 + """, c AS (SELECT *, CASE WHEN lag(night) OVER w = night THEN 0 ELSE 1 END AS changed FROM f WINDOW w AS (PARTITION BY project_id ORDER BY second, frame_id)),
 r AS (SELECT *, sum(changed) OVER (PARTITION BY project_id ORDER BY second, frame_id) AS session FROM c)
 SELECT project_id, CAST(session AS BIGINT) AS session, min(night) AS night, arg_min(frame_id, second * 1000000 + frame_id) AS first_frame, arg_min(exptime, second * 1000000 + frame_id) AS exptime, count(*) AS frames,
 count(*) FILTER (WHERE NOT rejected) AS kept, min(second) AS start_second, max(second) AS end_second FROM r GROUP BY 1, 2""")
def win_sessions(spark, sf_dir):
    return T.sessions(frames(spark, sf_dir))


def _stat(c: str) -> str:
    return f"{MED.format(c)} AS m_{c}"


DEFECTS = f""", m AS (SELECT project_id, night, count(*) AS n, {_stat('hfr')}, {_stat('ecc')}, {_stat('background')}, CAST({MED.format('stars')} AS DOUBLE) AS m_stars FROM f GROUP BY ALL),
 d AS (SELECT *, abs(hfr - m_hfr) AS d1, abs(ecc - m_ecc) AS d2, abs(background - m_background) AS d3 FROM f JOIN m USING (project_id, night)),
 s AS (SELECT project_id, night, {MED.format('d1')} * 1.4826 AS s_hfr, {MED.format('d2')} * 1.4826 AS s_ecc, {MED.format('d3')} * 1.4826 AS s_background FROM d GROUP BY ALL),
 x AS (SELECT *, CASE WHEN n <= 10 THEN NULL WHEN hfr > m_hfr + greatest(4 * s_hfr, m_hfr * 0.25) THEN 'out of focus' WHEN s_ecc > 0 AND ecc > m_ecc + 5 * s_ecc THEN 'trailed'
 WHEN s_background > 0 AND background > m_background + 6 * s_background THEN 'sky flooded' WHEN stars < m_stars * 0.2 THEN 'lost the field' WHEN stars > 0 AND CAST(trails AS DOUBLE) / stars > 0.015 THEN 'trailed, mount moved'
 WHEN trails >= 4 THEN CAST(trails AS VARCHAR) || ' satellite trails' WHEN stars < m_stars * 0.7 THEN 'lost stars' END AS fault FROM d JOIN s USING (project_id, night))"""


@query(F2 + DEFECTS + " SELECT frame_id, night, fault FROM x")
def win_defects(spark, sf_dir):
    return T.defects(frames(spark, sf_dir)).select("frame_id", "night", "fault")


@query(RANKED + """, w AS (SELECT frame_id, night, row_number() OVER (PARTITION BY night ORDER BY quality, frame_id) AS place, count(*) OVER (PARTITION BY night) AS n FROM q) SELECT frame_id, night, place FROM w WHERE place <= round(n * 0.1)""")
def top_worst_k(spark, sf_dir):
    return T.worst(ranked(spark, sf_dir), 0.1).select("frame_id", "night", F.col("place").cast("long").alias("place"))


@query(F2 + " SELECT arg_max(night, n * 10000000000 - first) AS night, max(n) AS frames FROM (SELECT night, count(*) AS n, min(second) AS first FROM f GROUP BY 1)")
def top_largest_session(spark, sf_dir):
    g = frames(spark, sf_dir).groupBy("night").agg(F.count("*").alias("n"), F.min("second").alias("first"))
    return g.agg(F.max_by("night", F.struct("n", -F.col("first"))).alias("night"), F.max("n").alias("frames"))


@query(F2 + " SELECT night, arg_max(frame_id, stars * 100000000 + frame_id) AS frame_id FROM f GROUP BY 1")
def top_reference_frame(spark, sf_dir):
    # The last of equals in time order, which is that of ids here.
    return frames(spark, sf_dir).groupBy("night").agg(F.max_by("frame_id", F.struct("stars", "frame_id")).alias("frame_id"))


@query(RANKED + """ SELECT name, frame_id FROM (SELECT 'kept' AS name, frame_id FROM q WHERE NOT rejected UNION ALL SELECT 'exposure ' || CAST(CAST(round_even(exptime, 0) AS BIGINT) AS VARCHAR), frame_id FROM q
 UNION ALL SELECT 'filter ' || filter, frame_id FROM q UNION ALL SELECT 'solved', frame_id FROM q WHERE has_wcs UNION ALL SELECT 'best', frame_id FROM q WHERE quality >= 0.6)""")
def set_named_selections(spark, sf_dir):
    return T.named_selections(ranked(spark, sf_dir))


@query(F2 + f" SELECT DISTINCT night FROM f WHERE {ODD_NIGHTS} INTERSECT SELECT night FROM f WHERE NOT rejected")
def set_sessions_intersect(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.where(ODD_NIGHTS).select("night").intersect(f.where("not rejected").select("night"))


@query(F2 + f""", d AS (SELECT filter, count(*) AS frames, {MED.format('hfr')} * 4 AS fwhm, max(ecc) * 3 AS drift FROM f GROUP BY 1)
 SELECT filter, frames, round(fwhm, 6) AS fwhm, CASE WHEN fwhm < 2.5 THEN 'under' WHEN fwhm > 5 THEN 'over' ELSE 'critical' END AS sampling, fwhm <= 5 AS full_resolution,
 CASE WHEN fwhm < 2.5 AND drift >= 0.5 AND frames >= 50 THEN 2 ELSE 0 END AS drizzle FROM d""")
def agg_recommend_strategy(spark, sf_dir):
    return T.recommend_strategy(frames(spark, sf_dir), "filter", F.max("ecc") * 3).withColumn("fwhm", F.round("fwhm", 6))


@query(F2 + DEFECTS + GAPS + f""", t AS (SELECT project_id, night, count(*) AS frames, count(*) FILTER (WHERE NOT rejected) AS kept, count(fault) AS faults, max(second) - min(second) AS span, round({MED.format('hfr')}, 6) AS median_hfr FROM x GROUP BY 1, 2)
 SELECT project_id, night, frames, kept, faults, span, median_hfr, coalesce(gaps, 0) AS gaps FROM t LEFT JOIN (SELECT project_id, night, count(*) AS gaps FROM gp WHERE duration > 120 GROUP BY 1, 2) USING (project_id, night)""")
def agg_session_triage(spark, sf_dir):
    """Per session: frames, kept, faults, span, gaps, median HFR."""
    f = T.defects(frames(spark, sf_dir))
    kept = F.count(F.when(~F.col("rejected"), 1))
    s = f.groupBy("project_id", "night").agg(F.count("*").alias("frames"), kept.alias("kept"), F.count("fault").alias("faults"), (F.max("second") - F.min("second")).alias("span"), F.round(upper_median("hfr"), 6).alias("median_hfr"))
    g = T.gaps(f, ["project_id", "night"]).groupBy("project_id", "night").agg(F.count("*").alias("gaps"))
    return s.join(g, ["project_id", "night"], "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
