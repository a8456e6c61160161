"""Tables of the frame domain, derived from the driver's tables (see FIXTURES.md); both SQL dialects run them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE = {"frames": "events", "stars": "lineitem", "pixels": "embeddings", "sky": "orders", "centres": "supplier", "headers": "orders"}

VIEWS = {
    "frames": """SELECT event_id AS frame_id, user_id % 10 AS project_id, event_type AS object, ts,
  CASE user_id % 4 WHEN 0 THEN 'LP' WHEN 1 THEN 'Ha' WHEN 2 THEN 'L-eXtreme' ELSE 'UV/IR cut' END AS filter,
  CAST(CASE WHEN user_id % 3 = 0 THEN 30 ELSE 60 END AS DOUBLE) AS exptime,
  CAST(floor(value * 10) AS BIGINT) % 1000 AS stars,
  CAST(50 + (event_id * 7919) % 300 AS DOUBLE) / 100 AS hfr,
  CAST((event_id * 104729) % 1000 AS DOUBLE) / 1000 AS ecc,
  CAST(20 + (event_id * 31) % 40 AS DOUBLE) / 10000 AS background,
  CAST(1 + (event_id * 17) % 9 AS DOUBLE) / 100000 AS noise,
  CASE WHEN event_id % 50 = 0 THEN 5 ELSE event_id % 3 END AS trails,
  event_id % 20 = 0 AS rejected, event_id % 5 = 0 AS has_wcs,
  CASE WHEN event_id % 200 = 7 THEN 3 ELSE 1 END AS planes,
  CASE WHEN event_id % 300 = 11 THEN 0 ELSE 2160 END AS width,
  3840 AS height, 16588800 + event_id % 4096 AS bytes
FROM events""",
    "stars": """SELECT CAST(floor(l_orderkey / 300) AS BIGINT) AS frame_id,
  ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS star_id,
  CAST((l_partkey * 3701 + l_orderkey * 17) % 108000 AS DOUBLE) / 100 AS x,
  CAST((l_suppkey * 10103 + l_partkey * 13 + l_orderkey) % 192000 AS DOUBLE) / 100 AS y,
  l_extendedprice / 1000 AS flux, l_quantity / 20 AS hfr,
  CAST((l_partkey * 7 + l_linenumber) % 100 AS DOUBLE) / 100 AS ecc,
  l_linenumber * 3 AS pixels, l_returnflag = 'R' AS saturated
FROM lineitem""",
    "pixels": """SELECT vec_id AS frame_id, label AS master_id, CAST(p DIV 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, CAST(e AS DOUBLE) + 0.6D AS v
FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, e""",
    "sky": """SELECT o_orderkey AS source_id,
  CAST((o_orderkey * 1375077) % 3600000 AS DOUBLE) / 10000 AS ra,
  CAST((o_orderkey * 48271) % 1800000 AS DOUBLE) / 10000 - 90 AS dec,
  CAST(600 + (o_orderkey * 13) % 800 AS DOUBLE) / 100 AS g,
  CAST(620 + (o_orderkey * 13) % 800 + o_custkey % 100 AS DOUBLE) / 100 AS bp,
  CAST(580 + (o_orderkey * 13) % 800 AS DOUBLE) / 100 AS rp
FROM orders""",
    "centres": """SELECT s_suppkey AS centre_id, CAST((s_suppkey * 36007) % 3600 AS DOUBLE) / 10 AS ra,
  CAST((s_suppkey * 7919) % 1700 AS DOUBLE) / 10 - 85 AS dec, CAST(5 AS DOUBLE) AS radius
FROM supplier""",
    "headers": """SELECT o_orderkey AS frame_id, concat(
  rpad('SIMPLE  =                    T / conforms', 80, ' '),
  rpad(concat('NAXIS1  = ', lpad(CAST(1000 + o_custkey AS STRING), 20, ' '), ' / width'), 80, ' '),
  rpad('COMMENT   skipped', 80, ' '),
  rpad(concat('OBJECT  = ''O''''', o_orderpriority, '  '' / a / b'), 80, ' '),
  rpad(concat('CDELT   = ', CAST(1 + o_orderkey % 9 AS STRING), '.5D-05 / step'), 80, ' '),
  rpad('END', 80, ' '), rpad('AFTER   =                    1', 80, ' ')) AS header
FROM orders""",
}

DUCK = VIEWS | {
    "pixels": """SELECT vec_id AS frame_id, label AS master_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, CAST(e AS DOUBLE) + CAST(0.6 AS DOUBLE) AS v
FROM (SELECT vec_id, label, unnest(embedding) AS e, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS p FROM embeddings)"""
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCE[name]
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(VIEWS[name].replace(f"FROM {source}", "FROM {source_table}"), source_table=table)


def with_views(*names: str, body: str) -> str:
    """Oracle SQL: the views as common table expressions before a body (which may go on with further ones after a comma)."""
    head = ",\n".join(f"{n} AS ({DUCK[n]})" for n in names)
    return f"WITH {head}\n{body}" if not body.lstrip().startswith(",") else f"WITH {head}{body.lstrip()}"
