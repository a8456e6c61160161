"""What several operators share: reading tables, tables in the shared folder, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.sources.staging import released, trimmed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where none is set and driver and workers are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("nightloom.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="nightloom-")
        spark.conf.set("nightloom.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    released()  # what plans and closures took in the driver's Python
    trimmed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete saved tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def interpreted(spark: SparkSession):
    """For many jobs on tables of some thousand rows: their plans are run as they are, in one part. To compile each and to plan it anew after every exchange takes longer than to run it, and stays in the driver's memory."""
    ways = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k, None) for k in ways}
    for k, v in ways.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@contextlib.contextmanager
def unshuffled(spark: SparkSession):
    """For jobs that write their tables and read them back: what a job shuffled is deleted as it ends, not when the driver next collects its garbage."""
    way = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(way, None)
    spark.conf.set(way, "true")
    try:
        yield
    finally:
        spark.conf.set(way, before) if before is not None else spark.conf.unset(way)


def components(edges: DataFrame, name: str, limit: int = 60) -> DataFrame:
    """Connected components of edges(a, b): (node, comp), comp the smallest node reachable.

    Rounds of minimum over neighbours followed by pointer jumping; each round is a written table, so the
    lineage stays short. Aggregation is partial on the map side, so a node with very many edges costs
    one row per task; nothing is gathered on the driver but a flag.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{name}-edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{name}-0")
    for k in range(1, limit):
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("best"))
        )
        step = labels.join(near, "node").select("node", F.least("comp", "best").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("top"))
        new = saved(
            step.join(jump, step.next == jump.via, "left")
            .select("node", F.least("next", F.coalesce("top", "next")).alias("comp"), "was"),
            f"{name}-{k}",
        )
        moved = new.where("comp <> was").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


SLICE = 4_000_000  # bytes of a batch that are worked on at once


def map_lists(df: DataFrame, made, schema: str) -> DataFrame:
    """mapInArrow for code on plain lists: made(dict of column -> list) returns rows (tuples) in the order of schema.

    Nulls stay None and longs stay exact, which pandas would not grant. A batch is taken in slices of some megabytes, or of one row where that has more, so what is
    in memory at once follows from the longest row, not from the batch.
    """
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kinds)
        for batch in batches:
            step = max(1, min(2048, batch.num_rows * SLICE // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                part = made({n: some.column(k).to_pylist() for k, n in enumerate(some.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], f.type) for k, f in enumerate(out)], schema=out)
        released()

    return df.mapInArrow(run, kinds)
