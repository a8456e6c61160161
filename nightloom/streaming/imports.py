"""Streams of arriving frames: dedup by identity, live sessions, noon-to-noon totals."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from nightloom.sources.fits import _store, cards, fields


def timed(frames: DataFrame, late: str) -> DataFrame:
    return frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def new_frames(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Frames not seen before by identity within the watermark; older repeats are the catalogue's."""
    return timed(frames, late).dropDuplicatesWithinWatermark(["identity"])


class Catalogue:
    """A catalogue of frames in a folder, to which each micro-batch adds what isn't held: one folder a stream and batch.

    A batch is compared with all other batches and replaces what it wrote itself, so a batch that is run again after a failure adds nothing. Streams go by the id in their checkpoint: one that begins anew with
    another checkpoint counts its batches from 0 again without replacing what the first one added. Frames with a blank identity can't be told from others and are always added.
    """

    def __init__(self, path: str):
        self.path, self.stream = path, "none"  # the stream whose batches merge is given

    def begin(self, held: DataFrame) -> None:
        """The catalogue as it is before any batch."""
        held.write.mode("overwrite").parquet(f"{self.path}/stream=none/batch=-1")

    def read(self, spark: SparkSession) -> DataFrame:
        """All frames, with the batch and the stream that added them; batch -1 is what it began with."""
        return spark.read.parquet(self.path).withColumns({"batch": F.col("batch").cast("long"), "stream": F.col("stream").cast("string")})

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        own = (F.col("batch") == batch_id) & (F.col("stream") == self.stream)
        others = self.read(batch.sparkSession).where(~own & (F.col("identity") != "")).select("identity").distinct()
        named = batch.where("identity <> ''").dropDuplicates(["identity"]).join(others, "identity", "left_anti")
        added = named.unionByName(batch.where("identity is null or identity = ''"))
        added.write.mode("overwrite").parquet(f"{self.path}/stream={self.stream}/batch={batch_id}")

    def _run(self, stream: DataFrame, state: str, frames) -> None:
        """Merge frames(batch) of each batch of what there is."""

        def put(batch, batch_id):
            store, at = _store(state)
            with store.open_input_stream(f"{at}/metadata") as f:
                self.stream = json.loads(f.read())["id"]
            self.merge(frames(batch), batch_id)

        stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    def import_headers(self, headers: DataFrame, state: str) -> None:
        """Run a stream of headers(path, header) over what there is: each file once by its path, with the fields of its header. A file that comes again, changed or not, adds nothing."""
        self._run(headers, state, lambda b: fields(cards(b, "path", "header"), "path").withColumn("identity", F.col("path")))

    def import_stream(self, frames: DataFrame, state: str, late: str = "10 minutes") -> None:
        """Run a stream over what there is. Repeats within the watermark go by the stream's own state, older ones by the catalogue."""
        self._run(new_frames(frames, late), state, lambda b: b)


def live_sessions(frames: DataFrame, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """project_id, start, end, frames, exposure of runs without a break longer than gap."""
    s = timed(frames, late).groupBy("project_id", F.session_window("ts", gap)).agg(F.count("*").alias("frames"), F.sum("exptime").alias("exposure"))
    return s.select("project_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames", "exposure")


def night_totals(frames: DataFrame, late: str = "1 hour") -> DataFrame:
    """night, frames, kept, integration by windows from noon to noon."""
    kept = F.when(~F.col("rejected"), 1)
    n = timed(frames, late).groupBy(F.window("ts", "24 hours", startTime="12 hours")).agg(F.count("*").alias("frames"), F.count(kept).alias("kept"), F.sum(F.when(~F.col("rejected"), F.col("exptime"))).alias("integration"))
    return n.select(F.to_date("window.start").alias("night"), "frames", "kept", "integration")


class Ledger(StreamingQueryListener):
    """Writes the observed metrics of each batch of a query to a file of that batch in a folder, so a batch that is run again replaces its own."""

    def __init__(self, name: str, folder: str):
        self.name, self.folder, self.ended, self.run = name, folder, threading.Event(), None

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self.name and p.observedMetrics:
            seen = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items()}
            store, at = _store(self.folder)
            store.create_dir(at)
            with store.open_output_stream(f"{at}/{p.batchId}.json") as f:
                f.write(json.dumps(seen).encode())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.run is not None and event.runId == self.run:
            self.ended.set()


def counted_night_totals(frames: DataFrame, folder: str, late: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Run night_totals over what there is. Returns the closed nights of all runs in a folder, and a row of where its frames went: sent, untimed (null ts, in no night), closed (in closed nights), open (in
    nights still held as state) and late (dropped, since their night was closed already).

    Spark counts what an aggregation drops only after rows have been summed by night within a task; so arrivals and closed nights are observed batch by batch, open nights are read from the state,
    and late is what is left.
    """
    spark = frames.sparkSession
    sent = frames.observe("arrived", F.count("*").alias("sent"), F.count(F.when(F.col("ts").isNull(), 1)).alias("untimed"))
    nights = night_totals(sent, late).observe("closed", F.coalesce(F.sum("frames"), F.lit(0)).alias("closed"))
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    ledger = Ledger(name, f"{folder}/ledger")
    spark.streams.addListener(ledger)
    try:
        totals = drained(nights, folder, name=name)
        if not ledger.ended.wait(120):
            raise TimeoutError("the stream's last events did not arrive")
    finally:
        spark.streams.removeListener(ledger)
    seen = spark.read.schema("sent long, untimed long, closed long").json(f"{folder}/ledger")
    seen = seen.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sent", "untimed", "closed")])
    # The state's fields are named by their functions, both counts alike; of a night, all frames are the larger one.
    held = spark.read.format("statestore").load(f"{folder}/state").select(F.col("value").cast("struct<a: long, b: long, c: double>").alias("v")).select(F.greatest("v.a", "v.b").alias("frames"))
    went = seen.crossJoin(held.agg(F.coalesce(F.sum("frames"), F.lit(0)).alias("open")))  # a row each
    return totals, went.withColumn("late", F.col("sent") - F.col("untimed") - F.col("closed") - F.col("open"))


def drained(stream: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Run a stream over what there is, into Parquet, and read that back."""
    out = stream.writeStream.queryName(name) if name else stream.writeStream
    q = out.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
