"""Structured Streaming jobs: feedback, metrics by window, arriving documents, repeated content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.models import labelled_feedback, numbered, refits
from textloom.session import shared_dir


def read_stream(spark: SparkSession, path: str, ts: str | None = None, files: int = 1000) -> DataFrame:
    """A Parquet table as a stream; ``ts`` becomes a timestamp with a zone, as watermarks need."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # the source takes a single file by a pattern only
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")) if ts else rows


def run(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], name: str = "stream", progress: str | None = None) -> None:
    """Run a stream over what there is, batch by batch, to its end; from where ``progress`` is, if given."""
    folder = progress or shared_dir(stream.sparkSession, f"{name}-progress")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def to_table(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Run a stream into Parquet: appended, or the last complete result. In append mode a window is written once, when the watermark has passed it."""
    folder = shared_dir(stream.sparkSession, name)
    schema = stream.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{'all' if mode == 'complete' else batch}")

    run(stream, mode, write, name)
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def daily_detections(events: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Tumbling days: detections and their summed value."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("detections"), F.approx_count_distinct("user_id").alias("documents")).select(F.col("window.start").alias("day"), "detections", "documents")


def weekly_detections(events: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Sliding weeks that begin every day."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "7 days", "1 day")).agg(F.count("*").alias("detections")).select(F.col("window.start").alias("start"), "detections")


def first_seen(rows: DataFrame, ts: str, content: str, ttl: str = "7 days") -> DataFrame:
    """Rows whose content has not been seen within ``ttl``."""
    return rows.withWatermark(ts, ttl).withColumn("hash", F.sha2(F.col(content), 256)).dropDuplicatesWithinWatermark(["hash"])


def running_feedback(feedback: DataFrame, key: str) -> DataFrame:
    """Running counts by key for update mode: buffer size, dismissal rate, accuracy; a row for each key that a batch has changed."""
    n = F.count("*")
    rates = F.count_if(F.col("user_action") == "dismissed") / n, F.count_if(F.coalesce("was_correct", F.lit(False))) / n
    return feedback.groupBy(key).agg(n.alias("size"), rates[0].alias("dismissal_rate"), rates[1].alias("accuracy"))


def recalibrate(feedback: DataFrame, folder: str, needed: int = 100, order: tuple[str, ...] = ("feedback_date", "feedback_id")) -> None:
    """Collect feedback (``user_action``, ``confidence``, ``order`` columns) and refit after every ``needed`` valid rows.

    A batch joins the rows that the last ones have left (fewer than ``needed``) with its own;
    every full generation of them is fitted (``models.refits``), and the rest is left for the
    next batch: the buffer is cleared with each generation, and no batch is read twice.
    Places in the order are counted by parts, so no task has a whole batch.
    Results are below ``folder/models``, the rest of each batch below ``folder/buffer``.
    """

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        own = labelled_feedback(rows).filter("is_valid").select("user_action", "confidence", "was_correct", *order)
        if batch:
            own = own.unionByName(spark.read.schema(own.schema).parquet(f"{folder}/buffer/batch={batch - 1}"))
        held = numbered(own.withColumn("all", F.lit(0)), list(order))
        full = held.count() // needed * needed
        done = held.filter(F.col("_place") < full)
        refits(done, list(order), "all", needed, place="_place").drop("all").withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/models/part={batch}")
        held.filter(F.col("_place") >= full).drop("all", "_place").write.mode("overwrite").parquet(f"{folder}/buffer/batch={batch}")

    run(feedback, "append", each, "recalibrate")


def analyse_arrivals(documents: DataFrame, analyse: Callable[[DataFrame], DataFrame], folder: str, key: str = "doc_id", text: str = "text", least: int = 1) -> None:
    """Analyse documents as they come; results, and each document's way from ``processing`` to ``completed`` or ``failed``, are written.

    A document whose text is null or shorter than ``least`` fails with a reason and is not analysed.
    """

    def each(rows: DataFrame, batch: int) -> None:
        good = F.coalesce(F.length(text), F.lit(0)) >= least
        now = lambda status, reason: rows.select(key, status.alias("status"), reason.alias("reason"))
        none = F.lit(None).cast("string")
        now(F.lit("processing"), none).write.mode("overwrite").parquet(f"{folder}/status/batch={batch}/step=1")
        analyse(rows.filter(good)).write.mode("overwrite").parquet(f"{folder}/results/batch={batch}")
        now(F.when(good, "completed").otherwise("failed"), F.when(~good, "no_text")).write.mode("overwrite").parquet(f"{folder}/status/batch={batch}/step=2")

    run(documents, "append", each, "arrivals")
