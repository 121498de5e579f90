"""Streaming forms of the line operators, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.text import line_key
from textloom.operators.corpus import LineRules, clean_lines, document_lines
from textloom.sources.scratch import hadoop_path, shared_path


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a Parquet folder's (or file's) rows."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name.endswith(".parquet"):
        # A single file or a folder of that name: the parent is watched for it.
        return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-8]}*.parquet")
    return reader.parquet(path)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """The lines of a stream of documents, each key once; state grows with distinct keys."""
    return document_lines(docs).withColumn("key", line_key(F.col("line"))).dropDuplicates(["key"])


def distinct_lines_within(docs: DataFrame, time: str, delay: str) -> DataFrame:
    """As above, but keys are forgotten after ``delay``: bounded state."""
    lines = docs.withWatermark(time, delay).select("doc_id", time, F.explode(F.split("text", "\n")).alias("line"))
    return lines.withColumn("key", line_key(F.col("line"))).dropDuplicatesWithinWatermark(["key"])


def kept_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Cleaned lines of a stream: the batch operator, unchanged."""
    return clean_lines(document_lines(docs), rules).filter("reason is null").drop("reason")


def event_windows(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """start, event_type, n, total of each tumbling window; late events within ``delay`` count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_windows(events: DataFrame, window: str = "1 day", slide: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """As :func:`event_windows`, for overlapping windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", window, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, user: str = "user_id", gap: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """user, start, end, n: each user's runs of events that are less than ``gap`` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(user, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_end(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything available now, as a batch DataFrame over files in the shared folder.

    Each batch is a folder that a repeated batch replaces; in complete mode the
    last batch is the whole result.
    """
    return _ran(stream, mode, checkpoint)[0]


def _ran(stream: DataFrame, mode: str, checkpoint: str | None) -> tuple[DataFrame, list]:
    spark = stream.sparkSession
    path = shared_path(spark, "stream")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else batch_id}")

    writer = stream.writeStream.foreachBatch(add).outputMode(mode).trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint or shared_path(spark, "stream-state")).start()
    query.awaitTermination()
    folder, files = hadoop_path(spark, path)
    found = spark.read.schema(stream.schema).parquet(f"{path}/batch=*") if files.exists(folder) else spark.createDataFrame([], stream.schema)
    return found, query.recentProgress


def kept_lines_with_progress(docs: DataFrame, rules: LineRules = LineRules(), checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned lines of a stream, and batch, lines_in, kept, keep_rate of each micro-batch, observed on the way."""
    lines = clean_lines(document_lines(docs), rules)
    lines = lines.observe("progress", F.count(F.lit(1)).alias("lines_in"), F.count_if(F.col("reason").isNull()).alias("kept"))
    found, progress = _ran(lines.filter("reason is null").drop("reason"), "append", checkpoint)
    rows = [(p["batchId"], int(p["observedMetrics"]["progress"]["lines_in"]), int(p["observedMetrics"]["progress"]["kept"])) for p in progress if "progress" in p["observedMetrics"]]
    counts = docs.sparkSession.createDataFrame(rows, "batch long, lines_in long, kept long")
    return found, counts.withColumn("keep_rate", 100.0 * F.col("kept") / F.greatest("lines_in", F.lit(1)))


def merge_counts(stream: DataFrame, path: str, checkpoint: str, key: str = "word") -> None:
    """Keep running counts of ``key`` as Parquet: each batch adds a file of partial counts."""

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a repeated batch replaces itself

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_counts(spark: SparkSession, path: str, key: str = "word") -> DataFrame:
    return spark.read.parquet(path).groupBy(key).agg(F.sum("n").alias("n"))
