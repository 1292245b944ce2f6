"""The run journal as a stream: appended steps, event-time windows and the latest step of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A journal line.
LINE = "run_id string, index long, ts timestamp, stage string, title string, warnings int"


def read_journal(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Steps as they are appended, one JSON object a line."""
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_per_batch).json(path)


def stage_windows(steps: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Steps and warnings of each stage in windows of event time; what comes later than `late` isn't counted."""
    told = steps.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stage")
    return told.agg(F.count("*").alias("steps"), F.sum("warnings").alias("warnings")).select(F.col("w.start").alias("opens"), "stage", "steps", "warnings")


def stage_sessions(steps: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of steps of one run with less than `gap` between them."""
    told = steps.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "run_id")
    return told.agg(F.count("*").alias("steps")).select("run_id", F.col("w.start").alias("opens"), F.col("w.end").alias("closes"), "steps")


def latest(steps: DataFrame) -> DataFrame:
    """The furthest step of each run."""
    return steps.groupBy("run_id").agg(F.max("index").alias("index"), F.max_by("stage", "index").alias("stage"), F.max_by("title", "index").alias("title"))


def write_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now, exactly once over restarts, and stop."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_steps(steps: DataFrame, path: str) -> None:
    """Steps of runs as lines of the journal, numbered on in each run from what is there; one file for each task."""
    steps.select("run_id", "index", "ts", "stage", "title", "warnings").write.mode("append").json(path)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """All steps of a journal at rest, in no order."""
    return spark.read.schema(LINE).json(path)


#: What happens at a checkpoint of a kind in a mode of running (fixed values).
POLICY = {("gate", "interactive"): "ask", ("gate", "auto"): "pass", ("show", "interactive"): "show", ("show", "auto"): "pass"}


def decided(steps: DataFrame, decisions: DataFrame, mode: str = "interactive") -> DataFrame:
    """steps (run_id, index, kind) with what was decided on each, the last word counting; where nothing was, what the policy says for the mode, and silent for kinds that it doesn't name."""
    last = decisions.groupBy("run_id", "index").agg(F.max_by("decision", "at").alias("decision"))
    policy = F.coalesce(*(F.when(F.col("kind") == kind, said) for (kind, when), said in POLICY.items() if when == mode), F.lit("silent"))
    return steps.join(last, ["run_id", "index"], "left").withColumn("decision", F.coalesce("decision", policy))
