"""The ledger as a stream: tumbling and trailing sums with a watermark for late events, and events that are delivered again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How late an event may come.
LATE = "1 day"


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events (as parse_ledger gives them) that are whole and have a time; a stream gets its watermark."""
    rows = events.where("not corrupt and time is not null")
    return rows.withWatermark("time", late) if rows.isStreaming else rows


def once(events: DataFrame) -> DataFrame:
    """timed() events without those that are delivered again, as long as the watermark lets them come at all; an event is known by event_id.

    Events without an id are known by what they say.
    """
    told = [c for c in ("event_id", "ts", "repo_id", "query", "count", "returned_tokens", "baseline_tokens_upper", "saved_tokens_upper") if c in events.columns]
    rows = events.withColumn("_event", F.coalesce("event_id", F.sha2(F.to_json(F.struct(*told)), 256)))
    return (rows.dropDuplicatesWithinWatermark(["_event"]) if rows.isStreaming else rows.dropDuplicates(["_event"])).drop("_event")


def _sums(rows: DataFrame, window: Column) -> DataFrame:
    if rows.isStreaming and "spark.watermarkDelayMs" not in rows.schema["time"].metadata:
        rows = rows.withWatermark("time", LATE)
    sums = [F.sum(c).alias(c) for c in ("returned_tokens", "baseline_tokens_upper", "saved_tokens_upper")]
    return rows.groupBy(window.alias("w")).agg(F.count("*").alias("queries"), *sums).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "queries", "returned_tokens", "baseline_tokens_upper", "saved_tokens_upper")


def windowed(events: DataFrame, every: str = "7 days") -> DataFrame:
    """Sums of timed() events in windows that follow each other; a stream without a watermark gets one."""
    return _sums(events, F.window("time", every))


def trailing(events: DataFrame, days: int, every: str = "1 day") -> DataFrame:
    """Sums of timed() events over the last days before each moment, a step of every apart: windows that overlap. State holds those that are open."""
    return _sums(events, F.window("time", f"{days} days", every))


def append_windows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append windows to Parquet files once the watermark has passed them; each is written once, and events that come later still are left out."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def closed_windows(stream: DataFrame, path: str) -> DataFrame:
    """Process all that is there, with results and checkpoint below path, and read the windows that are closed."""
    append_windows(stream, f"{path}/windows", f"{path}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/windows")


def all_windows(stream: DataFrame, path: str) -> DataFrame:
    """Process all that is there and read all windows, open ones too: each batch writes the whole result to a folder of its own below path, of which the last counts."""
    done: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        done.append(batch)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch={done[-1]}") if done else stream.sparkSession.createDataFrame([], stream.schema)
