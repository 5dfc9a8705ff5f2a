"""Change logs as streams.

States are associative aggregates over (seq, idx), so the order of arrival, the split into files and late rows change
nothing: the final state of a stream equals that of the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.changelog import summary


def running_summary(log: DataFrame) -> DataFrame:
    """The summary of each key so far; for update or complete output."""
    return summary(log)


def windowed_counts(log: DataFrame, *, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Changes by operation in windows of event time; rows later than the delay are dropped by the watermark."""
    own = log.withWatermark("seq", delay)
    return own.groupBy(F.window("seq", length).alias("w"), "op").agg(F.count("*").alias("n")).select("w.start", "op", "n")


def deduplicated(log: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Each change once, even if its file arrives twice within the delay."""
    return log.withWatermark("seq", delay).dropDuplicatesWithinWatermark(["key", "seq", "idx", "op"])


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there now, into a memory table of this name, then stop."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
