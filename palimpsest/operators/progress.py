"""Counters of a run: rows, bytes and failures of each stage, counted by the stages' own tasks while they run.

A stage is observed, not computed twice: Spark adds the counts of its finished tasks up and hands one row to the driver at the end of
the action, or at the end of each batch of a stream. Nothing grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTERS = ("n_rows", "n_bytes", "n_failed")
SCHEMA = "stage string, n_rows long, n_bytes long, n_failed long"


def _counters(size: Column | None, failed: Column | None) -> list[Column]:
    zero = F.lit(0).cast("long")
    size = F.coalesce(F.sum(size.cast("long")), zero) if size is not None else F.max(zero)
    wrong = F.count_if(F.coalesce(failed, F.lit(False))) if failed is not None else F.max(zero)
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(size, zero).alias("n_bytes"), F.coalesce(wrong, zero).alias("n_failed")]


class Run:
    """The stages of one run, in the order in which they are declared."""

    def __init__(self) -> None:
        self.stages: dict[str, Observation] = {}

    def stage(self, df: DataFrame, name: str, *, size: Column | None = None, failed: Column | None = None) -> DataFrame:
        """df, whose rows are counted under a name when an action reads them: size gives a row's bytes, failed says that it is a
        failure (null is none). A name can be used once in a run."""
        if name in self.stages:
            raise ValueError(f"stage {name!r} is there already")
        self.stages[name] = Observation(name)
        return df.observe(self.stages[name], *_counters(size, failed))

    def table(self, spark: SparkSession) -> DataFrame:
        """stage, n_rows, n_bytes, n_failed of the stages; waits until an action has read each of them."""
        found = [(name, seen.get) for name, seen in self.stages.items()]
        return spark.createDataFrame([(name, *(row[c] for c in COUNTERS)) for name, row in found], SCHEMA)


def streamed_stage(df: DataFrame, name: str, *, size: Column | None = None, failed: Column | None = None) -> DataFrame:
    """A stream whose rows are counted under a name in each batch, for a StreamedRun that listens."""
    return df.observe(name, *_counters(size, failed))


class StreamedRun(StreamingQueryListener):
    """Counters of streams, a row for each batch and stage; to be added with spark.streams.addListener()."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.failures: list[str] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for stage, row in event.progress.observedMetrics.items():
            self.rows.append((event.progress.name, event.progress.batchId, stage, *(row[c] for c in COUNTERS)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.failures.append(event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        """query, batch, stage, n_rows, n_bytes, n_failed so far."""
        return spark.createDataFrame(self.rows, "query string, batch long, " + SCHEMA)
