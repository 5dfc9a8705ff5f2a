"""Final states of objects as a stream of their changes, with state for each object that outlives a restart.

Changes may come in any order, in any split into files, more than once, and corrected: of changes with one (seq, idx), the one
with the highest rev counts. After every batch the state of each object that it touched equals the fold of all its changes
so far, however late they are: there is no watermark, which would drop late rows before they reach the state.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE = "key string, version long, last_op string, made_idx long, n_live long, attributes array<struct<attr: string, idx: long>>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(changes: list[tuple]) -> dict:
    """The state that changes(at, idx, op, attr) of one object leave: the last operation, the last CREATE after the last DROP, how
    many changes came after that DROP, and the last ALTER of each attribute among them."""
    own = sorted(changes, key=lambda c: (c[0], c[1]))
    dropped = max((i for i, c in enumerate(own) if c[2] == "DROP"), default=-1)
    live = own[dropped + 1 :]
    made = [c[1] for c in live if c[2] == "CREATE"]
    last = {c[3]: c[1] for c in live if c[2] == "ALTER" and c[3] is not None}
    return {
        "last_op": own[-1][2] if own else None, "made_idx": made[-1] if made else None, "n_live": len(live),
        "attributes": [{"attr": a, "idx": i} for a, i in sorted(last.items())],
    }


def _rank(change: tuple) -> tuple:
    """Of changes with one rev, the later by name of operation and attribute counts, so the order of arrival does not."""
    return change[0], change[1] or "", change[2] or ""


class ObjectStates(StatefulProcessor):
    """History of an object by (seq, idx), and how often its state was told. What lies before a DROP is forgotten by the first batch
    with changes of the object that comes a horizon after the DROP did: until then, the DROP itself may be corrected. Timers
    would need a watermark, which drops late rows, or processing time, with which a run over what is there never ends."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getMapState("history", "at long, idx long", "rev long, op string, attr string, came long")
        self.told = handle.getValueState("told", "version long")

    def _changes(self) -> list[tuple]:
        return [(k[0], k[1], v[1], v[2]) for k, v in self.history.iterator()]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now = int(time.time() * 1000)
        for batch in rows:
            for at, idx, rev, op, attr in zip(batch["at"], batch["idx"], batch["rev"], batch["op"], batch["attr"], strict=True):
                place, new = (int(at), int(idx)), (int(rev), None if pd.isna(op) else op, None if pd.isna(attr) else attr)
                old = self.history.getValue(place) if self.history.containsKey(place) else None
                if old is None or _rank(old) < _rank(new):
                    self.history.updateValue(place, (*new, now))
        self._forget(now - self.horizon_ms)
        version = (self.told.get()[0] if self.told.exists() else 0) + 1
        self.told.update((version,))
        yield pd.DataFrame([{"key": key[0], "version": version, **folded(self._changes())}])

    def _forget(self, past: int) -> None:
        changes = [(k[0], k[1], v[1], v[3]) for k, v in self.history.iterator()]
        drops = [(at, idx) for at, idx, op, came in changes if op == "DROP" and came < past]
        for at, idx, *_ in changes:
            if drops and (at, idx) < max(drops):
                self.history.removeKey((at, idx))

    def close(self) -> None:
        pass


def object_states(changes: DataFrame, *, horizon_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """STATE of each object that a batch of the stream changes(key, seq, idx, rev, op, attr) touched. seq is a timestamp, with or without a zone; a null rev is
    0; rows without key, seq or idx are left out. A later version of a key replaces the earlier ones. An object's history since
    its last DROP is read in one task when a batch touches it."""
    own = changes.where("key is not null and seq is not null and idx is not null").select(
        F.col("key").cast("string").alias("key"), F.unix_micros(F.col("seq").cast("timestamp")).alias("at"), F.col("idx").cast("long").alias("idx"),
        F.coalesce("rev", F.lit(0)).cast("long").alias("rev"), "op", "attr",
    )
    return own.groupBy("key").transformWithStateInPandas(ObjectStates(horizon_ms), STATE, "Append", "None")


def run_into(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, added to a Parquet folder; a query that is started again with the same checkpoint goes on where the last
    one ended."""
    conf = states.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        writer = states.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return query


def latest(told: DataFrame) -> DataFrame:
    """The last version of each key's state among told(STATE)."""
    rest = [c for c in told.columns if c != "key"]
    return told.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("key", "s.*")
