"""Queries that run as streams: the events table, dealt over files out of order, with changes that are corrected later."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators import graph
from palimpsest.plans.history import LOG, log
from palimpsest.streaming import states

QUERIES, ORACLES = {}, {}


def streamed_states(spark, sf_dir):
    """The state of each user in the end. Every tenth event comes as a DROP first, and as what it is in a second run, which goes on
    from the state of the first."""
    folder = f"{graph.checkpoint_folder(spark)}/states-{uuid.uuid4().hex}"
    own = log(spark, sf_dir).select("key", "seq", "idx", "op", "attr")
    wrong = F.col("idx") % 10 == 3
    first = own.withColumn("op", F.when(wrong, "DROP").otherwise(F.col("op"))).withColumn("rev", F.lit(0))
    for rows in (first, own.where(wrong).withColumn("rev", F.lit(1))):
        # events of all times in each file, so most come late
        rows.repartition(4, "idx").write.mode("append").parquet(f"{folder}/changes")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/changes")
        states.run_into(states.object_states(stream), f"{folder}/told", f"{folder}/state")
    found = states.latest(spark.read.parquet(f"{folder}/told"))
    text = F.array_join(F.transform("attributes", lambda a: F.concat_ws(":", a["attr"], a["idx"].cast("string"))), ",")
    return found.select("key", "last_op", "made_idx", "n_live", text.alias("attributes"))


QUERIES["streamed_states"] = streamed_states
ORACLES["streamed_states"] = (
    LOG
    + """, last AS (SELECT key, attr, arg_max(idx, n) AS idx FROM alive WHERE living AND op = 'ALTER' AND attr IS NOT NULL GROUP BY key, attr)
SELECT CAST(key AS VARCHAR) AS key, arg_max(op, n) AS last_op, arg_max(idx, n) FILTER (living AND op = 'CREATE') AS made_idx, count(*) FILTER (living) AS n_live,
  coalesce((SELECT string_agg(attr || ':' || idx, ',' ORDER BY attr) FROM last l WHERE l.key = alive.key), '') AS attributes
FROM alive GROUP BY key"""
)
