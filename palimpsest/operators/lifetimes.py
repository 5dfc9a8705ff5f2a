"""Objects and dependencies that hold for a time: lives between CREATE and DROP, and what a cascading DROP takes along.

A cascade is reachability through time: from a DROP at a moment, along the edges that hold at that moment, to the lives that
end with it. Each round joins the lives found last with the edges, on the node and by the interval; only what is new goes into
the next round, which is written to the checkpoint folder. So there are as many rounds as the longest chain, and no pairs of nodes
are made but those that a cascade connects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import slices
from palimpsest.operators.graph import cut


def lives(changes: DataFrame) -> DataFrame:
    """node, made, ended of changes(node, at, op): each CREATE begins a life, which the node's next CREATE or DROP ends (null: none
    does). Other operations, and DROPs of what is not there, change nothing. `at` is a number or a time, or anything that can be
    ordered; of the first two, a node's changes are windowed in slices. Changes of a node at one moment are taken as one, a CREATE
    if there is one."""
    own = changes.where("op in ('CREATE', 'DROP') and node is not null and at is not null")
    own = own.groupBy("node", "at").agg(F.bool_or(F.col("op") == "CREATE").alias("makes"))
    cut_ = slices.sliced(own, "at")
    later = slices.across(["node"]).rowsBetween(1, Window.unboundedFollowing)
    begins = slices.carried(cut_, ["node"], {"__begin": F.min("at")}, {"__next": F.first("__begin").over(later)})
    following = F.coalesce(F.lead("at").over(slices.within(["node"]).orderBy("at")), F.col("__next"))
    return begins.withColumn("ended", following).where("makes").select("node", F.col("at").alias("made"), "ended")


def held(edges: DataFrame, lives: DataFrame) -> DataFrame:
    """src, made, dst, since, until of edges(src, dst, since[, until]): an edge belongs to the life of src in which it began, and
    holds until that ends, or until the edge's own end if that comes first. An edge that began in no life of src, or without one of
    its ends, is none."""
    own = edges if "until" in edges.columns else edges.withColumn("until", F.lit(None).cast(edges.schema["since"].dataType))
    life = lives.select(F.col("node").alias("src"), "made", "ended")
    inside = (F.col("since") >= F.col("made")) & (F.col("ended").isNull() | (F.col("since") < F.col("ended")))
    met = own.where("dst is not null").join(life, "src").where(inside)
    return met.select("src", "made", "dst", "since", F.least("until", "ended").alias("until")).distinct()


def cascades(holding: DataFrame, drops: DataFrame) -> DataFrame:
    """node, made, at: the lives that cascading DROPs end beside the dropped object's own, each with the first moment of these.

    holding(src, made, dst, since, until) is held(); drops(node, at) are the DROPs that cascade. A DROP takes the lives whose edges
    to it began before and have not ended, and what depends on these at that moment. Cycles and chains of any length are followed;
    a dropped object that nothing depends on, or that nothing made, takes nothing along.
    """
    edges = cut(holding)
    at = drops.where("node is not null and at is not null").select("node", "at").distinct()
    frontier, found = at, None
    while True:
        met = edges.join(frontier.withColumnRenamed("node", "dst"), "dst")
        met = met.where((F.col("since") < F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
        reached = met.select(F.col("src").alias("node"), "made", "at").distinct()
        new = cut(reached if found is None else reached.join(found, ["node", "made", "at"], "left_anti"))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        frontier = new.select("node", "at").distinct()
    found = new if found is None else found
    return found.groupBy("node", "made").agg(F.min("at").alias("at"))
