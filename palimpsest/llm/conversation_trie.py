"""The trie of conversations' prefixes: nodes keyed by digests, subtree sums by pointer jumping.

A turn is known by its digest and its length; texts are read once and shuffled nowhere. A prefix's key is the XOR of digests of
(position, turn) over its turns, in two lanes of 64 bits, so the keys of all prefixes of a conversation are running aggregates,
which need no chain of turns: a conversation that holds a third of all turns is windowed in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import numbered, spread_join, written

KEY = ["k1", "k2"]
BLOCK = 100
HEADS = 6


def turns_of(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, digest (of role and text, null as empty), chars (code points of the text) of each turn. Turns without a
    conversation are left out."""
    q = lambda n: conversations[f"`{n}`"]
    r, t = (F.coalesce(q(n).cast("string"), F.lit("")) for n in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256))
    rows = conversations.select(q(conv_id).cast("long").alias("conv_id"), q(turn).alias("turn"), digest.alias("digest"), F.char_length(t).cast("long").alias("chars"))
    return rows.where("conv_id is not null")


def rebuilt_conversations(
    conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block: int = BLOCK, heads: int = HEADS,
) -> DataFrame:
    """conv_id, p, digest, chars: of each conversation c, the first h turns of c - c % block, then its own after the first h, with
    h = crc32(c) % heads. A conversation without turns left has one row, whose p is 0.

    Turns are in the order of `turn`, null first; equal ones in the order of their digests. Null roles and texts are empty; rows
    without a conversation are left out; rows that repeat are a turn each; an empty table gives no rows.
    """
    own = turns_of(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    turns = numbered(own, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"], "p").drop("turn")
    # who lends and borrows: at most heads - 1 turns of a conversation, to at most `block` others
    convs = turns.where("p = 1").select("conv_id")
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    convs = written(convs, "conversations")
    heads_of = turns.where(F.col("p") < heads).select(F.col("conv_id").alias("base"), "p", "digest", "chars")
    lent = convs.join(heads_of, "base").where("p <= h").select("conv_id", "p", "digest", "chars")
    n_lent = lent.groupBy("conv_id").agg(F.count("*").alias("n"))
    about = convs.join(n_lent, "conv_id", "left").select("conv_id", "h", F.coalesce("n", F.lit(0)).alias("n"))
    kept = spread_join(turns, about, ["conv_id"], F.col("p")).where("p > h")
    kept = kept.select("conv_id", (F.col("p") - F.col("h") + F.col("n")).alias("p"), "digest", "chars")
    both = written(lent.unionByName(kept), "rebuilt")
    none = convs.select("conv_id").join(both.select("conv_id").distinct(), "conv_id", "left_anti")
    return both.unionByName(none.select("conv_id", F.lit(0).cast("long").alias("p"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")))


def _prefixes(turns: DataFrame, span: int) -> DataFrame:
    """conv_id, depth, k1, k2, u1, u2, chars, n_turns: of each conversation its prefixes of 0 to all turns, with their keys and
    those of the prefixes that are one turn shorter. The running XOR goes by slices of `span` turns."""
    lane = lambda seed: F.xxhash64(F.lit(seed), "p", "digest")
    own = turns.where("p > 0").withColumn("slice", F.floor(F.col("p") / span)).select("conv_id", "p", "chars", "slice", lane("k1").alias("x1"), lane("k2").alias("x2"))
    sums = own.groupBy("conv_id", "slice").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.max("p").alias("last"))
    by_conv = Window.partitionBy("conv_id").orderBy("slice")
    earlier = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv_id", "slice",
        *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)],
        F.max("last").over(Window.partitionBy("conv_id")).alias("n_turns"),
    )
    run = Window.partitionBy("conv_id", "slice").orderBy("p")
    keyed = own.join(sums, ["conv_id", "slice"])
    for i in (1, 2):
        keyed = keyed.withColumn(f"k{i}", F.bit_xor(f"x{i}").over(run).bitwiseXOR(F.col(f"c{i}")))
    up = [F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"u{i}") for i in (1, 2)]
    deep = keyed.select("conv_id", F.col("p").alias("depth"), *KEY, *up, "chars", "n_turns")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    n_turns = turns.groupBy("conv_id").agg(F.max("p").alias("n_turns"))
    top = n_turns.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), null.alias("u1"), null.alias("u2"), zero.alias("chars"), "n_turns")
    return deep.unionByName(top)


def _ends(prefixes: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes at which conversations end. A node's ids are joined to text in ranges, by as many tasks
    as hold them; where there is more than one range, its texts, a row each, are streamed through the hash in order."""
    ids = prefixes.where("depth = n_turns").select("depth", *KEY, "conv_id")
    part = ids.repartitionByRange("depth", *KEY, "conv_id").withColumn("part", F.spark_partition_id())
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = written(part.groupBy("depth", *KEY, "part").agg(text.alias("piece")), "ends")
    sizes = pieces.groupBy("depth", *KEY).agg(F.count("*").alias("n"), F.min("piece").alias("piece"))
    one = sizes.where("n = 1").select("depth", *KEY, F.sha2(F.col("piece").cast("binary"), 256).alias("ends_sha256"))
    many = pieces.join(sizes.where("n > 1").select("depth", *KEY), ["depth", *KEY], "left_semi")
    order = ["depth", *KEY, "part"]
    streamed = many.repartition("depth", *KEY).sortWithinPartitions(*order).select(*order, "piece")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["depth", *KEY, "ends_sha256"]
        row = lambda: pa.RecordBatch.from_arrays([*(pa.array([v]) for v in now), pa.array([state.hexdigest()])], names)
        for batch in batches:
            for i in range(len(batch)):  # a row is a range of ids
                key = tuple(batch.column(n)[i].as_py() for n in names[:3])
                piece = batch.column("piece")[i].as_buffer()
                if key != now:
                    if now is not None:
                        yield row()
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece)
        if now is not None:
            yield row()

    return one.unionByName(streamed.mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string"))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes(depth, k1, k2, u1, u2, …) whose `values` are summed over their subtrees, themselves included, by pointer jumping.

    After round r a node's sums cover what is less than 2**r below it, and its pointer (j1, j2) names its ancestor 2**r above.
    Each node then adds its sums to that ancestor, and takes the ancestor's pointer. So the rounds are the logarithm of the depth,
    and each is one grouped sum, which combines before the shuffle, and two joins; hot ancestors are spread.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    state = written(nodes.select("depth", *KEY, F.col("u1").alias("j1"), F.col("u2").alias("j2"), *values), "jump")
    step = 1
    while deepest is not None and step <= deepest:
        below = state.where("j1 is not null")
        sent = below.groupBy((F.col("depth") - step).alias("depth"), F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(*[F.sum(v).alias(f"__{v}") for v in values])
        added = state.join(sent, ["depth", *KEY], "left")
        added = added.select("depth", *KEY, "j1", "j2", *[(F.col(v) + F.coalesce(F.col(f"__{v}"), F.lit(0))).alias(v) for v in values])
        if 2 * step <= deepest:
            over = state.where(F.col("depth") >= step).select(F.col("depth").alias("at"), F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
            moving = added.where(F.col("depth") >= 2 * step).withColumn("at", F.col("depth") - step)
            moved = spread_join(moving, over, ["at", "j1", "j2"], F.struct(*KEY)).select("depth", *KEY, F.col("n1").alias("j1"), F.col("n2").alias("j2"), *values)
            still = added.where(F.col("depth") < 2 * step).withColumn("j1", F.lit(None).cast("long")).withColumn("j2", F.lit(None).cast("long"))
            added = moved.unionByName(still)
        state = written(added, "jump")
        step *= 2
    return state.select("depth", *KEY, *values)


def prefix_trie(turns: DataFrame, *, span: int = 65536) -> DataFrame:
    """The nodes of the trie of turns(conv_id, p, digest, chars), see rebuilt_conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Each distinct sequence of first turns is a node, the root that of none. Conversations are known by their turns alone, so equal
    ones share all nodes; a row with p = 0 is a conversation without turns, which ends at the root. An empty table has no nodes.
    `span` is how many turns of a conversation a task may window.
    """
    prefixes = written(_prefixes(turns, span), "prefixes")
    first = prefixes.groupBy("depth", *KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("u1").alias("u1"), F.first("u2").alias("u2"), F.first("chars").alias("chars")
    )
    nodes = written(first, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", *KEY], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = written(nodes, "leaves")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    own = nodes.drop("n_leaves", "saved_tokens", "chars").join(sums, ["depth", *KEY]).join(_ends(prefixes), ["depth", *KEY], "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    deep = spread_join(own.where("depth > 0"), parents, ["depth", "u1", "u2"], F.struct(*KEY))
    every = deep.unionByName(own.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    empty = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
