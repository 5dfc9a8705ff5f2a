"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words that the mix may take are cut into equal blocks of tokens. Blocks are seats: they go to the sources by highest
quotients of their targets, then within a source to its shards by highest quotients of their sizes, so every shard has an
integer quota. In a shard, documents lie in seeded order on a circle of words, and the shard's quota
is a run of blocks from a seeded start, so a document is taken whole, in part or several times as blocks cover it.

Scale: what a task holds is one shard's (doc_id, size) rows. Sources and shards are rows of any number: divisors come from
grouped sums, and the few seats that a divisor leaves open are numbered in ranges of their quotients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import n_words, numbered, packed, sieved, unpacked, written

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Divisors that are tried around the one at which votes add up to seats.
TRIED = sorted({2.0**-j for j in (1, 2, 4, 8, 16, 32)} | {1 + s * 2.0**-j for s in (-1, 1) for j in (2, 4, 7, 10, 14, 20)} | {1.0, 2.0})


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size, target, no (from 1 on) of sizes(source, source_size).

    Sources by code point, null last, weigh 5, 2, 1, repeating, and share all words by weight; a target stops at most
    times its source's size, and the excess is shared by weight among the others: all targets are weight * level, where
    the level is the one at which they sum to all words. Each round of two sums stops those that the level lifts above their
    size, until none is; what comes to the driver is the two sums.
    """
    ordered = numbered(sizes, [], [F.col("source").isNull(), F.col("source")], "no")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("no") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = written(ordered.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "mix-weights")
    words, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, stopped = (words / weights if weights else None), -1
    while level is not None:
        over = F.col("cap") <= level * F.col("weight")
        n, cap, free = weighed.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped:
            break
        stopped, level = n, ((words - cap) / free if free else None)
    target = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"), "no")


def dealt(leaves: DataFrame, root: DataFrame) -> DataFrame:
    """owner, no, quota: the seats of root(owner, quota) dealt to each owner's leaves(owner, no, votes, cap) by highest quotients
    votes / (2 k - 1), none above its cap; ties go to the first number. Quotients are compared as doubles.

    A divisor at which votes, but for those of parties that reach their caps, add up to the seats is found by a few rounds of
    grouped sums; two of the divisors beside it, of which one deals too few seats and one enough, are found by one more. The
    seats that lie between these two are rows, numbered by their quotients in ranges, and the first of them are dealt.
    """
    own = leaves.select("owner", "no", F.col("votes").cast("double").alias("votes"), F.col("cap").cast("long").alias("cap"))
    own = written(own.where("votes > 0 and cap > 0"), "mix-parties")
    seats = F.least(F.first("quota"), F.sum("cap")).alias("seats")
    each = own.join(root, "owner").groupBy("owner").agg(seats, F.sum("votes").alias("votes"), F.lit(-1).cast("long").alias("full"))
    state = written(each.where("seats > 0").select("owner", "seats", (F.col("votes") / F.col("seats")).alias("divisor"), "full"), "mix-divisors")
    while True:
        full = F.col("votes") / F.col("divisor") >= F.col("cap")
        sums = own.join(state, "owner").groupBy("owner", "seats", "divisor", F.col("full").alias("before")).agg(
            F.count_if(full).alias("full"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(~full, F.col("votes"))), F.lit(0.0)).alias("free")
        )
        left = F.col("seats") - F.col("capped")
        moves = (left > 0) & (F.col("free") > 0)
        state = written(sums.select("owner", "seats", F.when(moves, F.col("free") / left).otherwise(F.col("divisor")).alias("divisor"), "full", "before"), "mix-divisors")
        settled = state.where("full != before").isEmpty()
        state = state.drop("before")
        if settled:
            break
    won = lambda d: F.least(F.col("cap"), F.floor(F.col("votes") / d + 0.5))
    met = own.join(state.drop("full"), "owner")
    sums = met.groupBy("owner", "seats", "divisor").agg(F.sum("cap").alias("all"), *[F.sum(won(F.col("divisor") * f)).alias(f"s{i}") for i, f in enumerate(TRIED)])
    # factors rise, so seats fall: the last that deals enough, the first that deals no more than there are
    enough = F.lit(0.0)
    few, dealt_few = F.lit(None).cast("double"), F.lit(0).cast("long")
    for i, f in enumerate(TRIED):
        enough = F.when(F.col(f"s{i}") >= F.col("seats"), F.lit(f)).otherwise(enough)
    for i, f in reversed(list(enumerate(TRIED))):
        fits = F.col(f"s{i}") <= F.col("seats")
        few, dealt_few = F.when(fits, F.lit(f)).otherwise(few), F.when(fits, F.col(f"s{i}")).otherwise(dealt_few)
    bounds = written(sums.select("owner", (F.col("seats") - dealt_few).alias("open"), (F.col("divisor") * few).alias("high"), (F.col("divisor") * enough).alias("low")), "mix-bounds")
    placed = own.join(bounds, "owner").select(
        "owner", "no", "votes", "open",
        F.when(F.col("high").isNull(), 0).otherwise(won(F.col("high"))).cast("long").alias("sure"),
        F.when(F.col("low") == 0, F.col("cap")).otherwise(won(F.col("low"))).cast("long").alias("most"),
    )
    placed = written(placed, "mix-sure")
    between = placed.where("open > 0 and most > sure").select("owner", "no", "votes", "open", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("k"))
    between = between.withColumn("quotient", F.col("votes") / (2 * F.col("k") - 1))
    ranked = numbered(between, ["owner"], [F.col("quotient").desc(), F.col("no")], "rank")
    more = ranked.where("rank <= open").groupBy("owner", "no").agg(F.count("*").alias("more"))
    quota = placed.join(more, ["owner", "no"], "left").select("owner", "no", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))
    every = leaves.select("owner", "no").join(quota, ["owner", "no"], "left")
    return written(every.select("owner", "no", F.coalesce("quota", F.lit(0)).cast("long").alias("quota")), "mix-quotas")


def seeded(seed: int, *columns: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _laid_out(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = 16,
    shard_words: int = 500_000,
    most: int = 3,
    seed: int = 7,
) -> DataFrame:
    """mix() with the source and repeat, the number of the row among those that share doc_id, source and text."""
    sized = docs.select(
        docs[f"`{doc_id}`"].cast("long").alias("doc_id"),
        docs[f"`{source}`"].alias("source"),
        n_words(docs[f"`{text}`"]).alias("size"),
        F.xxhash64(docs[f"`{text}`"]).alias("text_key"),
    )
    sized = numbered(sized, ["doc_id", "source", "text_key"], [F.col("size")], "repeat")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")
    targets = source_targets(sizes, most).withColumn("shards", shards).withColumn("source_no", F.col("no") - 1).drop("no")
    targets = written(targets, "mix-targets")

    # a row for each source joins the documents: broadcast only if Spark finds it small
    t = targets.withColumnRenamed("source", "t_source")
    placed = sized.join(t, sized["source"].eqNullSafe(t["t_source"]))
    # rows that repeat go to shards of their own
    placed = placed.withColumn("shard", F.pmod(F.pmod(seeded(seed, "doc_id", "text_key"), F.col("shards")) + F.col("repeat") - 1, F.col("shards")))
    placed = placed.select("doc_id", "source", "size", "text_key", "repeat", "source_no", "shard", "source_size", "target")
    by_shard = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("words"))
    by_shard = written(by_shard.withColumn("cap", F.floor(most * F.col("words") / block)), "mix-shards")

    one = F.lit(0).cast("long").alias("owner")
    caps = by_shard.groupBy("source_no").agg(F.sum("cap").alias("cap"))
    parties = targets.join(caps, "source_no").select(one, F.col("source_no").alias("no"), F.col("target").alias("votes"), "cap")
    root = targets.agg(F.floor(F.coalesce(F.sum("source_size"), F.lit(0)) / block).cast("long").alias("quota"))
    of_source = dealt(parties, root.select(one, "quota")).select(F.col("no").alias("owner"), "quota")
    leaves = by_shard.select(F.col("source_no").alias("owner"), F.col("shard").alias("no"), F.col("words").alias("votes"), "cap")
    of_shard = dealt(leaves, of_source).select(F.col("owner").alias("source_no"), F.col("no").alias("shard"), "quota")
    per_shard = by_shard.join(of_shard, ["source_no", "shard"]).select("source_no", "shard", "words", "quota")

    # rows without words lie on no line
    empty, placed = placed.where("size = 0"), placed.where("size > 0")
    line = Window.partitionBy("source_no", "shard").orderBy(
        seeded(seed + 1, "doc_id").asc(), F.col("doc_id").asc(), F.col("text_key").asc(), F.col("repeat").asc()
    )
    laid = placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(per_shard, ["source_no", "shard"])
    begin = F.col("end") - F.col("size")
    # the run begins at a seeded block and goes round the circle of the shard's words
    start = F.pmod(seeded(seed + 2, "source_no", "shard"), F.greatest(F.floor(F.col("words") / block), F.lit(1))) * block
    length, words = F.col("quota") * block, F.greatest(F.col("words"), F.lit(1))
    whole, rest = F.floor(length / words), F.pmod(length, words)

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(begin, a))

    stop = start + rest
    wrapped = overlap(F.lit(0), stop - words)  # nothing where the run doesn't pass the end of the line
    taken = whole * F.col("size") + overlap(start, F.least(stop, words)) + wrapped

    def part(a: Column, b: Column) -> Column:
        first = F.greatest(F.lit(0), a - begin).cast("long")
        return F.struct(first.alias("first"), (first + overlap(a, b)).cast("long").alias("past"))

    # the head comes from the run's end beyond the line, the tail from its beginning
    parts = F.filter(
        F.array(part(F.lit(0), stop - words), part(start, F.least(stop, words))), lambda x: x["past"] > x["first"]
    )
    names = ["doc_id", "size", "source_size", "target", "taken", "text_key", "parts", "source", "repeat"]
    laid = laid.withColumn("taken", taken.cast("long")).withColumn("parts", parts).select(*names)
    none = F.array().cast("array<struct<first: bigint, past: bigint>>")
    return laid.unionByName(empty.withColumn("taken", F.lit(0).cast("long")).withColumn("parts", none).select(*names))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, text_key (a hash of the text), parts of each row of docs.

    size is the words of the text; null and empty texts have 0 and take 0. taken counts repeats and is at most `most`
    times the size. parts are the ranges (first, past), counted in words of the text from 0, that the blocks of the last,
    incomplete time cover: at most two, in the order of the text; what is taken beyond them is whole times. A source's
    taken words differ from its target by about a block for each shard at most. Rows without a source are one source. A
    shard holds about shard_words words, or one very long text. Rows are neither merged nor dropped: rows that repeat a doc_id are laid beside each other,
    rows with a null doc_id come first in their shard's order. An empty table gives no rows. The same rows and seed give
    the same mix, whatever the partitions. Only the named columns are read.
    """
    return _laid_out(docs, **options).drop("source", "repeat")


def mixed_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The rows of docs that the mix takes: a row for each whole time, and one for each range of words of a part.

    The text of a range is its words with the white space between them. An n_chars column, if there is one, follows the text of
    rows that are cut; all other columns are as they are, whatever their names. Rows that take nothing go, so those with
    null and empty texts do. Rows of equal doc_id, source and text are dealt what they take one by one, whichever of them
    comes first; rows without a doc_id, or without a source, are told apart by the rest. An empty table stays empty.
    """
    size, zero = F.col("size"), F.lit(0).cast("long")
    took = _laid_out(docs, doc_id=doc_id, text=text, source=source, **options).where("taken > 0")
    taking = lambda a, b: F.struct(a.alias("first"), b.alias("past"))
    in_parts = F.aggregate("parts", zero, lambda n, x: n + x["past"] - x["first"])
    times = F.floor((F.col("taken") - in_parts) / size).cast("int")
    took = took.withColumn("takes", F.concat(F.array_repeat(taking(zero, size), times), "parts"))

    def keys(i: Column, s: Column, k: Column) -> dict[str, Column]:
        return {"id": F.coalesce(i, zero), "no_id": i.isNull(), "s": F.coalesce(s, F.lit("")), "no_s": s.isNull(), "text_key": k}

    same = ["id", "no_id", "s", "no_s", "text_key"]
    took = took.select(*[c.alias(n) for n, c in keys(F.col("doc_id"), F.col("source").cast("string"), F.col("text_key")).items()], "repeat", "size", "takes")
    # rows that are alike differ by what they take only; no row of a key may take nothing while a later one takes something
    took = numbered(took, same, [F.col("repeat")], "no").drop("repeat")
    text_of, id_of, source_of = (docs[f"`{c}`"] for c in (text, doc_id, source))
    own = packed(docs, **keys(id_of.cast("long"), source_of.cast("string"), F.xxhash64(text_of)))
    # most rows are alike to none, and need no number; the sieve may mark some of these, never too few
    again = took.where("no > 1").select(F.xxhash64(*same).alias("k")).distinct()
    marked = sieved(own, F.xxhash64(*same), again, F.col("k"), "may")
    alone = marked.where("not may").drop("may").join(took.where("no = 1").drop("no"), same)
    several = numbered(marked.where("may").drop("may"), same, [F.col("text_key")], "no").join(took, [*same, "no"]).drop("no")
    rows = alone.unionByName(several).withColumn("take", F.explode("takes"))
    first, past = F.col("take")["first"], F.col("take")["past"]
    part, whole = past - first < F.col("size"), F.col("row")[text]
    # each piece is a word with the white space before it
    pieces = F.split(whole, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    cut = F.array_join(F.slice(pieces, (first + 1).cast("int"), (past - first).cast("int")), "")
    cut = F.when(first > 0, F.regexp_replace(cut, r"^[\x20\x09-\x0D]+", "")).otherwise(cut)
    out = rows.withColumn("cut", F.when(part, cut).otherwise(whole))
    row = F.col("row").withField(f"`{text}`", F.col("cut"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(part, F.char_length("cut").cast("long")).otherwise(F.col("row.n_chars")))
    return unpacked(out.select(row.alias("row")))
