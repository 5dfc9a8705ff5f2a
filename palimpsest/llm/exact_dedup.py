"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only.

Every document falls into one of many runs. A run holds, for each digest, the identifier to keep and a count, in digest
order. In each round, the runs of one parent are dealt to the parent by digest, merged many ways at once in digest order (a
sort and an aggregate over neighbours, which keeps one entry at a time), and written as runs again, until one root is left;
entries of the root are spread over the cluster by digest, so no task ever holds the root. Then the root's decisions go
back down the same tree to the rows, by merge joins. There are as many rounds as the number of leaf runs asks for.

The tree is also what makes hot groups harmless: of a text with a third of all rows, a leaf run sees only its share, and
each round reads at most ``fan_in`` rows for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, packed, sieved, unpacked, written

#: What identifies a text: SHA-256, verified at each level by length and a second, independent hash.
TEXT = ("digest", "n_bytes", "check")
#: About so many rows make a leaf run.
RUN_ROWS = 1_000_000


def normal_text(text: Column) -> Column:
    """Only A-Z are lower-cased; null counts as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def hashed_rows(docs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """doc_id, digest, n_bytes, check, n: one row for each different (doc_id, text), n counting its repeats."""
    own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), normal_text(docs[f"`{text}`"]).alias("t"))
    hashed = own.select(
        "doc_id",
        F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )
    return hashed.groupBy("doc_id", *TEXT).agg(F.count("*").alias("n"))


def in_runs(rows: DataFrame, runs: int) -> DataFrame:
    """rows with the leaf run that each falls into; a null doc_id has a run by its text."""
    return rows.withColumn("run", F.pmod(F.xxhash64(F.coalesce("doc_id", "check")), F.lit(runs)))


def merged(entries: DataFrame) -> DataFrame:
    """entries(run, text, keep_id, n) of one level merged into one for each text of a run, in the order of run and digest.

    Entries are dealt to their run by digest and sorted; equal ones are neighbours then, and the aggregate runs along that
    order. The greatest identifier is kept with the struct that it stands in, so it is compared as a whole.
    """
    dealt = entries.repartition("run", "digest").sortWithinPartitions("run", *TEXT)
    best = dealt.groupBy("run", *TEXT).agg(F.max(F.struct("keep_id")).alias("best"), F.sum("n").alias("n"))
    return best.select("run", *TEXT, F.col("best.keep_id").alias("keep_id"), "n")


def one_level_up(level: DataFrame, fan_in: int) -> DataFrame:
    """Entries of a level as those of their parents' runs."""
    return level.withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))


def sent_down(parent: DataFrame, child: DataFrame, fan_in: int) -> DataFrame:
    """The parent's decisions (keep_id, n) for those entries of the child level that they concern."""
    p, c = parent.alias("p"), child.select("run", *TEXT).alias("c")
    same = F.floor(F.col("c.run") / fan_in).cast("long") == F.col("p.run")
    for key in TEXT:
        same &= F.col(f"c.{key}") == F.col(f"p.{key}")
    return c.join(p.hint("merge"), same).select("c.run", *[f"c.{key}" for key in TEXT], "p.keep_id", "p.n")


def exact_groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None, fan_in: int = 16
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_rows of each document, dropped ones too.

    Texts are equal if identical after lower-casing A-Z alone; null equals empty. The largest doc_id of a group stays.
    The tree has fan_in ** rounds leaf runs; where rounds is not given, as many rounds as leaf runs of about a million rows
    need, one at least.

    Rows that repeat both doc_id and text are one document: one row comes out, n_rows and group_size count all of them.
    One doc_id with different texts is a document for each text. A null doc_id is smaller than any other: such a row goes if
    its group has a doc_id, and stays (keep_id null) if it has none. An empty table gives no rows. Only the named columns
    are read.
    """
    rows = written(hashed_rows(docs, doc_id=doc_id, text=text), "digest-rows")
    if rounds is None:
        rounds, leaves = 1, rows.count() / RUN_ROWS
        while fan_in**rounds < leaves:
            rounds += 1
    rows = in_runs(rows, fan_in**rounds)
    levels = [written(merged(rows.withColumn("keep_id", F.col("doc_id"))), "digest-run-0")]
    for k in range(rounds):
        levels.append(written(merged(one_level_up(levels[-1], fan_in)), f"digest-run-{k + 1}"))
    # texts of one row need no message
    down = levels[-1].where("n > 1")
    for child in reversed(levels[:-1]):
        down = sent_down(down, child, fan_in)
    r, d = rows.alias("r"), down.alias("d")
    same = F.col("r.run") == F.col("d.run")
    for key in TEXT:
        same &= F.col(f"r.{key}") == F.col(f"d.{key}")
    out = r.join(d, same, "left").select(
        F.col("r.doc_id").alias("doc_id"),
        F.when(F.col("d.n").isNull(), F.col("r.doc_id")).otherwise(F.col("d.keep_id")).alias("keep_id"),
        F.coalesce("d.n", "r.n").alias("group_size"),
        F.lower(F.hex("r.digest")).alias("text_sha256"),
        F.col("r.n").alias("n_rows"),
    )
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "n_rows",
    )


def drop_exact_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **tree) -> DataFrame:
    """docs without the rows that exact_groups drops; of rows that repeat doc_id and text, one stays. Its columns are as they
    are, whatever their names.

    Null counts as the empty text, so of all rows without text one stays. A row with a null doc_id stays only if its group
    has no doc_id. Very long texts are hashed whole. An empty table stays empty.
    """
    found = written(exact_groups(docs, doc_id=doc_id, text=text, **tree).where("not kept or n_rows > 1"), "copies")
    found = found.select(F.col("doc_id").alias("c_id"), F.unhex("text_sha256").alias("c_digest"), F.col("kept").alias("c_kept"))
    digest = F.unhex(F.sha2(F.encode(normal_text(docs[f"`{text}`"]), "UTF-8"), 256))
    rows = packed(docs, id=docs[f"`{doc_id}`"], digest=digest)
    key = lambda i, d: F.struct(i.alias("i"), d.alias("d"))
    rows = sieved(rows, key(F.col("id"), F.col("digest")), found, key(F.col("c_id"), F.col("c_digest")), "may")
    # only rows that may be copies are shuffled to meet the decisions
    match = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest"))
    some = rows.where("may").join(found, match, "left")
    single = some.where("c_kept is null")
    first = some.where("c_kept").dropDuplicates(["id", "digest"])
    return unpacked(reduce(DataFrame.unionByName, [x.select("row") for x in (rows.where("not may"), single, first)]))
