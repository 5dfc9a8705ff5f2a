"""Signatures of definitions: normalised text, hashed lines, fingerprints of whole catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates fields.
SPACE = r"[\t\n\x0B\f\r \x85\xA0]+"


def normalized(text: Column) -> Column:
    """Lower case, a space around ( ) , and ;, white space collapsed, no final semicolon. Null stays null."""
    spaced = reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit(f" {mark} ")), "(),;", F.lower(text))
    flat = F.trim(F.regexp_replace(spaced, SPACE, " "))
    return F.regexp_replace(flat, " ;$", "")


def signature_line(kind: str, identifier: Column, definition: Column) -> Column:
    """kind|identifier|sha256: and the first 32 hex digits of the hash of the normalised definition."""
    digest = F.substring(F.sha2(F.encode(normalized(definition), "UTF-8"), 256), 1, 32)
    return F.concat_ws("|", F.lit(kind), identifier, F.concat(F.lit("sha256:"), digest))


def fingerprint(lines: DataFrame) -> DataFrame:
    """One row: n_lines and sha256 of the sorted non-empty trimmed lines of lines(line).

    The result depends on all lines in order, so that many that one task can hold them: a catalog's, not a data table's.
    For row counts beyond that, bucketed_fingerprint has the same purpose.
    """
    own = lines.select(F.trim("line").alias("line")).where("line != ''")
    return own.agg(
        F.count("*").alias("n_lines"),
        F.sha2(F.encode(F.array_join(F.array_sort(F.collect_list("line")), "\n"), "UTF-8"), 256).alias("sha256"),
    )


def bucketed_fingerprint(lines: DataFrame, buckets: int = 4096) -> DataFrame:
    """n_lines and a digest of any number of lines, repeats counting: lines are hashed, hashes are summed by bucket (an
    order-free sum that combines before the shuffle), and the bounded number of buckets is hashed in order."""
    h = F.xxhash64("line")
    by_bucket = lines.groupBy(F.pmod(h, F.lit(buckets)).alias("b")).agg(
        F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.sum(F.hash("line").cast("long")).alias("t")
    )
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.format_string("%08d", "b"), "n", "s", "t"))), "\n")
    return by_bucket.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha256"))
