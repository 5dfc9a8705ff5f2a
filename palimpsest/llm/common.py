"""What the corpus operators share: reading tables, scratch tables, words, and a sieve of bounded size before joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and \x09 to \x0D, nothing else.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir of the session. Where that is unset, a
    session on one machine (a local master, as in tests) gets a new local folder; a cluster gets an error, since no
    machine's own folder would do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        path = context.getCheckpointDir()
    # a path without a scheme lies in the cluster's default file system
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", full).rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE, -1), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are. lower() does just that on text without other characters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


#: Bits of a sieve: 2**25, so 4 MB, whatever is put in.
SIEVE_BITS = 25
_PAGE_BITS = 15  # of one row's bitmap, 4 KB


def sieved(df: DataFrame, key: Column, members: DataFrame, member: Column, mark: str, *, bits: int = SIEVE_BITS) -> DataFrame:
    """df with a boolean column `mark`: false only where key is certainly not among the members' values of `member`.

    The members' hashes are set in a bitmap of 2**bits bits, whose size (4 MB for 25) does not depend on their number, so it
    may be broadcast; rows that are not marked need not be shuffled to find out that no member joins them. With very many members
    the bitmap fills up and marks more rows than needed, never fewer. key and member must have one type; a null is a value
    like any other.
    """
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    page = lambda c: F.shiftright(slot(c), _PAGE_BITS)
    place = lambda c: slot(c).bitwiseAND((1 << _PAGE_BITS) - 1)
    # numbers are shuffled, not bitmaps of every task
    dealt = members.select(page(member).alias("__page"), place(member).alias("__place"))
    empty = df.sparkSession.range(1 << (bits - _PAGE_BITS)).select(F.col("id").alias("__page"), F.lit(None).cast("long").alias("__place"))
    dealt = dealt.unionByName(empty).repartition("__page")
    pages = dealt.groupBy("__page").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    # words of 32 bits: rows then take one from an array, and make no strings. A word's first byte is its highest
    word = lambda i: F.conv(F.hex(F.substr("__bits", 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    signed = lambda w: F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w).cast("int")
    pages = pages.select("__page", F.transform(F.sequence(F.lit(0), F.lit((1 << _PAGE_BITS - 5) - 1)), lambda i: signed(word(i))).alias("__bits"))
    at = place(key)
    bit = (24 - F.shiftright(at, 3).bitwiseAND(3) * 8 + at.bitwiseAND(7)).cast("int")
    hit = F.getbit(F.get("__bits", F.shiftright(at, 5).cast("int")), bit) == 1
    joined = df.join(F.broadcast(pages), page(key) == F.col("__page"), "left")
    return joined.withColumn(mark, F.coalesce(hit, F.lit(False))).drop("__page", "__bits")


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: Column, *, ways: int = 8, how: str = "inner") -> DataFrame:
    """many joined with few (a few rows for each value of `on`): rows of one value are dealt over several tasks by a hash of `by`,
    each with a copy of what few has of it, so a value that very many rows share is no task's alone."""
    salted = many.withColumn("__way", F.pmod(F.xxhash64(by), F.lit(ways)))
    copies = few.withColumn("__way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    return salted.join(copies, [*on, "__way"], how).drop("__way")


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """rows with `name`, their number from 1 on within their keys and the order, as a written table; null keys are keys.

    Rows are dealt by ranges of the whole order, so the rows of a key, or of none, lie in as many tasks as hold them; how many of a
    key's rows come in ranges before is a sum over one row for each (range, key). Rows that are alike in keys and order are
    numbered in some order.
    """
    alike = F.monotonically_increasing_id()  # tells rows apart that are alike in all else, so that ranges can part them
    by = [*keys, *order, "__alike"]
    dealt = rows.withColumn("__alike", alike).repartitionByRange(*by).sortWithinPartitions(*by)
    part = written(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    sizes = part.groupBy("__part", *own).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).withColumnRenamed("__part", "__p")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    # within a range, rows of a key stand in a row, so their numbers follow from the place of the first
    met = part.join(sizes, same).withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1)
    return written(met.select(*rows.columns, name), "numbered")


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """`row`, a struct of all columns of docs, whatever their names, and the named values beside it. Names of the caller's
    own can't clash with those of docs then; unpacked() gives the columns back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in named.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")
