"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed, the distinct documents that hold a line are counted per host, lines above the limit
count as boilerplate and are removed, and a document of which too little is left is rejected.

Scale: a document's words and windows are arrays inside its own row, so no shuffle carries text. Counting lines shuffles
one short row for each line, partly aggregated before it moves. Only lines above the limit (at most all lines divided by
the limit) meet the lines again, in a join whose hot keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, packed, unpacked, words, written

#: A window of so many words that comes twice in a text makes its words repeated words.
WINDOW = 5


def normalised_line(line: Column) -> Column:
    """Lower case, white space collapsed, no white space at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def text_measures(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row.

    Null and empty texts have zeros. Rows are neither merged nor dropped.
    """
    own = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    cut = own.select(
        *keep,
        words(F.col("__t")).alias("__w"),
        F.size(F.regexp_extract_all("__t", F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"),
    )
    w = F.col("__w")
    hashed = cut.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(w) > WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
            ),
        ).alias("__h"),
    )
    # most texts repeat no window: only the others sort theirs
    sorted_ = hashed.withColumn(
        "__s",
        F.when(
            F.size(F.array_distinct("__h")) < F.size("__h"),
            F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("__s")

    def twin(i: Column) -> Column:
        same = lambda j: F.get(s, i)["h"] == F.get(s, j)["h"]
        return F.coalesce(same(i - 1), F.lit(False)) | F.coalesce(same(i + 1), F.lit(False))

    at = sorted_.withColumn(
        "__at",
        F.sort_array(
            F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda i: F.get(s, i)["i"])
        ),
    )
    p = F.col("__at")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(p) - 1),
        F.lit(0),
        lambda total, i: total + F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW))),
    )
    return at.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(s.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def document_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """A row for each line with a word: doc_id, host, text_hash, pos, line_hash, chars (of the normalised line).

    Null and empty texts have none; a null doc_id or host stays null; rows that repeat have their lines each; an empty table has no
    rows. Only the named columns are read, so others may have any name."""
    own = docs.select(
        docs[f"`{doc_id}`"].alias("doc_id"),
        docs[f"`{host}`"].alias("host"),
        F.coalesce(docs[f"`{text}`"], F.lit("")).alias("t"),
    )
    lines = own.select("doc_id", "host", F.xxhash64("t").alias("text_hash"), F.posexplode(F.split("t", "\n", -1)))
    normal = lines.select("doc_id", "host", "text_hash", "pos", normalised_line(F.col("col")).alias("line"))
    return normal.where("line != ''").select(
        "doc_id",
        "host",
        "text_hash",
        "pos",
        F.xxhash64("line").alias("line_hash"),
        F.char_length("line").alias("chars"),
    )


def frequent_lines(
    lines: DataFrame, docs: DataFrame, *, host: str, min_docs: int, max_share: float | None = None, copies_once: bool = False
) -> DataFrame:
    """host, line_hash, n_docs of the lines in more than min_docs distinct documents of their host and, if max_share is
    given, in more than that share of the host's documents. A document is its doc_id (its text, where it has none); with
    copies_once, documents of equal text count once."""
    document = F.col("text_hash") if copies_once else F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("h"))
    counted = lines.groupBy("host", "line_hash").agg(F.countDistinct(document).alias("n_docs"))
    if max_share is None:
        return counted.where(F.col("n_docs") > min_docs).select("host", "line_hash", "n_docs")
    own = docs.select(docs[f"`{host}`"].alias("host"))
    sizes = own.groupBy("host").agg(F.count("*").alias("host_docs"))
    # nothing at or below min_docs passes whatever the host's size, so few rows reach this join
    return (
        counted.where(F.col("n_docs") > min_docs)
        .join(sizes, counted["host"].eqNullSafe(sizes["host"]))
        .where(F.col("n_docs") > max_share * F.col("host_docs"))
        .select(counted["host"], "line_hash", "n_docs")
    )


def boilerplate(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = 10,
    max_share: float | None = None,
    copies_once: bool = False,
) -> DataFrame:
    """doc_id, text_hash, pos of each line to remove (pos counts \\n-split lines from 0), with its chars. Rows that repeat
    doc_id and text give their lines once; see document_lines for other odd rows."""
    lines = document_lines(docs, doc_id=doc_id, text=text, host=host)
    known = frequent_lines(lines, docs, host=host, min_docs=min_docs, max_share=max_share, copies_once=copies_once)
    return _held(lines, written(known, "frequent-lines"))


def _held(lines: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, chars of the lines that are among the known ones, each once."""
    same = (F.col("l.line_hash") == F.col("k.line_hash")) & F.col("l.host").eqNullSafe(F.col("k.host"))
    hit = lines.alias("l").join(known.alias("k"), same, "left_semi")
    return hit.select("doc_id", "text_hash", "pos", "chars").distinct()


def remove_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """docs with boilerplate lines taken out of the text; a text that had none, and null, stay as they are.

    Rows without a doc_id are told apart by their text; rows that repeat are treated alike, and stay; an empty table stays empty.
    The other columns are as they are, whatever their names."""
    gone = boilerplate(docs, doc_id=doc_id, text=text, **limits)
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    own = packed(docs, id=docs[f"`{doc_id}`"], text=docs[f"`{text}`"], hash=F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit(""))))
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return unpacked(joined.select(F.col("row").withField(f"`{text}`", cleaned).alias("row")))


def line_frequency_rules(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = 10,
    max_share: float | None = None,
    min_left: float = 0.5,
    copies_once: bool = False,
) -> DataFrame:
    """One row for each row of docs: doc_id, the text measures, base_failed, kept, n_removed_lines, removed_chars.

    A line is removed if more than min_docs distinct documents of its host hold it, whatever the host's size (and more
    than max_share of the host's documents, where that is given), exact copies counting each, or once with copies_once;
    hosts are compared null-safely, so rows without a host are one host. A document is
    depleted, and not kept, if less than min_left of the characters of its normalised lines remain. Base rules fail
    below 10 words or when repeated windows cover over 20 % of the words; those are not kept either.

    Null or empty text: no words, base_failed. Rows with a null doc_id are judged by their text and returned with a null
    doc_id; rows that repeat a doc_id and text each get the same verdict. Only the named columns are read, so further
    columns may have any name.
    """
    own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"), docs[f"`{host}`"].alias("host"))
    plain = F.coalesce(F.col("text"), F.lit(""))
    normal = F.transform(F.split(plain, "\n", -1), normalised_line)
    hashed = F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line_hash"), F.char_length(x).alias("chars")))
    # texts are read once: what the counts and the verdicts need of their lines is written
    kept = own.withColumn("text_hash", F.xxhash64(plain)).withColumn("lines", hashed)
    measured = written(text_measures(kept, keep=("doc_id", "host", "text_hash", "lines")), "line-measures")
    lines = measured.select("doc_id", "host", "text_hash", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("doc_id", "host", "text_hash", "pos", "line.*").where("chars > 0")
    known = frequent_lines(lines, measured, host="host", min_docs=min_docs, max_share=max_share, copies_once=copies_once)
    gone = _held(lines, written(known, "frequent-lines")).groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_removed_lines"), F.sum("chars").alias("removed_chars")
    )
    total = F.aggregate("lines", F.lit(0), lambda n, x: n + x["chars"])
    measured = measured.withColumn("line_chars", total).drop("lines", "host")
    m, g = measured.alias("m"), gone.alias("g")
    joined = m.join(
        g,
        (F.col("m.text_hash") == F.col("g.text_hash")) & F.col("m.doc_id").eqNullSafe(F.col("g.doc_id")),
        "left",
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    removed = F.coalesce(F.col("removed_chars"), F.lit(0)).cast("long")
    depleted = F.col("line_chars") - removed < min_left * F.col("line_chars")
    return joined.select(
        F.col("m.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        F.coalesce(F.col("n_removed_lines"), F.lit(0)).cast("long").alias("n_removed_lines"),
        removed.alias("removed_chars"),
    )
