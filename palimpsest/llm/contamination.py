"""Benchmark decontamination by a positional inverted index: posting lists of training tokens, offset-adjusted and intersected
from the rarest test terms on, for exact phrases and for words that lie close together. DataFrame functions only.

The index has one row for each token of a document: its term, the document and the position. Each task inverts its own share
of documents (sorts its postings by term and writes them), so building the index shuffles nothing, and a list is spread over as
many segments as there are tasks; a very frequent term is no task's alone. Queries read the lists that they ask for: a sieve of
fixed size (common.sieved) lets the other postings pass by without being shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, sieved, spread_join, written

#: Everything but digits, a-z and characters beyond ASCII separates words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
NEAR = 15
DOC = ["doc", "txt"]


def _named(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def terms(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(_pieces(text), "")


def _pieces(text: Column) -> Column:
    """The words of a text, with an empty one before or after them where it begins or ends with what separates words."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1)


def n_terms(text: Column) -> Column:
    """How many words a text has: letters of either case make the same words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def _keys(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """What a document is known by: hashes of its id and of its text. Rows that share both have one text, so one result."""
    return [F.xxhash64(_named(docs, doc_id)).alias("doc"), F.xxhash64(F.coalesce(_named(docs, text), F.lit(""))).alias("txt")]


def positional_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of all tokens of docs as a written table: term (64-bit hash of the word), doc, txt, pos. Sorted by term in
    each file, so a reader's statistics of row groups tell which terms a group can't have. Null and empty texts, and those
    without a word, have no postings; rows that repeat are indexed each."""
    pieces = docs.select(*_keys(docs, doc_id, text), _pieces(_named(docs, text)).alias("pieces"))
    ahead = F.when(F.get("pieces", F.lit(0)) == "", 1).otherwise(0).alias("ahead")
    rows = pieces.select(*DOC, ahead, F.posexplode("pieces").alias("at", "word")).where("word != ''")
    postings = rows.select(F.xxhash64("word").alias("term"), *DOC, (F.col("at") - F.col("ahead")).alias("pos"))
    return written(postings.sortWithinPartitions("term"), "postings")


def test_windows(items: DataFrame, *, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (string; a null id is the empty string), wid, terms of each window of `size` consecutive words of an item, or of
    all its words where it has fewer; items without words have none. wid is a hash of the words, so windows of the same words are
    one window, whatever items they come from."""
    own = items.select(
        F.coalesce(_named(items, item_id).cast("string"), F.lit("")).alias("item"),
        F.transform(terms(_named(items, text)), lambda w: F.xxhash64(w)).alias("all"),
    ).where(F.size("all") > 0)
    at = own.select("item", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))).alias("i"))
    window = at.select("item", F.slice("all", F.col("i"), size).alias("terms")).distinct()
    return window.select("item", F.xxhash64("terms").alias("wid"), "terms")


def _rarest_first(index: DataFrame, windows: DataFrame) -> DataFrame:
    """wid, n_terms, by_rarity: of each distinct window its terms as (n, off, term), the fewest postings first. Windows with a
    term that the index has not can't occur, and go."""
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    asked = sieved(index.select("term"), F.col("term"), vocabulary, F.col("term"), "__asked").where("__asked")
    counts = asked.groupBy("term").agg(F.count("*").alias("n"))
    each = windows.select("wid", "terms").distinct().select("wid", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("off", "term"))
    lists = each.join(counts, "term").groupBy("wid", "n_terms").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("by_rarity"))
    return lists.where(F.size("by_rarity") == F.col("n_terms"))


def _met(asks: DataFrame, index: DataFrame, near: int) -> DataFrame:
    """asks(doc, txt, wid, at, term) with the positions of their terms less than `near` from `at`, a row for each. The lists are read in bins of positions, so a posting is compared with neighbours alone."""
    place = F.floor(F.col("pos") / near).cast("int")
    bins = asks.withColumn("bin", F.explode(F.array(*[F.floor(F.col("at") / near).cast("int") + d for d in (-1, 0, 1)])))
    # of the whole index, only lists that are asked for, and of these only what stands in an asked place, is shuffled
    rows = sieved(index, F.col("term"), asks.select("term").distinct(), F.col("term"), "__list").where("__list").drop("__list")
    asked = bins.select(F.xxhash64("term", *DOC, "bin").alias("k")).distinct()
    rows = sieved(rows, F.xxhash64("term", *DOC, place), asked, F.col("k"), "__here")
    rows = rows.where("__here").select("term", *DOC, "pos", place.alias("bin")).distinct()
    return bins.join(rows, ["term", *DOC, "bin"]).where(F.abs(F.col("pos") - F.col("at")) < near).drop("bin")


def matches(index: DataFrame, windows: DataFrame, *, near: int = NEAR) -> DataFrame:
    """Where the windows of test_windows occur in the documents of the index: doc, txt, wid, n_terms, at, start, phrase.

    A row with phrase is an exact occurrence whose first word stands at start. A row without says that all distinct words of the
    window lie within `near` consecutive words around `at`, in any order. `at` is where the window's rarest term stands.
    near must be the windows' size or more, so phrases are among the near ones.

    The rarest term's list makes the candidates; the second rarest one's, read around these, leaves few of them; the other lists
    are read around those that are left.
    """
    index = index.select("term", *DOC, "pos")
    wanted = written(_rarest_first(index, windows), "windows")
    first = wanted.select(
        "wid",
        F.col("by_rarity")[0]["term"].alias("term"),
        # the rarest of the other terms, null where there is none
        F.get(F.filter(F.col("by_rarity")["term"], lambda t: t != F.col("by_rarity")[0]["term"]), F.lit(0)).alias("second"),
    )
    rare = sieved(index, F.col("term"), first.select("term").distinct(), F.col("term"), "__list").where("__list").drop("__list")
    begun = spread_join(rare, first, ["term"], F.struct(*DOC, "pos"), ways=64).select(*DOC, "wid", F.col("pos").alias("at"), "second")
    begun = written(begun.distinct(), "rarest")
    asks = begun.where("second is not null").select(*DOC, "wid", "at", F.col("second").alias("term"))
    left = _met(asks, index, near).select(*DOC, "wid", "at").distinct()
    left = left.unionByName(begun.where("second is null").select(*DOC, "wid", "at"))
    left = written(spread_join(left, wanted, ["wid"], F.struct(*DOC, "at")), "second-rarest")
    asks = left.select(*DOC, "wid", "at", F.explode(F.array_distinct(F.col("by_rarity")["term"])).alias("term"))
    met = _met(asks, index, near).groupBy(*DOC, "wid", "at").agg(F.collect_set(F.struct("term", "pos")).alias("around"))
    full = spread_join(met, wanted, ["wid"], F.struct(*DOC, "at"))
    start = F.col("at") - F.col("by_rarity")[0]["off"]
    phrase = F.forall("by_rarity", lambda t: F.array_contains("around", F.struct(t["term"].alias("term"), (start + t["off"]).alias("pos"))))
    needed = F.size(F.array_distinct(F.col("by_rarity")["term"]))
    inside = lambda a: F.filter("around", lambda x: (x["pos"] >= a) & (x["pos"] < a + near))
    together = F.exists(F.sequence(F.col("at") - near + 1, "at"), lambda a: F.size(F.array_distinct(F.transform(inside(a), lambda x: x["term"]))) == needed)
    out = full.select(*DOC, "wid", "n_terms", "at", start.alias("start"), phrase.alias("phrase"), (phrase | together).alias("near"))
    return written(out.where("near").drop("near"), "matches")


def contaminated(
    docs: DataFrame, items: DataFrame, *, size: int = SIZE, near: int = NEAR,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The columns of docs in a struct `row`, and n_words, n_hit, spans (array of from, to: the words hit, `to` excluded), items
    (array of strings, sorted) and near_items of each row.

    A window is `size` consecutive words of an item, or all words of a shorter one. A word is hit that lies in an exact occurrence
    of a window; items have a window that occurs exactly, near_items one whose distinct words all lie within `near` consecutive
    words. Texts are read whole. Null texts have no words; a null id of an item counts as the empty string, items of one id as one
    item; a null doc_id is an id like any other; rows that repeat each get their result; an empty table of either kind gives
    no hits. Words, windows and documents are told apart by 64-bit hashes (documents by two). Columns of docs may have any name.
    """
    windows = written(test_windows(items, size=size, item_id=item_id, text=item_text), "test-windows")
    index = positional_index(docs, doc_id=doc_id, text=text)
    found = matches(index, windows, near=near)
    # occurrences that overlap or touch make one span
    ends = found.where("phrase").groupBy(*DOC, "start").agg((F.col("start") + F.max("n_terms")).alias("end"))
    by_start = Window.partitionBy(*DOC).orderBy("start")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = ends.withColumn("new", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by_start)).groupBy(*DOC, "run").agg(F.min("start").alias("from"), F.max("end").alias("to"))
    hits = runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))
    of_item = windows.select("item", "wid").distinct()
    by_item = spread_join(found.groupBy(*DOC, "wid").agg(F.max("phrase").alias("phrase")), of_item, ["wid"], F.struct(*DOC))
    lists = by_item.groupBy(*DOC).agg(
        F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("item")))).alias("items"),
        F.array_sort(F.collect_set("item")).alias("near_items"),
    )
    result = lists.join(hits, DOC, "left")
    rows = docs.select(F.struct(*[_named(docs, c).alias(c) for c in docs.columns]).alias("row"), _named(docs, text).alias("__text"), *_keys(docs, doc_id, text))
    return _with_results(rows, result)


def _with_results(rows: DataFrame, result: DataFrame) -> DataFrame:
    """rows(row, __text, doc, txt) with n_words and their result; only rows that the sieve marks are shuffled to meet it, without
    their texts' words having been counted before."""
    span = "array<struct<`from`: int, `to`: int>>"
    marked = sieved(rows, F.xxhash64(*DOC), result.select(F.xxhash64(*DOC).alias("k")), F.col("k"), "__hit")
    none = [F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"), F.array().cast("array<string>").alias("near_items")]
    clean = marked.where("not __hit").select("row", n_terms(F.col("__text")).alias("n_words"), *none)
    hit = marked.where("__hit").select("row", n_terms(F.col("__text")).alias("n_words"), *DOC)
    met = spread_join(hit, result, DOC, F.xxhash64(F.rand(7)), how="left")
    met = met.select("row", "n_words", *[F.coalesce(F.col(n), F.array().cast(t)).alias(n) for n, t in (("spans", span), ("items", "array<string>"), ("near_items", "array<string>"))])
    both = clean.unionByName(met)
    return both.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"]))
