"""MinHash near-dedup with odd sketches.

1. Each text gives its set of word shingles, MinHash samples of it, band keys of the samples, and an odd sketch: the
   samples folded into a bitmap of parities. Texts of equal sets form one class.
2. Classes that share a band key are candidates. In each bucket, all are paired with one pivot only, not with each other.
3. A pair whose odd sketches differ in too many bits (population count of their XOR) is dropped; the others are confirmed
   on the full shingle sets.
4. Confirmed links give components. Buckets that still hold several components are searched across these components: XOR
   counts of whole blocks of sketches tell which members have a likely partner, and only these meet again with their full
   sets. Links within one component need no search.

Nothing is capped: a bucket of any size is cut into blocks of rows that meet blocks of its minor components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import packed, sieved, spread_join, unpacked, written
from palimpsest.llm.components import components
from palimpsest.llm.files import sized_slices
from palimpsest.llm.shingles import Sketcher, set_digest, shingle_sets

#: Texts of about so many bytes are handled at once in a task.
BATCH_BYTES = 500_000


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signatures(docs: DataFrame, sketcher: Sketcher) -> DataFrame:
    """doc_id, n_shingles, class_key, bands, odd of docs(doc_id, text). A text without words has 0 and nulls."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sized_slices(whole, "text", BATCH_BYTES):
                sets = shingle_sets(_texts(batch.column("text")))
                full = [x for x in sets if len(x)]
                at = np.full(len(sets), -1)
                at[[i for i, x in enumerate(sets) if len(x)]] = np.arange(len(full))
                if full:
                    minima = sketcher.minima(full)
                    keys, odd = sketcher.band_keys(minima), sketcher.odd(minima)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([set_digest(x) if len(x) else None for x in sets], pa.binary()),
                        pa.array([keys[i] if i >= 0 else None for i in at], pa.list_(pa.int64())),
                        pa.array([odd[i].tobytes() if i >= 0 else None for i in at], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "class_key", "bands", "odd"],
                )

    schema = "doc_id long, n_shingles long, class_key binary, bands array<long>, odd binary"
    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def estimated(pairs: DataFrame, sketches: DataFrame, sketcher: Sketcher, least: float) -> DataFrame:
    """The pairs (a, b, load) whose odd sketches say a similarity of least or more."""
    most = most_differing(sketcher, least)
    words = sketcher.bits // 64

    def part(name: str, k: int):
        return F.conv(F.hex(F.substring(name, 8 * k + 1, 8)), 16, -10).cast("long")

    differing = sum((F.bit_count(part("oa", k).bitwiseXOR(part("ob", k))) for k in range(words)), F.lit(0))
    x = sketches.select(F.col("rep").alias("a"), F.col("odd").alias("oa"), F.col("n_shingles").alias("na"))
    y = sketches.select(F.col("rep").alias("b"), F.col("odd").alias("ob"), F.col("n_shingles").alias("nb"))
    both = pairs.join(x, "a").join(y, "b")
    return both.where(possible(F.col("na"), F.col("nb")) & (differing <= most)).select("a", "b", "load")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Of two sorted sets: 100 * intersection >= 75 * union, and neither empty."""
    if not len(x) or not len(y):
        return False
    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * shared >= 75 * (len(x) + len(y) - shared)


def possible(na, nb):
    """Sets of these sizes can reach a similarity of 0.75."""
    return 4 * F.least(na, nb) >= 3 * F.greatest(na, nb)


def confirmed(pairs: DataFrame, texts: DataFrame, block: int = 128) -> DataFrame:
    """u, v of the pairs (a, b, load) whose full shingle sets have 100 * intersection >= 75 * union.

    texts(rep, text). Text b travels to a copy of text a: one copy for each 128 or so partners, so that an ``a`` with
    very many partners is spread over tasks; only one set and one batch of texts are held at a time.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("load") / block))))
    ends = salted.select(F.col("b").alias("rep"), "a", "salt", F.lit(1).alias("kind")).unionByName(
        salted.select(F.col("a").alias("rep"), "a", "salt", F.lit(0).alias("kind")).distinct()
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = [], (None, 1)
        for whole in batches:
            for batch in sized_slices(whole, "text", BATCH_BYTES):
                u, v = [], []
                rows = (batch.column(k).to_pylist() for k in ("rep", "a", "kind"))
                for rep, a, kind, found in zip(*rows, shingle_sets(_texts(batch.column("text"))), strict=True):
                    if kind == 0:  # several only where rows repeat a doc_id
                        own = [found] if last != (a, 0) else [*own, found]
                    elif any(linked(x, found) for x in own):
                        u.append(rep)
                        v.append(a)
                    last = (a, kind)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    placed = (
        ends.join(texts, "rep")
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", "kind")
        .select("rep", "a", "kind", "text")
    )
    return placed.mapInArrow(check, "u long, v long")


class Block:
    """Members of a bucket that others are compared with, by their sketches."""

    def __init__(self, rows: list[tuple[int, int, bytes, int]], most: int):
        reps, labels, odd, sizes = zip(*rows, strict=True)
        self.reps, self.labels, self.most = np.array(reps, np.int64), np.array(labels, np.int64), most
        self.bits = np.frombuffer(b"".join(odd), np.uint64).reshape(len(rows), -1)
        self.sizes = np.array(sizes, np.int64)

    def near(self, label: int, odd: bytes, size: int) -> np.ndarray:
        """Places of those of other labels whose sizes and sketches allow a link."""
        able = 4 * np.minimum(self.sizes, size) >= 3 * np.maximum(self.sizes, size)
        at = np.flatnonzero((self.labels != label) & able)
        return at[np.bitwise_count(self.bits[at] ^ np.frombuffer(odd, np.uint64)).sum(axis=1) <= self.most]


def linked_places(near: np.ndarray, sets: list[np.ndarray], found: np.ndarray) -> list[int]:
    """Those of the places whose sets are linked with a set."""
    if not len(near):
        return []
    sizes = np.array([len(sets[i]) for i in near])
    flat = np.concatenate([sets[i] for i in near])
    same = found[np.minimum(np.searchsorted(found, flat), len(found) - 1)] == flat
    shared = np.add.reduceat(same.astype(np.int64), np.cumsum([0, *sizes[:-1]]))
    return near[100 * shared >= 75 * (len(found) + sizes - shared)].tolist()


#: What a member carries beside its text.
MEMBER = ["key", "block", "part", "side", "rep", "label", "odd", "n_shingles"]


def meeting(members: DataFrame, more: DataFrame, block: int) -> DataFrame:
    """members(key, rep, label, main, …) laid out in blocks: each minor member lies in one block of its bucket (side 0),
    and all members meet every block (side 1). Rows of one (key, block, part) lie in one task, side 0 first; a part has
    about ``block`` members on side 0 and twice as many on side 1, however large the bucket. What they bring along, more(rep,
    …), joins them last, so it is shuffled once."""
    counts = members.groupBy("key").agg(F.count("*").alias("n_all"), F.count_if(~F.col("main")).alias("n_minor"))
    sized = spread_join(members, counts.where("n_minor > 0"), ["key"], F.col("rep"))
    blocks = F.ceil(F.col("n_minor") / block)
    parts = F.ceil(F.col("n_all") / (2 * block))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    spread = lambda n, k: F.pmod(F.xxhash64("rep", F.lit(k)), n)
    held = sized.where("not main").withColumn("block", spread(blocks, 0)).withColumn("part", upto(parts))
    passing = sized.withColumn("block", upto(blocks)).withColumn("part", spread(parts, 1))
    rows = held.withColumn("side", F.lit(0)).unionByName(passing.withColumn("side", F.lit(1)))
    laid = rows.join(more, "rep").repartition("key", "block", "part")
    return laid.sortWithinPartitions("key", "block", "part", "side")


def most_differing(sketcher: Sketcher, least: float) -> int:
    return int(np.flatnonzero(sketcher.estimate(np.arange(sketcher.bits + 1)) >= least).max())


def promising(members: DataFrame, bands_of: DataFrame, sketcher: Sketcher, least: float, block: int) -> DataFrame:
    """key, rep of the members, with bands_of(rep, bands), that have a likely partner with another label in their bucket, by sizes and sketches.
    A pair counts in the first bucket alone that it shares."""
    most = most_differing(sketcher, least)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, table, hit, bands = None, [], None, None, None

        def held_hits() -> list[tuple[int, int]]:
            return [(at[0], r) for r in table.reps[hit].tolist()] if table else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = np.asarray(batch.column("bands").flatten()).reshape(len(batch), -1)
            for i, (key, n, part, side, rep, label, odd, size) in enumerate(zip(*(batch.column(k).to_pylist() for k in MEMBER), strict=True)):
                if at != (key, n, part):
                    out += held_hits()
                    at, waiting, table, bands = (key, n, part), [], None, []
                if side == 0:
                    waiting.append((rep, label, odd, size))
                    bands.append(keys[i])
                    continue
                if table is None and waiting:
                    table, hit, bands = Block(waiting, most), np.zeros(len(waiting), bool), np.array(bands)
                if table and len(near := table.near(label, odd, size)):
                    first = (bands[near] == keys[i]).argmax(axis=1)
                    near = near[keys[i][first] == key]
                    if len(near):
                        hit[near] = True
                        out.append((key, rep))
            yield _pairs(out, "key", "rep")
        yield _pairs(held_hits(), "key", "rep")

    return meeting(members, bands_of, block).select(*MEMBER, "bands").mapInArrow(search, "key long, rep long").distinct()


def _pairs(rows: list[tuple[int, int]], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], list(names))


def across(members: DataFrame, bands_of: DataFrame, texts: DataFrame, sketcher: Sketcher, least: float, block: int) -> DataFrame:
    """u, v: links between members of different components in a bucket.

    members(key, rep, label, main, odd, n_shingles): main tells that the label is that of the bucket's pivot; bands_of(rep,
    bands), texts(rep, text). Sketches are compared first, without texts; then the members with a likely partner meet once more, and pairs
    are confirmed on full sets where they meet, so only links leave a task. It holds one block and one slice of texts.
    """
    most = most_differing(sketcher, least)
    likely = members.join(promising(members, bands_of, sketcher, least, block), ["key", "rep"], "left_semi")
    likely = written(likely, "likely")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, sets, table = None, [], [], None
        for whole in batches:
            for batch in sized_slices(whole, "text", BATCH_BYTES):
                out: list[tuple[int, int]] = []
                columns = (batch.column(k).to_pylist() for k in MEMBER)
                all_sets = shingle_sets(_texts(batch.column("text")))
                for key, n, part, side, rep, label, odd, size, found in zip(*columns, all_sets, strict=True):
                    if at != (key, n, part):
                        at, waiting, sets, table = (key, n, part), [], [], None
                    if side == 0:
                        if len(found):  # else the rep's other text, where rows repeat a doc_id
                            waiting.append((rep, label, odd, size))
                            sets.append(found)
                        continue
                    if table is None and waiting:
                        table = Block(waiting, most)
                    if table and len(found):
                        for i in linked_places(table.near(label, odd, size), sets, found):
                            other = int(table.reps[i])
                            out.append((max(rep, other), min(rep, other)))
                yield _pairs(out, "u", "v")

    met = meeting(likely, wanted_texts(texts, likely), block)
    return met.select(*MEMBER, "text").mapInArrow(search, "u long, v long").distinct()


def wanted_texts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """texts(rep, text) of at least the members(rep): the others needn't be shuffled to be found superfluous."""
    return sieved(texts, F.col("rep"), members.select("rep").distinct(), F.col("rep"), "__may").where("__may").drop("__may")


def near_groups(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    bands: int = 51,
    rows: int = 5,
    bits: int = 1024,
    least_estimate: float = 0.58,
    block: int = 256,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of each row of docs.

    Two texts are linked if their sets of 5-word shingles (A-Z lower-cased; the whole sequence where a text has fewer
    words) have a similarity of 0.75 or more. component_id is the smallest doc_id that links reach, class_id the smallest
    doc_id with the same set. With 51 bands of 5 rows, a pair at exactly 0.75 shares no band with probability 1e-6, and
    the sketch estimate of such a pair (standard deviation 0.03) falls below 0.58 about as seldom.

    A text without words, or null, has n_shingles 0 and is its own component. A row with a null doc_id takes part through
    its class (component_id null if no row of the class has a doc_id, and only then is it kept). Rows that repeat a doc_id
    are one node: a row comes out for each, and what either of their texts reaches is reached. An empty table gives no
    rows. Only the named columns are read.
    """
    sketcher = Sketcher(bands, rows, bits)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(signatures(own, sketcher), "signatures")

    # texts of equal sets are one class, known by its smallest doc_id
    named = signed.where("class_key is not null")
    classes = written(
        named.groupBy("class_key").agg(
            F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "odd", "n_shingles"), "doc_id").alias("s")
        ).where("rep is not null").select("class_key", "rep", "s.*"),
        "classes",
    )
    keys = classes.select("rep", F.explode("bands").alias("key"))
    pivots = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    # most keys are one text's alone: they needn't be shuffled again to find that out
    pivots = written(pivots, "pivots")
    shared = sieved(keys, F.col("key"), pivots, F.col("key"), "may", bits=27).where("may").drop("may")
    buckets = written(shared.join(pivots, "key"), "buckets")

    members = buckets.select("rep").distinct()
    texts = own.select(F.col("doc_id").alias("rep"), "text").where("rep is not null")
    some = sieved(classes, F.col("rep"), members, F.col("rep"), "may").where("may").drop("may")
    some = written(some.join(members, "rep", "left_semi"), "candidate-sketches")
    sketches, bands_of = some.select("rep", "odd", "n_shingles"), some.select("rep", "bands")
    stars = buckets.where("rep != pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    pairs = estimated(stars.agg(F.max("n").alias("load")), sketches, sketcher, least_estimate)
    pairs = written(pairs, "star-pairs")
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    links = written(confirmed(pairs, wanted_texts(texts, ends)), "star-links")
    first = written(components(links), "star-components")

    # what the stars may have missed: links between different components of a bucket
    labelled = buckets.join(first.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "key", "rep", "pivot", F.coalesce("root", "rep").alias("label")
    )
    main = first.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_label"))
    labelled = labelled.join(main, "pivot", "left").withColumn("main", F.expr("label = coalesce(pivot_label, pivot)"))
    labelled = written(labelled.select("key", "rep", "label", "main"), "labelled")
    # only members whose size allows a link with some minor member of the bucket go on
    sized = labelled.join(sketches, "rep")
    mixed = sized.where("not main").groupBy("key").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    rest = spread_join(sized, mixed, ["key"], F.col("rep")).where("4 * n_shingles >= 3 * low and 3 * n_shingles <= 4 * high").drop("low", "high")
    rest = written(rest, "mixed-buckets")
    further = written(across(rest, bands_of, texts, sketcher, least_estimate, block), "cross-links")
    roots = components(
        further.unionByName(first.select(F.col("node").alias("u"), F.col("root").alias("v")))
    )

    member = named.join(classes.select("class_key", F.col("rep").alias("class_id")), "class_key", "left")
    labelled_rows = (
        member.join(roots, member["class_id"] == roots["node"], "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "class_id").alias("component_id"), "class_id")
        .unionByName(
            signed.where("class_key is null").select(
                "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")
            )
        )
    )
    return labelled_rows.select(
        "doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "class_id"
    )


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that near_groups does not keep, its columns as they are, whatever their names.

    Of documents that links connect, the one with the smallest doc_id stays. Null and empty texts, and texts without words,
    are linked with nothing and stay; so do rows with a null doc_id. Rows that repeat a doc_id stay or go together, since
    they are one node. Very long texts are read whole. An empty table stays empty.
    """
    found = near_groups(docs, doc_id=doc_id, text=text, **options).where("not kept and doc_id is not null")
    gone = written(found.select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    rows = sieved(packed(docs, id=docs[f"`{doc_id}`"].cast("long")), F.col("id"), gone, F.col("gone"), "may")
    # texts that may be among those that go meet them, the others stay where they are
    left = rows.where("may").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return unpacked(rows.where("not may").unionByName(left))
