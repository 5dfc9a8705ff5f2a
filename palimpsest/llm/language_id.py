"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The
probabilities are learned from labelled texts by expectation maximisation over the same segmentations.

Scale: learning reads a bounded sample of labelled texts, and each of its rounds gathers one number for each language and
piece. Scoring reads rows where they lie, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.llm.common import packed, unpacked, written
from palimpsest.llm.files import sized_slices

START = "▁"
WORDS = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"
#: Pieces are looked up for so many characters of a word at once, so that a very long word needs little memory.
STRETCH = 1024
#: A character that no piece holds, in any language.
FLOOR = 1e-7
BATCH_BYTES = 500_000
REMEMBERED = 60_000


def public_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, lower-cased, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [model.is_control, model.is_unknown, model.is_byte, model.is_unused]
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not any(f(i) for f in odd))
    return list(dict.fromkeys(p for p in pieces if p != START))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Lattice:
    """Which pieces of the vocabulary lie where in words of one length."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        self.longest = max(by_length, default=1)
        self.tables = {}
        for k, ids in by_length.items():
            chars = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64)
            keys = self._key(chars)
            order = np.argsort(keys)
            self.tables[k] = (keys[order], np.array(ids)[order])

    @staticmethod
    def _key(chars: np.ndarray) -> np.ndarray:
        key = np.zeros(chars.shape[:-1], np.uint64)
        for j in range(chars.shape[-1]):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + chars[..., j] + np.uint64(1))
        return key

    @staticmethod
    def characters(words: list[str]) -> np.ndarray:
        """A row for each word; all have one length."""
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)

    def spans(self, chars: np.ndarray, first: int, past: int) -> dict[int, dict[int, np.ndarray]]:
        """By first <= end - 1 < past and length, the piece of each word that ends there; n stands for none. A single
        character always counts as a piece, n + 1 if the vocabulary lacks it."""
        out: dict[int, dict[int, np.ndarray]] = {end: {} for end in range(first + 1, past + 1)}
        low = max(0, first + 1 - self.longest)
        part = chars[:, low:past]
        width = part.shape[1]
        key = np.zeros((len(part), width + 1), np.uint64)  # of the k characters from each place on
        for k in range(1, min(self.longest, width) + 1):
            key = _mix(key[:, : width - k + 1] * np.uint64(0x9E3779B97F4A7C15) + part[:, k - 1 :] + np.uint64(1))
            if k not in self.tables and k > 1:
                continue
            begin = max(0, first + 1 - k - low)  # earlier ones end before this stretch
            own = key[:, begin:]
            keys, ids = self.tables.get(k, (np.zeros(1, np.uint64), np.array([self.n])))
            spot = np.minimum(np.searchsorted(keys, own.ravel()), len(keys) - 1).reshape(own.shape)
            found = np.where(keys[spot] == own, ids[spot], self.n + (k == 1))
            some = np.ones(own.shape[1], bool) if k == 1 else (found != self.n).any(axis=0)
            for b in np.flatnonzero(some).tolist():
                out[low + begin + b + k][k] = found[:, b]
        return out


def stretches(width: int) -> list[tuple[int, int]]:
    return [(a, min(width, a + STRETCH)) for a in range(0, width, STRETCH)]


#: Probabilities are rescaled after so many characters: by then they are above FLOOR ** 24 = 1e-168, within a double's range.
RESCALED = 24


def log_scores(words: list[str], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Log probability of each word (of one length) in each language; p has a row for each piece, a zero row and the
    floor's row, and a column for each language."""
    chars, width = lattice.characters(words), len(words[0])
    shape = (len(words), p.shape[1])
    alpha = {0: np.ones(shape)}
    logs = np.zeros(len(words))
    for first, past in stretches(width):
        spans = lattice.spans(chars, first, past)
        for end in range(first + 1, past + 1):
            total = np.zeros(shape)
            for k, ids in spans[end].items():
                total += alpha[end - k] * p[ids]
            alpha[end] = total
            alpha.pop(end - lattice.longest, None)
            if end % RESCALED == 0:  # so that long words don't run out of range
                scale = np.maximum(total.max(axis=1), 1e-300)
                logs += np.log(scale)
                for x in alpha.values():
                    x /= scale[:, None]
    return np.log(np.maximum(alpha[width], 1e-300)) + logs[:, None]


def expected_counts(words: list[str], counts: np.ndarray, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words (of one length) that occur so often, over all segmentations; p is one
    language's column.

    Forward sums are kept with the log of what they were divided by, which is one number for each RESCALED characters;
    backward sums are divided by the same numbers, so what a piece adds needs the ratio of neighbouring ones only.
    """
    chars, width = lattice.characters(words), len(words[0])
    alpha = np.zeros((width + 1, len(words)))
    scales = np.ones((width // RESCALED + 2, len(words)))  # by which all from the end of that part on are divided
    alpha[0] = 1

    def factor(begin: int, end: int) -> np.ndarray | float:
        """What a sum up to `begin` is to be divided by where it meets one up to `end`."""
        a, b = begin // RESCALED, end // RESCALED
        return 1.0 if a == b else np.multiply.reduce(scales[a + 1 : b + 1], axis=0)

    for first, past in stretches(width):
        spans = lattice.spans(chars, first, past)
        for end in range(first + 1, past + 1):
            for k, ids in spans[end].items():
                alpha[end] += alpha[end - k] / factor(end - k, end) * p[ids]
            if end % RESCALED == 0:
                scales[end // RESCALED] = np.maximum(alpha[end], 1e-300)
                alpha[end] /= scales[end // RESCALED]
    weight = counts / np.maximum(alpha[width], 1e-300)
    out = np.zeros(len(p))
    beta = {width: np.ones(len(words))}
    for first, past in reversed(stretches(width)):
        spans = lattice.spans(chars, first, past)
        for end in range(past, first, -1):
            after = beta.pop(end, 0.0)  # nothing, if no piece begins here
            for k, ids in spans[end].items():
                passed = after / factor(end - k, end) * p[ids]
                beta[end - k] = beta.get(end - k, 0.0) + passed
                out += np.bincount(ids, alpha[end - k] * passed * weight, minlength=len(p))
    return out


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, in groups that fit the CPU's cache."""
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    for width, places in groups.items():
        at = max(1, 40_000 // width)
        yield from (places[k : k + at] for k in range(0, len(places), at))


def text_words(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


class Model:
    """languages (sorted) and the probability of each piece in each; `vocabulary` is the path of the public model."""

    def __init__(self, vocabulary: str, languages: list[str], p: np.ndarray):
        self.vocabulary, self.languages, self.p = vocabulary, languages, p


@lru_cache(maxsize=2)
def lattice_of(vocabulary: str) -> Lattice:
    """One for each Python worker."""
    return Lattice(public_pieces(vocabulary))


def in_sample(labelled: DataFrame, max_docs: int) -> DataFrame:
    """About max_docs rows of each language, chosen by a hash of doc_id; all where there are fewer."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("n"))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000
    # a written table has a known size, so Spark broadcasts it only if it is small
    return labelled.join(written(sizes, "language-sizes"), "lang").where(chosen)


def fit(labelled: DataFrame, vocabulary: str, *, max_docs: int = 4000, rounds: int = 3) -> Model:
    """A model from labelled(doc_id, text, lang); rows with a null lang or text teach nothing.

    At most about max_docs texts of each language are read, whole, chosen by a hash of doc_id. Their words are counted,
    and each of the rounds distributes the counts over pieces; the driver gathers languages * pieces numbers. Without any
    labelled text the model has no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sized_slices(whole, "text", BATCH_BYTES):
                found: dict[str, Counter] = {}
                for text, lang in zip(*(batch.column(k).to_pylist() for k in ("text", "lang")), strict=True):
                    found.setdefault(lang, Counter()).update(text_words(text))
                rows = [(lang, word, n) for lang, own in found.items() for word, n in own.items()]
                columns = zip(*rows, strict=True) if rows else ((), (), ())
                types = (pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "word", "n"]
                )

    usable = labelled.where("lang is not null and text is not null")
    sample = in_sample(usable, max_docs).select("text", "lang")
    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word")
    counted = written(counted.agg(F.sum("n").alias("n")), "language-words")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    size = len(public_pieces(vocabulary)) + 2
    p = np.full((size, len(languages)), 1.0 / size)
    p[-2], p[-1] = 0, FLOOR
    for _ in range(rounds if languages else 0):
        now = counted.sparkSession.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = lattice_of(vocabulary)
            total = np.zeros_like(now.value)
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for j, lang in enumerate(languages):
                    own = table.filter(pa.compute.equal(table.column("lang"), lang))
                    words = [START + word for word in own.column("word").to_pylist()]
                    weight = np.array(own.column("n").to_pylist(), float)
                    for places in by_length(words):
                        part = [words[i] for i in places]
                        total[:, j] += expected_counts(part, weight[places], lattice, now.value[:, j])
            piece, lang = np.nonzero(total[:-2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"]
            )

        schema = "piece long, lang long, n double"
        sums = counted.mapInArrow(expect, schema).groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        piece, lang, n = (sums.column(c).to_numpy() for c in ("piece", "lang", "n"))
        total = np.zeros_like(p)
        total[piece, lang] = n
        total[:-2] += 0.01  # pieces that a language lacks
        p = total / total[:-2].sum(axis=0)
        p[-2], p[-1] = 0, FLOOR
    return Model(vocabulary, languages, p)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lattice = model, lattice_of(model.vocabulary)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def learn(self, new: list[str]) -> None:
        scores = np.zeros((len(new), len(self.model.languages)))
        marked = [START + word for word in new]
        for places in by_length(marked):
            scores[places] = log_scores([marked[i] for i in places], self.lattice, self.model.p)
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.scores = np.concatenate((self.scores, scores))

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Log probability of each text in each language; a text without words has zeros."""
        cut = [text_words(text) for text in texts]
        new = set(chain.from_iterable(cut)).difference(self.rows)
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, self.scores = {}, self.scores[:0]
            new = set(chain.from_iterable(cut))
        self.learn(sorted(new))
        out = np.zeros((len(texts), len(self.model.languages)))
        full = [i for i, words in enumerate(cut) if words]
        if full:
            flat = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(cut)), np.int64)
            begins = np.cumsum([0, *(len(cut[i]) for i in full[:-1])])
            out[full] = np.add.reduceat(self.scores[flat], begins)
        return out


def predict(
    docs: DataFrame,
    model: Model,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    within: str | None = None,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """keep columns with lang_pred and score (under other names if given) of each row of docs. The text is a column, or a
    field of the kept struct `within`, which then is passed to Python once.

    score is the posterior probability of the language, all being as likely beforehand, to six places; equal scores go
    to the first language by name. Null text and text without letters, and any text if the model has no language, have
    'und' and 0. Rows are neither merged nor dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*[docs[f"`{c}`"] for c in keep], *([] if within else [docs[f"`{text}`"].alias("__text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for whole in batches:
            if within:
                whole = pa.RecordBatch.from_arrays([*whole.columns, whole.column(within).field(text)], [*keep, "__text"])
            for batch in sized_slices(whole, "__text", BATCH_BYTES):
                scorer = scorer or Scorer(shared.value)
                texts = batch.column("__text").to_pylist()
                lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])
                languages = scorer.model.languages
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                if languages:
                    total = scorer.totals(texts)
                    best = total.argmax(axis=1)
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lang = [languages[b] if languages and ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered & bool(languages), np.round(score, 6), 0.0)
                kept = [batch.column(k) for k in range(len(keep))]
                columns = [*kept, pa.array(lang, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    schema = StructType(own.schema.fields[: len(keep)]).add(names[0], "string").add(names[1], "double")
    return own.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents of this remainder teach nothing."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def identify_languages(docs: DataFrame, vocabulary: str, **learning) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs(doc_id, text, lang), by a model of the rows that are not
    held out and have a lang.

    A row with a null doc_id counts as held out. Null and empty texts, and those without letters, are 'und' with score 0.
    Very long texts and words are read whole. Rows that repeat a doc_id each get an answer, and teach as often as they
    occur; equal scores go to the first language by name. An empty table gives no rows. Only the named columns are read.
    """
    own = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"), held_out(F.col("doc_id")).alias("held_out"))
    model = fit(own.where("not held_out"), vocabulary, **learning)
    return predict(own, model, keep=("doc_id", "held_out"))


def keep_identified(docs: DataFrame, vocabulary: str, *, least: float = 0.5, **learning) -> DataFrame:
    """docs without those rows whose language can't be told: 'und' (null and empty texts, texts without letters, and all
    texts if none is labelled), or a score below `least`.

    Its columns are as they are, whatever their names. Every row is judged by its own text, so rows that repeat a doc_id or
    have none are kept or go by themselves; very long texts are read whole. An empty table stays empty.
    """
    own = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"), held_out(F.col("doc_id")).alias("held_out"))
    model = fit(own.where("not held_out"), vocabulary, **learning)
    rated = predict(packed(docs), model, keep=("row",), within="row")
    return unpacked(rated.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)))
