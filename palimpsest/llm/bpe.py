"""Byte-level BPE encoding and decoding by a rank file, on padded numpy matrices.

The pieces of a batch that are not known yet are put into matrices by length. In each round every row of a matrix merges
its leftmost pair of least rank, found by a hashed pair lookup; rows without a pair left are compacted out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

_NONE = np.int32(2**31 - 1)
#: Longer pieces than this (never a word) are merged by a heap, since a matrix would need a round for each of their bytes.
WIDEST = 512
#: So many pieces and their ids are remembered in a task; then it starts anew.
REMEMBERED = 120_000
BATCH_BYTES = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Rank of the token that two neighbouring tokens form, by open addressing over numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (left, right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        ]
        left, right, rank = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        keys = left << 32 | right
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        place, todo = self._home(keys), np.arange(len(keys))
        while len(todo):  # those that find their slot free take it, one for each slot; the rest move on
            free = self.keys[place[todo]] == -1
            slots, winner = np.unique(place[todo[free]], return_index=True)
            took = todo[free][winner]
            self.keys[slots], self.ranks[slots] = keys[took], rank[took]
            todo = np.setdiff1d(todo, took, assume_unique=True)
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        place = self._home(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[place[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[place[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)
        return out


#: Characters of each class that patterns tell apart, and what they are tried with.
STAND_INS, TRIED_WITH = "b2?\u2028", "a1!"


class Splitter:
    """Matches of a pattern as the library finds them.

    Both know the classes of characters by a version of Unicode of their own. The class of each character beyond ASCII is
    asked of the library when it is first seen, by whether a match holds it together with a letter, a digit, a mark; a
    character of another class here is matched as one that has the class that it has there.
    """

    def __init__(self, pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        single = {bytes([b]): b for b in range(256)}
        pairs = [x.encode() + bytes([b]) for x in TRIED_WITH for b in range(256)]
        self.library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single | {p: 256 + i for i, p in enumerate(pairs)}, special_tokens={})
        self.seen: set[str] = set()
        self.other: dict[int, str] = {}
        # a space between characters that are no white space begins a match
        sides = ["a", "Z", "1", "!", "'", "é", "本", "²", "€", "s"]
        self.by_spaces = all(any(m.start() == len(x) for m in self.pattern.finditer(f"{x} {y}")) for x in sides for y in sides)

    def _there(self, char: str) -> tuple[bool, ...]:
        return tuple(self.library.encode_ordinary(x + char)[0] >= 256 for x in TRIED_WITH)

    def _here(self, char: str) -> tuple[bool, ...]:
        return tuple(self.pattern.findall(x + char)[0] == x + char for x in TRIED_WITH)

    def learn(self, texts: list[str]) -> None:
        new = set(chain.from_iterable(text for text in texts if not text.isascii())) - self.seen
        self.seen |= new
        for char in new:
            if ord(char) > 127 and (there := self._there(char)) != self._here(char):
                like = next((x for x in STAND_INS if self._here(x) == there), None)
                if like is not None:
                    self.other[ord(char)] = like

    def __call__(self, text: str) -> list[str]:
        if self.other and not text.isascii() and any(ord(c) in self.other for c in text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.other))]
        return self.pattern.findall(text)


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.split = Splitter(pattern)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes | None] = {}

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most width bytes, each as packed 32-bit integers."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cells = np.arange(width) < lens[:, None]
        m = np.full((len(pieces), width), -1, np.int32)
        m[cells] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        # rank of the pair that begins in each cell
        pair = np.full((len(pieces), width), _NONE, np.int32)
        r, c = np.nonzero(cells[:, 1:])
        pair[r, c] = self.pairs.find(m[r, c], m[r, c + 1])
        out = [b""] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = pair.argmin(axis=1)  # the leftmost of the least
            least = pair[np.arange(len(row)), at]
            over = least == _NONE
            if over.any():
                ends = np.cumsum(lens[over]) * 4
                flat = m[over][np.arange(m.shape[1]) < lens[over][:, None]].astype("<u4").tobytes()
                for k, b, e in zip(row[over].tolist(), (ends - 4 * lens[over]).tolist(), ends.tolist(), strict=True):
                    out[k] = flat[b:e]
                go = ~over
                m, pair, lens, row, at, least = m[go], pair[go], lens[go], row[go], at[go], least[go]
                if not len(row):
                    break
            n = np.arange(len(row))
            # what stands right of the merged pair moves left by one cell
            source = np.arange(m.shape[1] - 1) + (np.arange(m.shape[1] - 1) > at[:, None])
            m, pair = np.take_along_axis(m, source, 1), np.take_along_axis(pair, source, 1)
            m[n, at] = least
            lens = lens - 1
            has_right, has_left = at + 1 < lens, at > 0
            pair[n, at] = _NONE
            i = n[has_right]
            pair[i, at[i]] = self.pairs.find(m[i, at[i]], m[i, at[i] + 1])
            i = n[has_left]
            pair[i, at[i] - 1] = self.pairs.find(m[i, at[i] - 1], m[i, at[i]])
            if len(lens) and lens.max() < m.shape[1]:
                m, pair = m[:, : lens.max()], pair[:, : lens.max()]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one very long piece, by a heap of its pairs."""
        import heapq

        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        token = [piece[i : i + 1] for i in range(n)]
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j, size = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or right[i] != j or len(token[i]) + len(token[j]) != size:
                continue
            token[i] += token[j]
            ids[i], alive[j], right[i] = rank, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get(token[a] + token[b])) is not None:
                    heapq.heappush(heap, (r, a, b, len(token[a]) + len(token[b])))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def learn(self, pieces: Iterable[str]) -> None:
        """Adds pieces, as matched by the pattern, to the known ones."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.pieces[piece] = rank.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                self.pieces[piece] = np.array(self.merge_long(raw), "<u4").tobytes()
            else:
                width = len(raw) if len(raw) < 24 else 1 << (len(raw) - 1).bit_length()
                by_width.setdefault(width, []).append((piece, raw))
        for width, some in by_width.items():
            at = max(1, 4_000_000 // width)  # cells of a matrix
            for k in range(0, len(some), at):
                part = some[k : k + at]
                self.pieces.update(
                    zip((x for x, _ in part), self.merge_matrix([raw for _, raw in part], width), strict=True)
                )

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian 32-bit integers.

        Where a space between two characters that are no white space always begins a match of the pattern (the splitter has
        tried), what stands between such spaces can be remembered whole, which saves matching the pattern again for every word.
        """
        self.split.learn(texts)
        cut = [text.split(" ") if self.split.by_spaces else [text] for text in texts]
        new = set(chain.from_iterable(parts[1:-1] for parts in cut)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(chain.from_iterable(parts[1:-1] for parts in cut))
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        # the first part has no space before it, and the last may end in white space
        edges = {x for parts in cut for x in (parts[0], " " + parts[-1])}
        matched = {x: self.split(" " + x) for x in new if x and not (x[0].isspace() or x[-1].isspace())}
        of_edges = {x: self.split(x) for x in edges}
        odd = [
            k
            for k, parts in enumerate(cut)
            if len(parts) < 2 or parts[0] == "" or parts[0][-1].isspace() or parts[-1] == "" or parts[-1][0].isspace()
        ]
        for k in odd:
            cut[k] = []
        done: dict[int, list[str]] = {k: self.split(texts[k]) for k in odd}
        wanted = set(chain.from_iterable(chain(matched.values(), of_edges.values(), done.values())))
        self.learn(wanted.difference(self.pieces))
        piece = self.pieces.__getitem__
        self.known.update((x, b"".join(map(piece, m)) if (m := matched.get(x)) else None) for x in new)
        known = self.known.__getitem__
        out = []
        for k, parts in enumerate(cut):
            if parts:
                try:
                    middle = b"".join(map(known, parts[1:-1]))
                except TypeError:  # a part that touches more white space: the pattern decides over the whole text
                    done[k] = self.split(texts[k])
                    self.learn(set(done[k]).difference(self.pieces))
                else:
                    first, last = of_edges[parts[0]], of_edges[" " + parts[-1]]
                    out.append(b"".join((*map(piece, first), middle, *map(piece, last))))
                    continue
            out.append(b"".join(map(piece, done[k])))
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One for each Python worker."""
    return BytePairEncoder(load_ranks(path), pattern)


def _text_slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of pieces of the column of about limit bytes; null is the empty text."""
    size = np.cumsum([x or 0 for x in pa.compute.binary_length(column).to_pylist()])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield at, [x or "" for x in column.slice(at, to - at).to_pylist()]
        at = to


def encoded(docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each row of docs, in no order; null is the empty text, which has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for at, texts in _text_slices(batch.column(1)):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([np.frombuffer(x, np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw (bytes of the text) of ids(doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            raw = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def encode_round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs: digests of the ids as little-endian unsigned
    32-bit integers and of the bytes that they decode to. The ids themselves follow if asked for.

    Null and empty texts have no ids. Rows are neither merged nor dropped, whatever their doc_id; the order of rows and
    further columns play no part. Rows do not meet, so there is no shuffle, and a task holds one slice of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for at, texts in _text_slices(batch.column(1)):
                ids = bpe.encode(texts)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return own.mapInArrow(run, schema)
