"""Token ids in binary files, as bit or byte planes.

A file holds fixed-size blocks of 32-bit ids. Each block is transposed into its planes (the k-th bit, or byte, of all its
ids side by side), and each plane is compressed with zstandard by itself, so the high planes, which are nearly constant,
take almost no room. After the blocks follow the chunk index (offset, ids, size of each plane) and the document table
(doc_id, ids), both as Arrow streams, and their places.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch, written
from palimpsest.llm.files import opened, output, sized_slices

MAGIC = b"PLANES01"
#: Places of the chunk index, of the document table and of their ends.
TRAILER = struct.Struct("<QQQ8s")
BATCH_BYTES = 4_000_000
#: So many words, and parts of words, are remembered in a task; then it starts anew.
REMEMBERED = 900_000


def to_planes(ids: np.ndarray, bits: bool) -> list[np.ndarray]:
    """32 bit planes or 4 byte planes of 32-bit ids, least significant first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return list(np.ascontiguousarray(raw.T))
    by_byte = np.unpackbits(np.ascontiguousarray(raw.T), axis=1, bitorder="little").reshape(4, -1, 8)
    return list(np.packbits(by_byte.transpose(0, 2, 1).reshape(32, -1), axis=1))


def from_planes(planes: list[np.ndarray], n: int, bits: bool) -> np.ndarray:
    if bits:
        rows = np.unpackbits(np.stack(planes), axis=1)[:, :n].reshape(4, 8, n).transpose(0, 2, 1)
        raw = np.packbits(np.ascontiguousarray(rows), axis=2, bitorder="little").reshape(4, n)
    else:
        raw = np.stack(planes)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _stream(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue()


class PlaneWriter:
    def __init__(self, out, block: int, bits: bool, level: int = 3):
        self.out, self.block, self.bits = out, block, bits
        self.press = zstandard.ZstdCompressor(level=level).compress
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.index: list[tuple[int, int, list[int]]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            whole = np.concatenate(self.waiting)
            full = len(whole) - len(whole) % self.block
            for k in range(0, full, self.block):
                self._block(whole[k : k + self.block])
            self.waiting, self.n_waiting = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        offset, sizes = self.at, []
        for plane in to_planes(ids, self.bits):
            packed = self.press(plane.tobytes()) if plane.any() else b""  # a plane of zeros has no bytes
            sizes.append(len(packed))
            self._put(packed)
        self.index.append((offset, len(ids), sizes))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        index_at = self.at
        offset, n_ids, sizes = zip(*self.index, strict=True) if self.index else ((), (), ())
        columns = [pa.array(offset, pa.int64()), pa.array(n_ids, pa.int64()), pa.array(sizes, pa.list_(pa.int32()))]
        self._put(_stream(pa.table(columns, ["offset", "n_ids", "sizes"])))
        docs_at = self.at
        columns = [pa.array(self.doc_ids, pa.int64()), pa.array(self.counts, pa.int64())]
        self._put(_stream(pa.table(columns, ["doc_id", "n_ids"])))
        self._put(TRAILER.pack(index_at, docs_at, self.at, (b"BITS" if self.bits else b"BYTE") + MAGIC[-4:]))


class PlaneReader:
    """Blocks are found by the index, so any of them can be read alone."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        f.seek(size - TRAILER.size)
        index_at, docs_at, end, mark = TRAILER.unpack(f.read(TRAILER.size))
        if mark[4:] != MAGIC[-4:]:
            raise ValueError("not a file of planes")
        self.bits = mark[:4] == b"BITS"
        f.seek(index_at)
        self.index = pa.ipc.open_stream(f.read(docs_at - index_at)).read_all().to_pylist()
        f.seek(docs_at)
        self.docs = pa.ipc.open_stream(f.read(end - docs_at)).read_all()
        self.unpress = zstandard.ZstdDecompressor().decompress

    def block(self, k: int) -> np.ndarray:
        row = self.index[k]
        n = row["n_ids"]
        width = -(-n // 8) if self.bits else n
        self.f.seek(row["offset"])
        planes = []
        for size in row["sizes"]:
            raw = self.unpress(self.f.read(size), max_output_size=width) if size else bytes(width)
            planes.append(np.frombuffer(raw, np.uint8))
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """doc_id, its number of ids, and its ids in parts (to be read before the next document)."""
        k, held = 0, np.zeros(0, np.uint32)

        def parts(n: int) -> Iterator[np.ndarray]:
            nonlocal k, held
            while n > 0:
                if not len(held):
                    held = self.block(k)
                    k += 1
                part, held = held[:n], held[n:]
                n -= len(part)
                yield part

        for doc_id, n in zip(*(self.docs.column(c).to_pylist() for c in ("doc_id", "n_ids")), strict=True):
            yield doc_id, n, parts(n)


#: The tokenizer's own split of a lower-case ASCII word without white space; what of it is printable.
PRINTABLE = re.compile(rb"[!-~]+").fullmatch
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


#: What split() takes for granted of a tokenizer's file.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class WordTokenizer:
    """Ids by the tokenizers library of texts whose white space the tokenizer drops and never looks across.

    Each word between ASCII white space is encoded once and remembered. Of ASCII words, which differ by case and marks
    more often than by letters, the library gets the parts that it would split them into.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        found = json.loads(self.tokenizer.to_str())
        if (found["normalizer"], found["pre_tokenizer"]) != (NORMALIZER, SPLITTER) or found["post_processor"]:
            raise ValueError(f"{path} normalises or splits texts in another way than is assumed here")
        # parts that its normalizer and splitter would leave as they are go straight to its model
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = self.model.pre_tokenizer = None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def learn(self, parts: set[bytes]) -> None:
        plain = {x for x in parts if PRINTABLE(x) and b"<" not in x}
        latin = {x for x in parts - plain if (text := x.decode()).isalpha() and self.latin(text)}
        self._encode(self.model, list(plain), bytes.decode)
        # the model knows a byte by a character: printable ones by their Latin-1 character, others by those from 256 on
        self._encode(self.model, list(latin), lambda x: x.decode("latin-1").translate(BYTE_CHARACTERS))
        self._encode(self.tokenizer, list(parts - plain - latin), bytes.decode)

    @staticmethod
    def latin(word: str) -> bool:
        """Lower-casing and composing leave such a lower-case word as it is."""
        return max(word) < "\u0180" and word.islower() and is_normalized("NFC", word)

    def _encode(self, tokenizer, parts: list[bytes], text) -> None:
        for k in range(0, len(parts), 20_000):
            some = parts[k : k + 20_000]
            found = tokenizer.encode_batch_fast(list(map(text, some)), add_special_tokens=False)
            ids = [e.ids for e in found]
            flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            at = 0
            for part, own in zip(some, ids, strict=True):
                self.parts[part] = flat[at : (at := at + 4 * len(own))]

    def split(self, word: bytes) -> list[bytes]:
        if word.isalpha():  # of bytes: ASCII letters
            return [word.lower()]
        if word.isascii() and not (b"<" in word and any(x in word for x in self.special)):
            return ASCII_PARTS(word.lower())
        text = word.decode()
        body, mark = (text[:-1], text[-1:]) if text[-1] in ",.;:!?" else (text, "")
        if body.isalpha() and self.latin(low := body.lower()):
            return [low.encode(), mark.encode()] if mark else [low.encode()]
        return [word]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        cut = [text.split() for text in texts]
        new = set(chain.from_iterable(cut)).difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = set(chain.from_iterable(cut))
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        split = {word: self.split(word) for word in new}
        self.learn(set(chain.from_iterable(split.values())).difference(self.parts))
        part = self.parts.__getitem__
        for word, x in split.items():
            self.words[word] = part(x[0]) if len(x) == 1 else b"".join(map(part, x))
        word = self.words.__getitem__
        return [b"".join(map(word, x)) for x in cut]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)


def write_planes(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    block: int = 65_536,
    bits: bool = False,
) -> tuple[str, DataFrame]:
    """Folder of the files written, and their table: file_no, name, n_docs, n_ids, start (ids in all files before).

    Documents lie in ascending doc_id order through the files in the order of file_no: texts are dealt by ranges of
    doc_id and sorted there, and each task streams its range into one file. Rows without a doc_id come first; rows of one
    doc_id stay in the order of their texts.
    """
    folder = scratch(docs.sparkSession, "planes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        tokens, no = word_tokenizer(tokenizer_path), TaskContext.get().partitionId()
        name, end = f"part-{no:06d}.planes", np.array([end_id], "<u4").tobytes()
        with output(folder, name) as out:
            planes = PlaneWriter(out, block, bits)
            for whole in chain([first], batches):
                for batch in sized_slices(whole, "text", BATCH_BYTES):
                    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                    for key, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(texts), strict=True):
                        planes.add(key, np.frombuffer(ids + end, "<u4"))
            planes.close()
        yield pa.RecordBatch.from_pylist(
            [{"file_no": no, "name": name, "n_docs": len(planes.counts), "n_ids": planes.n_ids}]
        )

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(dealt.mapInArrow(write, "file_no long, name string, n_docs long, n_ids long"), "plane-files")
    # one row for each file: few enough for one window
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return folder, files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_planes(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) of each document in the files. A task reads one block at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(folder, name) as f:
                    rows = []
                    for doc_id, n, parts in PlaneReader(f).documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.tobytes(), crc)
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) == 50_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    n = max(1, files.count())
    spread = files.select("name", "start").repartition(n, "name")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def plane_round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of docs, from files of planes that are written and read again.

    Null and empty texts have the end id alone. A null doc_id sorts first; rows that repeat a doc_id each come out. An
    empty table writes no file and gives no rows. Only the named columns are read.
    """
    return read_planes(*write_planes(docs, tokenizer_path, **options))
