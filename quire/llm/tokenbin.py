"""Token-ID files: independent zstandard frames, a trailing seek table and checksums.

One file per range of doc_id. Each document is one frame; after the frames come a skippable
frame that lists the doc_ids in file order and a seek table in the public seekable format
(compressed size, size and low 32 bits of XXH64 per frame). A reader takes the tail of a
file, finds a document by binary search and decompresses only its frame.

Texts are encoded by the tokenizers library. A text is cut before single blanks, where
byte-level BPE of this kind always cuts too, and a worker remembers the ids of pieces it has
met, so the library encodes each distinct piece about once per worker. New pieces of a word
and a mark, or of two lines, are put together from pieces met before.

Files are written under names of their own to the shared folder and count only if their task
succeeded, which is what the manifest (Parquet) lists: lost executors and repeated tasks
leave unlisted files, never wrong ones.

Defined results: a null or empty text has only the end id; null doc_ids come last; equal
doc_ids are ordered by a hash of the text; an empty table gives no files and no rows. Of the
input only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bpe import byte_letters
from quire.llm.util import Memo, new_path, per_worker, stage

#: Fixed values of the seekable format and of skippable frames.
SKIPPABLE, SEEK_TABLE, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HEAD = struct.Struct("<q?3x")  # doc_id, whether it is null
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
#: Pieces that a worker remembers (up to twice as many).
MEMO_ITEMS = 1_000_000
#: Letters below are Latin ones that every version of Unicode classes alike; marks that are pre-tokens of their own after a word.
PLAIN_END, MARKS = "\u0250", set(",.;:!?")
#: Bytes of neighbouring frames that a full read asks for at once.
READ_AHEAD = 4 << 20


def opened(path: str):
    """The pyarrow file system and path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class Odd(Exception):
    """White space stands before a blank."""


class PieceEncoder:
    """The ids of whole texts by the tokenizers library, with a memory of pieces."""

    runs = re.compile(r"\s*\S+|\s+")
    signed = re.compile(r"([A-Za-z]+)([!-&(-/:;=-@[-`{-~]+)")  # no apostrophe, and no < of a special token
    words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition.decode())
        self.library.no_padding()
        self.library.no_truncation()
        self.tokenize = self.library.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.blank = self.letters[ord(" ")]
        self.after_blank = Memo(self.encode_after_blank, MEMO_ITEMS)
        self.bare = Memo(lambda part: self.encode_piece(part, ""), MEMO_ITEMS // 10)
        self.by_token = Memo(self.tokenized, MEMO_ITEMS // 10)
        self.line_end = self.tokenized("\n")

    def tokenized(self, word: str) -> bytes:
        """The ids of one pre-token by the library's model."""
        return self.spelt(word.translate(self.letters) if word.isascii() else word.encode().decode("latin-1").translate(self.letters))

    def spelt(self, word: str) -> bytes:
        """The ids of one pre-token whose bytes are spelt as letters."""
        return array("I", [t.id for t in self.tokenize(word)]).tobytes()

    def encode_piece(self, piece: str, blank: str = " ") -> bytes:
        """The ids of a piece after a blank (or none). Plain words and marks are pre-tokens for certain and go straight to the library's BPE model; all else takes the library's whole way."""
        if piece < PLAIN_END and max(piece) < PLAIN_END:
            if piece.isalpha():
                return self.tokenized(blank + piece)
            word, mark = piece[:-1], piece[-1]
            if mark in MARKS and word.isalpha():
                return (self.after_blank if blank else self.bare)[word] + self.bare[mark]
            if piece in MARKS:
                return self.tokenized(blank + piece)
            lines = piece.split("\n")
            if len(lines) > 1 and not any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
                return (self.after_blank if blank else self.bare)[lines[0]] + b"".join([self.line_end + self.bare[x] for x in lines[1:]])
            if piece.isprintable() and "<" not in piece:
                return b"".join(map(self.by_token.__getitem__, self.words.findall(blank + piece)))
        return np.asarray(self.library.encode(blank + piece, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_after_blank(self, part: str) -> bytes:
        if part.isascii():  # most are a word of letters that spell themselves, and perhaps a mark
            if part.isalpha():
                return self.spelt(self.blank + part)
            word = part[:-1]
            if word.isalpha() and part[-1] in MARKS:
                return self.after_blank[word] + self.bare[part[-1]]
            if found := self.signed.fullmatch(part):
                return self.after_blank[found[1]] + self.bare[found[2]]
        if not part or part[0].isspace():
            raise Odd
        return self.encode_piece(part)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            found = list(map(self.after_blank.__getitem__, rest))
        except Odd:
            return b"".join([self.encode_piece(x, "") for x in self.runs.findall(text)])
        return (self.encode_piece(first, "") if first else b"") + b"".join(found)


def encoder(definition: bytes) -> PieceEncoder:
    return per_worker(("pieces", hash(definition)), lambda: PieceEncoder(definition))


class FrameWriter:
    """Appends documents to one file."""

    def __init__(self, path: str, level: int = 3):
        import zstandard

        system, name = opened(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.frames, self.ids = system.open_output_stream(name, compression=None), [], []
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        raw = HEAD.pack(doc_id or 0, doc_id is None) + ids
        frame = self.press.compress(raw)
        self.out.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append((1 << 63) - 1 if doc_id is None else doc_id)

    def close(self) -> None:
        listed = np.asarray(self.ids, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(listed)) + listed)
        table = np.asarray(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, FOOTER)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        import zstandard

        system, name = opened(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER or not flags & 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        self.table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype("int64")
        self.ids = np.frombuffer(self.file.read_at(8 * n, size - 9 - 12 * n - 8 - 8 * n), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.open = zstandard.ZstdDecompressor()

    def unpack(self, i: int, frame) -> tuple[int | None, np.ndarray]:
        import xxhash

        raw = self.open.decompress(frame)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} fails its checksum")
        doc_id, null = HEAD.unpack_from(raw)
        return None if null else doc_id, np.frombuffer(raw, "<u4", offset=HEAD.size)

    def frame(self, i: int) -> tuple[int | None, np.ndarray]:
        return self.unpack(i, self.file.read_at(int(self.table[i, 0]), int(self.starts[i])))

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of that doc_id."""
        lo, hi = np.searchsorted(self.ids, doc_id, "left"), np.searchsorted(self.ids, doc_id, "right")
        return [self.frame(i)[1] for i in range(lo, hi)]

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        i, n = 0, len(self.table)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + READ_AHEAD, "right")) - 1)
            held = memoryview(self.file.read_at(int(self.starts[j] - self.starts[i]), int(self.starts[i])))
            for k in range(i, j):
                at = int(self.starts[k] - self.starts[i])
                yield self.unpack(k, held[at : at + int(self.table[k, 0])])
            i = j


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents in ascending doc_id; the manifest: shard (in order), path, n_docs, n_tokens."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    held = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    place = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, *place).sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, end = encoder(held.value), TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes()
        path, out, n_tokens = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.zst", None, 0
        for batch in batches:
            for doc_id, text in zip(batch[0], batch[1]):
                ids = own.encode(text.as_py() or "")
                out = out or FrameWriter(path)
                out.add(doc_id.as_py(), ids + end)
                n_tokens += len(ids) // 4 + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(out.ids)], pa.int64()), pa.array([n_tokens], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    return stage(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """All documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")
    files = manifest.select("shard", "path", before.alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                rows, start = [], row.before
                for doc_id, ids in FrameReader(row.path).all():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                made = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield made.astype({"doc_id": "Int64"})

    return files.repartitionByRange(n, "shard").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted doc_ids only; every file is opened once and gives only the frames asked for."""
    asked = wanted.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    spans = manifest.select("shard", "path")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = FrameReader(row.path).ids
                yield pd.DataFrame({"path": [row.path], "low": [ids[0]], "high": [ids[-1]]})

    ranges = spans.mapInPandas(ends, "path string, low long, high long")
    asks = asked.join(ranges, (F.col("doc_id") >= F.col("low")) & (F.col("doc_id") <= F.col("high"))).select("path", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, reader = None, None
        for batch in batches:
            for row in batch.itertuples():
                if row.path != path:
                    path, reader = row.path, FrameReader(row.path)
                found = reader.find(row.doc_id)
                if found:
                    yield pd.DataFrame({"doc_id": [row.doc_id] * len(found), "ids": [x.astype("int32") for x in found]})

    return asks.repartition("path").sortWithinPartitions("path", "doc_id").mapInPandas(run, "doc_id long, ids array<int>")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return read_token_files(write_token_files(docs, vocabulary or default_vocabulary()))
