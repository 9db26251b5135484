"""BPE encoding and decoding with a public vocabulary file of word-end BPE.

A word is held as two contiguous lists, its parts and the ranks of neighbouring parts. The
least rank is looked up again and again (leftmost first), the boundary there is deleted and
the two neighbouring ranks are refreshed. That is quadratic, so words of over SHORT symbols
keep the same order of merges in a heap over linked parts instead.

Tasks are independent maps over whole texts; the vocabulary (fixed, about 2 MB) is read on
the driver and broadcast, and each Python worker remembers the words it has met, up to a
bound on their number. Python, `regex` and the library follow different versions of Unicode,
so the driver asks the library once for the lower case and the class of every character and
sends the differences along.

Texts of any length are encoded whole, a chunk between blanks after the other, in time that
grows as the length (with its logarithm inside a word).

Defined results: a null text is empty; an empty text has no ids and decodes to the empty
text; the strings of special tokens become their ids wherever they stand; an empty table
gives an empty table. Of the input only doc_id and the text column are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.util import Memo, per_worker

#: Words of more symbols than this use the heap.
SHORT = 256
#: Chunks and words that a worker remembers (each up to twice as many); longer ones than MEMO_LENGTH are not kept.
MEMO_ITEMS, MEMO_LENGTH = 150_000, 64
#: White space in Unicode's sense (fixed values).
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def lowered(text: str) -> str:
    # Letters are lowered one by one: a capital sigma has no final form.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Unlike(NamedTuple):
    """Characters that the library lowers or classes otherwise than Python does: to what it lowers them, and a character of the class it puts them in."""

    lower: dict[int, str]
    stand_in: dict[int, str]


@lru_cache(maxsize=4)
def unlike(definition: bytes) -> Unlike:
    """What the library's normaliser and pre-tokenizer do to single characters, where that differs."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(definition.decode())
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    known = regex.findall(r"[^\p{Cn}\p{Co}\s.]", every)
    lower = {ord(c): x for c, x in zip(known, library.normalizer.normalize_str(".".join(known)).split(".")) if x != lowered(c)}

    def joined(chars: list[str], to: str) -> set[str]:
        """Those of the characters that are one piece with the one after them."""
        text = " ".join(c + to for c in chars)
        return {text[a] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text) if b - a == 2}

    classed = regex.findall(r"[\p{L}\p{N}]", every)
    letters = joined(classed, "a")
    rest = [c for c in classed if c not in letters]
    marks = joined(rest, "_")
    stand_in = {ord(c): "a" for c in letters if not regex.match(r"\p{L}", c)} | {ord(c): "_" for c in marks}
    return Unlike(lower, stand_in | {ord(c): "0" for c in rest if c not in marks and not regex.match(r"\p{N}", c)})


class Codec:
    """Encodes and decodes with a vocabulary of the kind of word_bpe_49k.json."""

    def __init__(self, definition: bytes, differ: Unlike | None = None):
        spec = json.loads(definition)
        self.unlike = differ or unlike(definition)
        model = spec["model"]
        self.vocab = {**model["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = [b""] * (max(self.vocab.values()) + 1)
        for token, i in self.vocab.items():
            self.tokens[i] = token.encode()
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.letters = byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.by_word = Memo(self.encode_word, MEMO_ITEMS)
        self.by_chunk = Memo(self.encode_chunk, MEMO_ITEMS)

    def encode_word(self, word: str) -> bytes:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        parts = [self.vocab[s] for s in symbols if s in self.vocab]
        return np.asarray(self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts), "<u4").tobytes()

    def merge_short(self, parts: list[int]) -> list[int]:
        merges, none = self.merges, (1 << 60, -1)
        ranks = [merges.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks))[1] >= 0:
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := self.merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (*m, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            words = self.words.findall(chunk.lower())
        else:
            low = lowered(unicodedata.normalize("NFC", chunk).translate(self.unlike.lower))
            classed = low.translate(self.unlike.stand_in)
            words = self.words.findall(low) if classed == low else [low[m.start() : m.end()] for m in self.words.finditer(classed)]
        return b"".join([self.by_word[w] if len(w) <= MEMO_LENGTH else self.encode_word(w) for w in words])

    def encode_plain(self, text: str) -> bytes:
        # No token holds white space, so a text can be cut at any blank or line end.
        chunks = text.replace("\n", " ").split(" ")
        if len(text) > MEMO_LENGTH * len(chunks):
            return b"".join([self.by_chunk[c] if len(c) <= MEMO_LENGTH else self.encode_chunk(c) for c in chunks])
        return b"".join(map(self.by_chunk.__getitem__, chunks))

    def encode(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit integers."""
        found, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            found += [self.encode_plain(text[at:m.start()]), np.asarray([self.vocab[m[0]]], "<u4").tobytes()]
            at = m.end()
        found.append(self.encode_plain(text[at:] if at else text))
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8: the file names no decoder, so tokens are joined by blanks."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(sent: tuple[bytes, Unlike]) -> Codec:
    """One codec per Python worker and vocabulary."""
    return per_worker(("codec", hash(sent[0])), lambda: Codec(*sent))


def broadcast_of(spark: SparkSession, vocabulary: str):
    """The vocabulary file and the characters that differ, for `codec`: both of fixed size."""
    definition = Path(vocabulary).read_bytes()
    return spark.sparkContext.broadcast((definition, unlike(definition)))


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    held = broadcast_of(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for batch in batches:
            ids = [own.encode(t.as_py() or "").astype("int32") for t in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    held = broadcast_of(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for batch in batches:
            texts = [own.decode(np.asarray(ids.as_py() or [], "int64")).decode() for ids in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Each text encoded and decoded again in one pass: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    held = broadcast_of(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for batch in batches:
            lengths, ids_sha, decoded_sha = [], [], []
            for value in batch[1]:
                ids = own.encode(value.as_py() or "")
                lengths.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(lengths, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return digests(docs, vocabulary or default_vocabulary())
