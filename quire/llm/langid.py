"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (from a seeded generator and its code point).
A trigram is the product of its letters' vectors, the first rotated by two places and the
second by one, so order matters. A text is the sum of its trigram vectors; a language is the
sum of its texts, each at unit length. The cosine between text and language decides.

Learning is one pass in which every task returns one sum per language it met; Spark adds
these up. Prototypes are languages x DIMENSIONS numbers, bound by MAX_LANGUAGES. Nothing
else of the corpus is held anywhere.

Defined results: a null text, and one without letters (marks alone are none), is `und` with
score 0; nothing to learn from makes every text `und`; of languages with equal cosines the
first in order is taken; rows that repeat count as often as they stand there;
null doc_ids are not held out and are learned from; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.util import Memo, per_worker

DIMENSIONS = 512
SEED = 20260101
#: Learned languages; more raise an error, for the prototypes are broadcast.
MAX_LANGUAGES = 1000
#: Learning takes texts in the order of a hash of doc_id, up to about this many (documented bound; prediction has none).
MAX_LEARNED = 40_000
#: Letters of a text that go into one count of trigrams; longer texts are counted in such steps.
STEP = 1 << 20
#: Trigrams whose vectors a worker remembers: as many rows of DIMENSIONS bytes.
MEMO_GRAMS = 60_000

NOT_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


class Space:
    """Trigram vectors, made on demand."""

    def __init__(self):
        self.letters = Memo(self.letter, 20_000)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, DIMENSIONS), "int8")

    def letter(self, code: int) -> np.ndarray:
        return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], "int8"), DIMENSIONS)

    def gram(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letters[a], 2) * np.roll(self.letters[b], 1) * self.letters[c]

    def row(self, key: int) -> int:
        at = self.rows.get(key)
        if at is None:
            at = self.rows[key] = len(self.rows)
            if at == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
            self.matrix[at] = self.gram(key)
        return at

    def vector(self, text: str | None) -> np.ndarray | None:
        """The sum of the trigram vectors of the text, or None without letters."""
        bare = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
        if not LETTER.search(bare):
            return None
        total = np.zeros(DIMENSIONS, "float32")
        codes = np.frombuffer(f" {bare} ".encode("utf-32-le"), "<u4").astype("int64")
        for at in range(0, len(codes) - 2, STEP):
            part = codes[at : at + STEP + 2]
            keys, counts = np.unique(part[:-2] << 42 | part[1:-1] << 21 | part[2:], return_counts=True)
            for i in range(0, len(keys), 1024):
                if len(self.rows) > MEMO_GRAMS:
                    self.forget()
                rows = [self.row(k) for k in keys[i : i + 1024].tolist()]
                total += counts[i : i + 1024].astype("float32") @ self.matrix[rows].astype("float32")
        return total


def space() -> Space:
    return per_worker("trigrams", Space)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes at unit length, from the columns text and lang."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums, counts = space(), {}, {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                vector = own.vector(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector / max(float(np.linalg.norm(vector)), 1e-9)
                    counts[lang] = counts.get(lang, 0) + 1
        if sums:
            yield pd.DataFrame({"lang": list(sums), "n": list(counts.values()), "v": [s.astype("float64") for s in sums.values()]})

    parts = labelled.where("lang IS NOT NULL").select("text", "lang").mapInPandas(add, "lang string, n long, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1)
    rows = whole.collect()  # at most MAX_LANGUAGES rows
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    langs = [r["lang"] for r in rows]
    vectors = np.array([[x["x"] for x in r["v"]] for r in rows]).reshape(len(rows), DIMENSIONS)
    return langs, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (all, if None) with __lang and __score: the language of greatest cosine and that cosine, at 0 or more."""
    names = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast((langs, prototypes.astype("float32")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (langs, prototypes) = space(), held.value
        for batch in batches:
            found, scores = [], []
            for value in batch["__text"]:
                vector = own.vector(value.as_py()) if langs else None
                if vector is None:
                    found.append("und")
                    scores.append(0.0)
                else:
                    cosines = prototypes @ (vector / max(float(np.linalg.norm(vector)), 1e-9))
                    best = int(np.argmax(cosines))
                    found.append(langs[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            columns = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "__lang", "__score"])

    kept = docs.select(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "__lang string", "__score double"])
    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(run, schema)


def sample_to_learn(docs: DataFrame, most: int = MAX_LEARNED) -> DataFrame:
    """Labelled rows that are not held out, about `most` of them, taken by a hash of doc_id."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    n = labelled.select("lang").count()
    share = 1.0 if n <= most else most / n
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def identify(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs with __lang and __score, learned from `known` (or docs themselves)."""
    return predict(docs, *learn(sample_to_learn(docs if known is None else known)))


def op4_language_id(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    langs, prototypes = learn(sample_to_learn(slim))
    found = predict(slim, langs, prototypes, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
