"""The corpus pipeline: documents through five stages, each written and read again.

Language ID drops texts in no learned language; line dedup drops lines that many documents
share; near-dedup keeps one document of each class; mixing repeats and samples documents
towards the sources' targets; encoding gives each document's tokens as digests. All but the
last return the columns of documents, n_chars following the text.

Defined results: a null or empty text, or one without letters, is in no language and goes; a
null lang, source or n_chars stays as it is (null is a source of its own); rows that share a
doc_id are judged row by row, but are one document to line dedup and near-dedup; a null doc_id
is no near duplicate and never keeps a line; of equal texts that with the least doc_id stays;
very long texts are treated whole; columns beyond those of documents pass through all stages
but the last, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, langid, linededup, mixing, omh
from quire.llm.util import documents, stage

#: Cosine to the nearest language below which a text is rejected; running text is far above.
LEAST_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs)
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).drop("__lang", "__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(docs)
    named = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.char_length("__kept").cast(docs.schema["n_chars"].dataType)
    return found.withColumns(named).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return omh.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(mixing.mix(docs)).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_tokens),
]
#: Language prototypes and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
