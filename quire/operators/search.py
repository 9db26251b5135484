"""Searching, replacing and deleting literal terms in segments of documents.

A segment is a row with its keys and `lines` (array of string). Terms are an argument, as
in any search; they travel with the plan, up to FEW as literals and more as one automaton, so
a scan is one map over the segments and nothing is joined. Caps are parameters and off unless asked for; totals are always of
all segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import count_hits, find_spans, flat, folded, preview
from quire.operators.ranks import running
from quire.operators.terms import edited, many_hits

#: Terms longer than this are refused, as are more terms than a plan should hold.
MAX_TERM, MAX_TERMS = 200, 5_000
#: Up to so many terms are searched one after the other as column expressions.
FEW = 32


def clean_terms(terms: Sequence[str]) -> list[str]:
    """Trimmed terms in order, without blanks and repeats."""
    found = list(dict.fromkeys(t.strip() for t in terms if t and t.strip()))
    if not found:
        raise ValueError("no valid terms")
    if len(found) > MAX_TERMS or any(len(t) > MAX_TERM for t in found):
        raise ValueError(f"at most {MAX_TERMS} terms of at most {MAX_TERM} characters")
    return found


def segments(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One segment per document: its key and lines."""
    return docs.select(key, F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))


def line_segments(docs: DataFrame, per_page: int = 49, text: str = "text") -> DataFrame:
    """One segment per line: doc_id, page (per_page lines each), para (line of the document) and lines."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("para", "line"))
    return rows.select("doc_id", (F.floor(F.col("para") / per_page) + 1).cast("int").alias("page"), "para", F.array("line").alias("lines"))


def table_segments(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells for table-like blocks, else the lines of the paragraph."""
    shared = ["doc_id", "page", "para"]
    plain = paragraphs.where("NOT table_like").select(*shared, F.lit(None).cast("int").alias("cell_row"), F.lit(None).cast("int").alias("cell_col"), "lines", "table_like")
    tables = paragraphs.where("table_like").select(*shared, "table_like").join(cells.select(*shared, F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), F.array("text").alias("lines")), shared)
    return plain.unionByName(tables)


def find_text(segs: DataFrame, term: str, ignore_case: bool = False, cap: int | None = None) -> DataFrame:
    """Segments with the term: count, spans and a preview of the first hit. With a cap, the first per document and `truncated`."""
    text, needle = flat("lines"), F.lit(term)
    hay, low = folded(text, needle, ignore_case)
    found = segs.where(hay.contains(low)).withColumn("spans", find_spans(text, needle, ignore_case))
    first = F.get("spans", F.lit(0))
    out = found.withColumns({"count": F.size("spans").cast("long"), "preview": preview(text, first["a"], first["b"])})
    if cap is None:
        return out
    keys = [c for c in segs.columns if c not in ("lines", "doc_id")]
    place = Window.partitionBy("doc_id")
    return (out.withColumn("seq", F.row_number().over(place.orderBy(*keys))).withColumn("truncated", F.count(F.lit(1)).over(place) > cap)
            .where(F.col("seq") <= cap))


def term_hits(segs: DataFrame, terms: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """One row per segment and term that it holds: the segment's keys, ord, term and count."""
    words = clean_terms(terms)
    if len(words) > FEW:
        return many_hits(segs, words, ignore_case)
    text = flat("lines")
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(w).alias("term")) for i, w in enumerate(words)])
    keys = [c for c in segs.columns if c != "lines"]
    held = segs.withColumn("__text", text).where(any_of(F.col("__text"), words, ignore_case))
    # Counted beside each other, so that only terms with hits become rows and none carries the text.
    counted = F.transform(listed, lambda x: F.struct(x["ord"].alias("ord"), x["term"].alias("term"), count_hits(F.col("__text"), x["term"], ignore_case).alias("count")))
    return held.select(*keys, F.inline(F.filter(counted, lambda x: x["count"] > 0)))


def any_of(text: Column, words: Sequence[str], ignore_case: bool) -> Column:
    """Whether the text holds any of the words: a cheap test before terms are told apart. More than FEW are not tested."""
    met = F.lit(len(words) > FEW)
    for w in words[: 0 if len(words) > FEW else None]:
        hay, needle = folded(text, F.lit(w), ignore_case)
        met = met | hay.contains(needle)
    return met


def scan_terms(segs: DataFrame, terms: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Segments with any term: words (a sorted set) and the count of the first of them."""
    keys = [c for c in segs.columns if c != "lines"]
    return term_hits(segs, terms, ignore_case).groupBy(*keys).agg(
        F.min_by("count", "ord").alias("count"), F.array_sort(F.collect_set("term")).alias("words"))


def term_counts(segs: DataFrame, terms: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """ord, term, segments and total of every term, 0 where it is never found."""
    spark = segs.sparkSession
    hits = term_hits(segs, terms, ignore_case).groupBy("ord").agg(F.count(F.lit(1)).alias("segments"), F.sum("count").alias("total"))
    every = spark.createDataFrame(list(enumerate(clean_terms(terms))), "ord int, term string")
    return every.join(hits, "ord", "left").na.fill(0, ["segments", "total"])


def missing_terms(segs: DataFrame, terms: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """The terms that no segment holds."""
    every = segs.sparkSession.createDataFrame(list(enumerate(clean_terms(terms))), "ord int, term string")
    return every.join(term_hits(segs, terms, ignore_case).select("term").distinct(), "term", "left_anti").select("ord", "term")


def restrict_to_targets(hits: DataFrame, targets: DataFrame, keys: Sequence[str] = ("doc_id", "page", "para", "cell_row", "cell_col")) -> DataFrame:
    """Hits at the chosen places only; missing cells are equal to missing cells."""
    named = targets.select(*[F.col(k).alias(f"__{k}") for k in keys])
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return hits.join(named, met, "left_semi")


def replace_all(segs: DataFrame, term: str, replacement: str, ignore_case: bool = False, cap: int | None = None) -> DataFrame:
    """Changed segments only: new_lines and occurrences. With a cap, the rest of a document is marked skipped."""
    found = edited(segs.where(any_of(flat("lines"), [term], ignore_case)), [term], replacement, ignore_case)
    found = found.drop("removed").withColumnRenamed("hits", "occurrences").where("new_lines <> lines")
    if cap is None:
        return found.withColumn("skipped", F.lit(False))
    keys = [c for c in segs.columns if c not in ("lines", "doc_id")]
    return found.withColumn("skipped", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys)) > cap)


def delete_terms(segs: DataFrame, terms: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Segments with hits: new_lines without them, raw hits, and removed (hits that overlap or touch are one)."""
    words = clean_terms(terms)
    return edited(segs.where(any_of(flat("lines"), words, ignore_case)), words, "", ignore_case)


def residue(segs: DataFrame, terms: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Segments per term that still hold it; a clean result has no rows."""
    return term_hits(segs, terms, ignore_case).groupBy("ord", "term").agg(F.count(F.lit(1)).alias("segments"))


def edit_stats(before: DataFrame, after: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row: edits, occurrences, removed, and what residue and missing count. `before`: delete_terms or replace_all."""
    left = residue(after, terms)
    n_left = left.agg(F.coalesce(F.sum("segments"), F.lit(0)).alias("residue"))
    amounts = [c for c in ("occurrences", "hits", "removed") if c in before.columns]
    done = before.agg(F.count(F.lit(1)).alias("edits"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in amounts])
    return done.withColumn("k", F.lit(1)).join(n_left.withColumn("k", F.lit(1)), "k").drop("k")


def hit_numbers(hits: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Numbers from 0 in the given order, with the next and previous in a circle; apart for each `by`, else over all hits, whose ranges are counted apart."""
    if by:
        place = Window.partitionBy(*by)
        numbered = hits.withColumns({"number": (F.row_number().over(place.orderBy(*order)) - 1).cast("long"), "__n": F.count(F.lit(1)).over(place)})
    else:
        numbered = running(hits, [], order, {"number": F.lit(1)})
        numbered = numbered.withColumn("__n", numbered.agg(F.count(F.lit(1))).scalar())
    at, n = F.col("number"), F.col("__n")
    return numbered.withColumns({"next": F.pmod(at + 1, n), "previous": F.pmod(at - 1, n)}).drop("__n")


def hit_summary(hits: DataFrame) -> DataFrame:
    """Per document: segments and occurrences."""
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("count").alias("occurrences"))


def charset(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct characters per document and how often each occurs."""
    return docs.select("doc_id", F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count(F.lit(1)).alias("n"))
