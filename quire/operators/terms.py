"""Many literal terms at once: one automaton for all of them, one pass over each text.

The automaton (Aho-Corasick) is built in each task from the terms, which are bounded in number
and length and travel with the plan; texts come as Arrow batches and nothing is joined or
shuffled. Of each term, hits are taken from left to right without overlap, as if it were
searched alone; hits of different terms may overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import flat

Span = tuple[int, int, int]


def automaton(words: Sequence[tuple[int, str]]) -> ahocorasick.Automaton | None:
    """Finds words; its values are lists of (place in the list of terms, length), as terms may be alike but for case."""
    if not words:
        return None
    made, places = ahocorasick.Automaton(), {}
    for place, word in words:
        places.setdefault(word, []).append((place, len(word)))
    for word, found in places.items():
        made.add_word(word, found)
    made.make_automaton()
    return made


class Terms:
    """All hits of a list of terms in a text. Case is ignored only where lower-casing changes neither length."""

    def __init__(self, words: Sequence[str], ignore_case: bool = False):
        every = [(i, w) for i, w in enumerate(words) if w]
        self.ignore_case = ignore_case
        self.plain = automaton(every)
        if ignore_case:
            self.low = automaton([(i, w.lower()) for i, w in every if len(w.lower()) == len(w)])
            self.odd = automaton([(i, w) for i, w in every if len(w.lower()) != len(w)])

    def hits(self, text: str) -> list[Span]:
        """(place of the term, start, end) in the order of the ends."""
        if not self.ignore_case or len(low := text.lower()) != len(text):
            return self._walk(self.plain, text)
        return self._walk(self.low, low) + self._walk(self.odd, text)

    def _walk(self, made: ahocorasick.Automaton | None, text: str) -> list[Span]:
        free: dict[int, int] = {}
        out = []
        for last, found in made.iter(text) if made else ():
            for place, size in found:
                start = last + 1 - size
                if start >= free.get(place, 0):
                    free[place] = last + 1
                    out.append((place, start, last + 1))
        return out


def united(spans: Sequence[Span]) -> list[tuple[int, int]]:
    """The union of spans that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def rewritten(lines: Sequence[str], spans: Sequence[tuple[int, int]], replacement: str) -> list[str]:
    """The lines with each of the ascending, separate spans of their joined text replaced, in one pass. A line end inside a span moves behind its replacement."""
    text, ends, at = "".join(lines), [], 0
    for line in lines[:-1]:
        at += len(line)
        ends.append(at)
    out, row, here, k = [], [], 0, 0  # here: what of the text is written
    for a, b in spans:
        while k < len(ends) and ends[k] <= a:
            row.append(text[here : ends[k]])
            out.append("".join(row))
            row, here, k = [], ends[k], k + 1
        row += [text[here:a], replacement]
        here = b
        while k < len(ends) and ends[k] < b:
            out.append("".join(row))
            row, k = [], k + 1
    for end in ends[k:]:
        row.append(text[here:end])
        out.append("".join(row))
        row, here = [], end
    row.append(text[here:])
    return [*out, "".join(row)]


def _kinds(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def many_hits(segs: DataFrame, words: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """One row per segment and term that it holds: the segment's keys, ord, term and count."""
    keys = [c for c in segs.columns if c != "lines"]
    slim = segs.select(*keys, flat("lines").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(words, ignore_case)
        for batch in batches:
            rows, places, counts = [], [], []
            for row, text in enumerate(batch[len(keys)].to_pylist()):
                found: dict[int, int] = {}
                for place, _, _ in terms.hits(text or ""):
                    found[place] = found.get(place, 0) + 1
                rows += [row] * len(found)
                places += found
                counts += found.values()
            kept = [batch[i].take(pa.array(rows, pa.int32())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int32()), pa.array([words[p] for p in places], pa.string()), pa.array(counts, pa.int64())], [*keys, "ord", "term", "count"])

    return slim.mapInArrow(run, _kinds(segs.select(*keys)) + "ord int, term string, count long")


def edited(segs: DataFrame, words: Sequence[str], replacement: str, ignore_case: bool = False) -> DataFrame:
    """segs with hits of any of the words: new_lines with all of them replaced (hits that overlap or touch as one if there are several words), hits, and removed (places)."""
    several = len(words) > 1
    names = [*segs.columns, "hits", "removed", "new_lines"]
    at = segs.columns.index("lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(words, ignore_case)
        for batch in batches:
            rows, hits, removed, lines = [], [], [], []
            for row, old in enumerate(batch[at].to_pylist()):
                found = terms.hits("".join(old)) if old else []
                if found:
                    spans = united(found) if several else [(a, b) for _, a, b in found]
                    rows.append(row)
                    hits.append(len(found))
                    removed.append(len(spans))
                    lines.append(rewritten(old, spans, replacement))
            kept = [c.take(pa.array(rows, pa.int32())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, pa.int64()), pa.array(removed, pa.int64()), pa.array(lines, pa.list_(pa.string()))], names)

    return segs.mapInArrow(run, _kinds(segs) + "hits long, removed long, new_lines array<string>")
