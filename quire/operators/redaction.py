"""Redaction by terms from end to end, and hits with their boxes.

The glyphs of a page are gathered once, by the page's key; that is the only shuffle. Finding
terms in the page's text, the boxes to draw, what lies under them, and what is left are then
worked out page by page over Arrow batches. A page is the most that is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalised
from quire.operators.search import clean_terms
from quire.operators.terms import Terms

PAGE = ["doc_id", "page"]
#: How far boxes are drawn in, and the least width and height of one.
INSET, LEAST = 0.02, 0.05
BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
BOX_TYPE = pa.list_(pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")]))


def merged(boxes: np.ndarray, gap: float = 2.0) -> np.ndarray:
    """Boxes (x0, y0, x1, y1) joined along rows: those within `gap` of the one before on nearly the same height."""
    if not len(boxes):
        return boxes
    sorted_ = boxes[np.lexsort((boxes[:, 2], boxes[:, 0], -np.round(boxes[:, 1], 1)))]
    fresh = (np.abs(np.diff(sorted_[:, 1])) > 2.0) | (sorted_[1:, 0] - sorted_[:-1, 2] > gap)
    starts = np.concatenate([[0], np.flatnonzero(fresh) + 1])
    return np.column_stack([np.minimum.reduceat(sorted_[:, :2], starts), np.maximum.reduceat(sorted_[:, 2:], starts)])


def drawn(boxes: np.ndarray) -> np.ndarray:
    """The boxes drawn in a little, to two places and each once; what is too small then is left out."""
    shown = np.round(boxes + np.array([INSET, INSET, -INSET, -INSET]), 2)
    large = (shown[:, 2] - shown[:, 0] > LEAST) & (shown[:, 3] - shown[:, 1] > LEAST)
    return np.unique(shown[large], axis=0)


class Page:
    """The glyphs of a page in reading order: boxes, rows, fonts and texts, and where each text begins and ends in the page's."""

    def __init__(self, glyphs: pa.StructArray):
        self.boxes = np.column_stack([glyphs.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]) if len(glyphs) else np.empty((0, 4))
        self.row, self.font, texts = (glyphs.field(c).to_pylist() for c in ("row_y", "font_alias", "text"))
        self._read([t or "" for t in texts])

    def _read(self, texts: list[str]) -> None:
        sizes = np.array([len(t) for t in texts], "i8")
        self.ends = np.cumsum(sizes)
        self.begins, self.texts, self.text = self.ends - sizes, texts, "".join(texts)

    def without(self, gone: np.ndarray) -> Page:
        """The page without the texts of the glyphs that are gone."""
        left = copy(self)
        left._read(["" if g else t for t, g in zip(self.texts, gone)])
        return left

    def under(self, a: int, b: int) -> np.ndarray:
        """The glyphs whose characters overlap those from a up to b; glyphs without text have none."""
        at = np.arange(np.searchsorted(self.ends, a, "right"), np.searchsorted(self.begins, b, "left"))
        return at[self.ends[at] > self.begins[at]]

    def regions(self, hits: Sequence[tuple[int, int, int]], mode: str) -> np.ndarray:
        """Boxes to redact: of the glyphs hit, of all in their rows, or of the whole page's text."""
        found = np.unique(np.concatenate([self.under(a, b) for _, a, b in hits] or [np.empty(0, "i8")])).astype("i8")
        if mode == "line":
            rows = {self.row[i] for i in found}
            found = np.array([i for i, y in enumerate(self.row) if y in rows], "i8")
        elif mode == "para" and len(found):
            found = np.arange(len(self.texts))
        return drawn(merged(self.boxes[found]))

    def covered(self, regions: np.ndarray) -> np.ndarray:
        """Whether each glyph meets a region; edges that only touch do not."""
        out = np.zeros(len(self.texts), bool)
        for x0, y0, x1, y1 in regions:
            out |= (self.boxes[:, 0] < x1) & (self.boxes[:, 2] > x0) & (self.boxes[:, 1] < y1) & (self.boxes[:, 3] > y0)
        return out


def _by_page(glyphs: DataFrame) -> DataFrame:
    order = F.struct("op_index", "char_index", "x0", "y0", "x1", "y1", "row_y", "font_alias", "text")
    return glyphs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(order)).alias("glyphs"))


def _mapped(glyphs: DataFrame, look: Callable[[], Callable[[Page], tuple | None]], names: Sequence[str], kinds: Sequence[str], types: Sequence[pa.DataType]) -> DataFrame:
    """A row of results for each page for which there is one. look makes, in a task, what is applied to its pages."""
    keys = ", ".join(f"{c} {glyphs.schema[c].dataType.simpleString()}" for c in PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = look()
        for batch in batches:
            rows, made = [], []
            for i, page in enumerate(batch[2]):
                found = one(Page(page.values))
                if found is not None:
                    rows.append(i)
                    made.append(found)
            columns = [pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*(batch[k].take(pa.array(rows, pa.int32())) for k in range(2)), *columns], [*PAGE, *names])

    return _by_page(glyphs).mapInArrow(run, ", ".join([keys, *(f"`{n}` {k}" for n, k in zip(names, kinds))]))


def _dicts(boxes: np.ndarray) -> list[dict]:
    return [dict(zip(("x0", "y0", "x1", "y1"), b)) for b in boxes.tolist()]


def redact_terms(glyphs: DataFrame, terms: Sequence[str], ignore_case: bool = True, mode: str = "term", until_clean: bool = False) -> DataFrame:
    """Pages with hits (glyphs: doc_id, page, op_index, char_index, box, row_y, font_alias, text): hits per term place, regions, removed glyphs, what they said by font, the text left, and residue: how many terms that still holds.

    mode: `term` redacts the hits, `line` their rows, `para` all text of the page. What stood
    around a hit may come to spell a term; until_clean redacts that, too, until nothing does.
    """
    if mode not in ("term", "line", "para"):
        raise ValueError(mode)
    words = clean_terms(terms)

    def look() -> Callable[[Page], tuple | None]:
        known = Terms(words, ignore_case)

        def one(page: Page) -> tuple | None:
            hits = known.hits(page.text)
            if not hits:
                return None
            counts: dict[int, int] = {}
            regions, said, gone = np.empty((0, 4)), {}, np.zeros(len(page.texts), bool)
            while hits:
                for place, _, _ in hits:
                    counts[place] = counts.get(place, 0) + 1
                regions = np.unique(np.concatenate([regions, page.regions(hits, mode)]), axis=0)
                now = page.covered(regions) | gone
                for i in np.flatnonzero(now & ~gone):
                    said[page.font[i]] = said.get(page.font[i], "") + page.texts[i]
                done = not until_clean or (now == gone).all()  # boxes too small to draw cover nothing
                page, gone = page.without(now), now
                hits = [] if done else known.hits(page.text)
            left = page.text
            return counts, _dicts(regions), int(gone.sum()), sorted(said.values()), left, len({p for p, _, _ in known.hits(left)})

        return one

    return _mapped(glyphs, look, ["hits", "regions", "removed", "said", "left", "residue"], ["map<int,int>", BOXES, "long", "array<string>", "string", "int"],
                   [pa.map_(pa.int32(), pa.int32()), BOX_TYPE, pa.int64(), pa.list_(pa.string()), pa.string(), pa.int32()])


def killed_texts(redacted: DataFrame) -> DataFrame:
    """doc_id and text: what was removed of each document, normalised and each once, for titles that repeat it."""
    return redacted.select("doc_id", F.explode("said").alias("text")).select("doc_id", normalised("text").alias("text")).where("text <> ''").distinct()


def find_boxes(glyphs: DataFrame, term: str, ignore_case: bool = False) -> DataFrame:
    """Pages with the term: count, a preview of the first hit, and the boxes of all hits, to two places."""

    def look() -> Callable[[Page], tuple | None]:
        known = Terms([term], ignore_case)

        def one(page: Page) -> tuple | None:
            hits = known.hits(page.text)
            if not hits:
                return None
            low, high = max(0, hits[0][1] - 18), min(len(page.text), hits[0][2] + 18)
            shown = "…" * (low > 0) + page.text[low:high] + "…" * (high < len(page.text))
            boxes = [box for _, a, b in hits for box in _dicts(np.round(merged(page.boxes[page.under(a, b)]), 2))]
            return len(hits), shown, boxes

        return one

    return _mapped(glyphs, look, ["count", "preview", "boxes"], ["long", "string", BOXES], [pa.int64(), pa.string(), BOX_TYPE])
