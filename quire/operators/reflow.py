"""Layout and reflow: wrapping, justifying, paging, moving rows and rectangles.

Greedy wrapping looks at one line after the other, so it is an Arrow helper over changed
texts: widths are summed once over a whole batch and each line end is found by a binary
search in the sums. What pushes rows from page to page is folded in chunks. All else is
arithmetic on rows, with the edits of a page applied together: each row moves by the sum of
what the edits above it add.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.chunks import CHUNK_ROWS, Fold, agreed, outputs
from quire.operators.glyphs import HELVETICA, OTHER_WIDTH, WIDE_WIDTH
from quire.sources.staging import staged

#: Characters that must not start a line, and that must not end one (fixed values).
NO_LINE_START = "，。、；：？！…—～·．,.;:?!）】》」』〉”’)]}％‰℃°"
NO_LINE_END = "（【《「『〈“‘([{￥$£#@"
#: Ranges of wide characters (fixed values).
WIDE_RANGES = ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1FAFF))
LINE_HEIGHT = 1.25
PAGE = ["doc_id", "page"]
#: Where a row lands: page, height and how far it was pushed on.
PLACE = ("page", "y", "pushed")


class Ruled:
    """Texts of a batch end to end: their code points, the sums of the widths before each, and the last blank up to each."""

    def __init__(self, texts: Sequence[str], widths: Mapping[str, int] | None = None):
        self.text = "".join(texts)
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.wide = np.zeros(len(codes), bool)
        for low, high in WIDE_RANGES:
            self.wide |= (codes >= low) & (codes <= high)
        each = np.where(self.wide, WIDE_WIDTH, OTHER_WIDTH)
        plain = (codes >= 32) & (codes <= 126)
        each[plain] = np.array(HELVETICA)[codes[plain] - 32]
        for char, own in (widths or {}).items():
            each[codes == ord(char)] = own
        self.sums = np.concatenate([[0], np.cumsum(each)]).tolist()
        self.blank = np.maximum.accumulate(np.where(codes == 32, np.arange(len(codes)), -1)).tolist()

    def wrap(self, a: int, b: int, most: int) -> list[str]:
        """Greedy lines of the characters from a up to b, of at most `most` thousandths (one character at least); a narrow word that does not fit moves down whole where there is a blank."""
        sums, text, out, start, least = self.sums, self.text, [], a, a + 1
        while (at := max(bisect_right(sums, sums[start] + most) - 1, least)) < b:
            blank = self.blank[at - 1]
            if blank > start and text[at] != " " and not self.wide[at]:
                out.append(text[start:blank])
                start = blank + 1
            else:
                out.append(text[start:at])
                start = at
            least = at + 1
        return [*out, text[start:b]]

    def wrap_kinsoku(self, a: int, b: int, scale: float, first: float, rest: float, slack: float = 0.5) -> list[tuple[str, bool]]:
        """Greedy lines that do not start with closing marks nor end with opening ones, each with whether it was broken.

        The break goes back to the last blank if at least half of the line stays before it. Of
        what would go down, up to six closing marks stay, unless the line ends with a blank; then
        up to six opening marks go down. If nothing is left to go down, two more closing marks
        may follow.
        """
        sums, text, out, start, least, room = self.sums, self.text, [], a, a + 1, first
        while start < b and (at := max(bisect_right(sums, sums[start] + thousandths(room + slack, scale)) - 1, least)) < b:
            blank = self.blank[at - 1]
            end = blank + 1 if blank > start and (sums[blank + 1] - sums[start]) * scale >= room * 0.5 else at
            most = min(end + 6, at + 1)
            while end < most and text[end - 1] != " " and text[end] in NO_LINE_START:
                end += 1
            low = max(end - 6, start + 1)
            while end > low and text[end - 1] in NO_LINE_END:
                end -= 1
            if end == at + 1:
                while end < min(at + 3, b) and text[end] in NO_LINE_START:
                    end += 1
            out.append((text[start:end], True))
            start, least, room = end, max(at + 1, end, end + 1 if end > at else 0), rest
        return [*out, (text[start:b], False)] if start < b or not out else out


def width(char: str) -> int:
    """Thousandths of the size."""
    return Ruled([char]).sums[1]


def wrap_line(line: str, size: float, most: float) -> list[str]:
    """The lines of one line."""
    return Ruled([line]).wrap(0, len(line), thousandths(most, size / 1000.0))


def wrap_kinsoku_line(line: str, size: float, first: float, rest: float) -> list[tuple[str, bool]]:
    """The same with marks kept together."""
    return Ruled([line]).wrap_kinsoku(0, len(line), size / 1000.0, first, rest)


def thousandths(most: float, scale: float) -> int:
    """The largest whole number that is at most `most` times the scale."""
    found = int(most / scale)
    while (found + 1) * scale <= most:
        found += 1
    while found > 0 and found * scale > most:
        found -= 1
    return found


def _parts(texts: pd.Series, carriage: bool) -> tuple[list[list[tuple[int, int]]], list[str]]:
    """Where the given lines of each text lie when all are put end to end, and these lines."""
    places, lines, at = [], [], 0
    for t in texts:
        whole = str(t or "")
        own = (whole.replace("\r\n", "\n").replace("\r", "\n") if carriage else whole).split("\n")
        ends = list(accumulate(map(len, own), initial=at))
        places.append(list(zip(ends, ends[1:])))
        lines += own
        at = ends[-1]
    return places, lines


def wrap_text(text: Column, size: Column, most: Column, widths: Mapping[str, int] | None = None) -> Column:
    """The lines of a text at a size, each at most so wide. widths: thousandths of the size of characters that are not as usual."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, sizes: pd.Series, rooms: pd.Series) -> pd.Series:
        places, lines = _parts(texts, True)
        ruled = Ruled(lines, widths)
        return pd.Series([[part for a, b in own for part in ruled.wrap(a, b, thousandths(room, s / 1000.0))] for own, s, room in zip(places, sizes, rooms)], dtype=object)

    return run(text, size.cast("double"), most.cast("double"))


def wrap_kinsoku(text: Column, size: Column, first: Column, rest: Column, widths: Mapping[str, int] | None = None) -> Column:
    """array<struct<line, cut>>: cut says that the line was broken, not ended."""

    @F.pandas_udf("array<struct<line:string,cut:boolean>>")
    def run(texts: pd.Series, sizes: pd.Series, firsts: pd.Series, rests: pd.Series) -> pd.Series:
        places, lines = _parts(texts, False)
        ruled, made = Ruled(lines, widths), []
        for own, s, f, r in zip(places, sizes, firsts, rests):
            made.append([{"line": p, "cut": cut} for i, (a, b) in enumerate(own) for p, cut in ruled.wrap_kinsoku(a, b, s / 1000.0, f if i == 0 else r, r)])
        return pd.Series(made, dtype=object)

    return run(text, *(c.cast("double") for c in (size, first, rest)))


def justify(widths: Column, blanks_at_end: Column, left: Column, right: Column) -> Column:
    """Widths of a cut line stretched to the right edge, blanks at its end left alone; slack of over 40 % stays."""
    used = F.aggregate(widths, F.lit(0.0), lambda s, w: s + w)
    room, span = right - left - used, right - left
    body = F.size(widths) - blanks_at_end
    stretch = (room > 0.2) & ~((span > 0) & (room > span * 0.4)) & (body > 0)
    return F.when(stretch, F.transform(widths, lambda w, i: F.when(i < body, w + room / body).otherwise(w))).otherwise(widths)


def fit_line(widths: Column, left: Column, right: Column) -> Column:
    """Widths of a line that passes the right edge scaled down to fit, to a tenth at most."""
    used = F.aggregate(widths, F.lit(0.0), lambda s, w: s + w)
    over = (left + used > right + 0.01) & (used > 0)
    return F.when(over, F.transform(widths, lambda w: w * F.greatest(F.lit(0.1), (right - left) / used))).otherwise(widths)


def paginate_lines(lines: DataFrame, size: float, height: float = 842.0, first: float | None = None) -> DataFrame:
    """page (from 0) and baseline y of each line (doc_id, line from 0)."""
    top, bottom, step = height - max(18.0, height * 0.04) - size * 0.8, max(30.0, height * 0.08) + size * 0.2, size * LINE_HEIGHT
    start = max(bottom, min(top, top if first is None else first))
    per_page = max(1, int((top - bottom) // step) + 1)
    on_first = min(per_page, max(1, int((start - bottom) // step) + 1))
    later = F.col("line") - on_first
    page = F.when(later < 0, F.lit(0)).otherwise(F.floor(later / per_page) + 1).cast("int")
    y = F.when(later < 0, start - F.col("line") * step).otherwise(top - F.pmod(later, F.lit(per_page)) * step)
    return lines.withColumns({"page": page, "y": F.round(y, 4)})


def place_text_box(rows: DataFrame) -> DataFrame:
    """max_width and y of text boxes (x, y, size, text, page_w, page_h): up to 18 from the edge, lifted if they end below 12."""
    room = F.col("page_w") - 18.0 - F.col("x")
    sized = rows.withColumn("max_width", F.when((F.col("page_w") > 0) & (room >= F.col("size") * 4), room))
    lines = F.when(F.col("max_width").isNotNull() & (F.col("page_h") > 0), F.size(wrap_text(F.col("text"), F.col("size"), F.coalesce("max_width", F.lit(1e9)))))
    base = F.col("y") - (lines - 1) * F.col("size") * LINE_HEIGHT
    lifted = F.least(F.col("y") + (12.0 - base), F.greatest(F.col("page_h") - 12.0, F.col("y")))
    return sized.withColumn("y", F.when(base < 12.0, lifted).otherwise(F.col("y")))


def apply_paragraph_edits(rows: DataFrame, edits: DataFrame, bottom: float = 24.0) -> DataFrame:
    """Rows (doc_id, page, band, para, row_y, gap, is_footer) moved by all edits (doc_id, page, band, para, new_lines) of their page.

    Rows below an edited paragraph in its band move by what the edits above add; footers and
    other bands stay. `fits` is false on pages where a row would pass the bottom.
    """
    sizes = rows.groupBy(*PAGE, "band", "para").agg(F.count(F.lit(1)).alias("old"), F.max("row_y").alias("top"), F.max("gap").alias("step"))
    grown = sizes.join(edits, [*PAGE, "band", "para"], "left").withColumn("delta", F.coalesce((F.col("new_lines") - F.col("old")) * F.col("step"), F.lit(0.0)))
    above = Window.partitionBy(*PAGE, "band").orderBy(F.col("top").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shifted = grown.withColumn("shift", F.coalesce(F.sum("delta").over(above), F.lit(0.0))).select(*PAGE, "band", "para", "shift")
    moved = rows.join(shifted, [*PAGE, "band", "para"]).withColumn("new_y", F.when(F.col("is_footer"), F.col("row_y")).otherwise(F.col("row_y") - F.col("shift")))
    low = F.min(F.when(~F.col("is_footer"), F.col("new_y"))).over(Window.partitionBy(*PAGE))
    return moved.withColumn("fits", F.coalesce(low >= bottom, F.lit(True)))


def flow_pages(rows: DataFrame, top: float, bottom: float, most_new: int = 20, most_pushed: int = 20, rows_each: int = CHUNK_ROWS) -> DataFrame:
    """Rows (doc_id, page, n, height) set from the top of their page; what does not fit goes to the front of the next.

    Rows of a page follow what is pushed onto it, and a page that nothing is pushed onto starts
    at its top, so pages are folded in chunks that hardly ever hang on each other. Documents
    that would need more than most_new pages, or push rows on for more than most_pushed pages
    in a row, keep their rows and are marked (fits).
    """

    def place(state: tuple, own: int, height: float) -> tuple[tuple, tuple]:
        page, y, origin = state
        if page is None or own > page:
            page, y, origin = own, top, own
        elif y - height < bottom and y < top:
            page, y = page + 1, top
        return (page, y - height, origin), (page, y, page - origin)

    def only_state(state: tuple, own: int, height: float) -> tuple[tuple, int]:
        return place(state, own, height)[0], 0

    def with_place(state: tuple, own: int, height: float) -> tuple[tuple, dict]:
        left, found = place(state, own, height)
        return left, dict(zip(PLACE, found))

    names, kinds = ("page", "y", "origin"), (pa.int32(), pa.float64(), pa.int32())
    fold = Fold("struct<page:int,y:double,origin:int>", pa.struct(list(zip(names, kinds))), (None, 0.0, None), only_state, lambda d: tuple(d[c] for c in names), lambda s: dict(zip(names, s)))
    done = agreed(rows.select("doc_id", "page", "n", "height"), "doc_id", ["page", "n"], ["page", "height"], fold, rows_each)
    placed = outputs(done, "struct<page:int,y:double,pushed:int>", pa.struct(list(zip(PLACE, kinds))), with_place)
    set_ = staged(placed.select("doc_id", F.col("page").alias("own"), "n", "out.page", "out.y", "out.pushed"), "flow")
    over = set_.groupBy("doc_id").agg((F.max("page") - F.max("own")).alias("more"), F.max("pushed").alias("far")).where((F.col("more") > most_new) | (F.col("far") > most_pushed))
    marked = set_.join(over.select("doc_id", F.lit(False).alias("fits")), "doc_id", "left").withColumn("fits", F.coalesce("fits", F.lit(True)))
    return marked.select("doc_id", F.col("own").alias("page"), "n", F.when(F.col("fits"), F.col("page")).otherwise(F.col("own")).alias("new_page"), F.when(F.col("fits"), F.col("y")).alias("new_y"), "fits")


def shift_vectors(rects: DataFrame, line: str, delta: str) -> DataFrame:
    """Rectangles whose centre is below the line moved down by delta; thin bars across it stretched; rotated ones kept and counted as skipped."""
    centre = (F.col("y0") + F.col("y1")) / 2
    bar = (F.col("x1") - F.col("x0") <= 1.5) & (F.col("y1") > F.col(line)) & (F.col("y0") < F.col(line))
    free = ~F.col("rotated")
    moves = free & (centre < F.col(line)) & ~bar
    return rects.withColumns({
        "new_y0": F.when(moves | (free & bar), F.col("y0") - F.col(delta)).otherwise(F.col("y0")),
        "new_y1": F.when(moves, F.col("y1") - F.col(delta)).otherwise(F.col("y1")), "skipped": F.col("rotated") & (centre < F.col(line))})


def take_vectors(rects: DataFrame, cut: str) -> DataFrame:
    """The rectangles whose centre lies below the cut."""
    return rects.where((F.col("y0") + F.col("y1")) / 2 < F.col(cut))


def drop_rules(rects: DataFrame, heights: DataFrame, reach: float = 0.6) -> DataFrame:
    """Rectangles without those near one of the heights (doc_id, page, at) of their page."""
    named = heights.select(*[F.col(c).alias(f"__{c}") for c in PAGE], "at")
    near = F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("at")) <= reach
    return rects.join(named, (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & near, "left_anti")


def delete_table_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, page, n, row_y, height, is_footer) without the given (doc_id, page, n); those below move up by what went."""
    marked = rows.join(gone.select(*PAGE, "n").distinct().withColumn("gone", F.lit(True)), [*PAGE, "n"], "left")
    above = Window.partitionBy(*PAGE).orderBy(F.col("row_y").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lost = F.coalesce(F.sum(F.when(F.col("gone"), F.col("height"))).over(above), F.lit(0.0))
    return marked.withColumn("new_y", F.when(F.col("is_footer"), F.col("row_y")).otherwise(F.col("row_y") + lost)).where("gone IS NULL").drop("gone")


def insert_table_rows(rows: DataFrame, copies: DataFrame, bottom: float = 24.0) -> DataFrame:
    """A copy below each given row (doc_id, page, n); rows below move down. `fits` is false where the page has no room."""
    marked = rows.join(copies.select(*PAGE, "n").distinct().withColumn("twice", F.lit(True)), [*PAGE, "n"], "left")
    above = Window.partitionBy(*PAGE).orderBy(F.col("row_y").desc()).rowsBetween(Window.unboundedPreceding, -1)
    more = F.coalesce(F.sum(F.when(F.col("twice"), F.col("height"))).over(above), F.lit(0.0))
    moved = marked.withColumn("new_y", F.when(F.col("is_footer"), F.col("row_y")).otherwise(F.col("row_y") - more)).withColumn("copied", F.lit(False))
    again = moved.where("twice").withColumns({"new_y": F.col("new_y") - F.col("height"), "copied": F.lit(True)})
    every = moved.unionByName(again).drop("twice")
    low = F.min(F.when(~F.col("is_footer"), F.col("new_y"))).over(Window.partitionBy(*PAGE))
    return every.withColumn("fits", F.coalesce(low >= bottom, F.lit(True)))


def char_runs(chars: DataFrame, aligned: DataFrame, own: DataFrame, fallback: DataFrame) -> DataFrame:
    """font and code of each character (doc_id, text): the aligned map, else the own font, else the fallback, else none."""
    for name, frame in (("a", aligned), ("o", own), ("f", fallback)):
        chars = chars.join(frame.select("doc_id", "text", F.struct("font_alias", "code").alias(name)), ["doc_id", "text"], "left")
    return chars.withColumn("run", F.coalesce("a", "o", "f")).drop("a", "o", "f").select("*", "run.font_alias", "run.code").drop("run")


def align_chars(glyphs: DataFrame, chars: DataFrame) -> DataFrame:
    """code to text by position, for runs (doc_id, run) where glyphs (pos, code) and characters (pos, text) are as many.

    The first mapping of a code stands; conflicts counts later, different ones.
    """
    n = lambda df, c: df.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias(c))
    same = n(glyphs, "n").join(n(chars, "m"), ["doc_id", "run"]).where("n = m").select("doc_id", "run")
    pairs = glyphs.join(same, ["doc_id", "run"]).join(chars, ["doc_id", "run", "pos"])
    first = pairs.groupBy("doc_id", "code").agg(F.min_by("text", F.struct("run", "pos")).alias("text"), F.collect_list("text").alias("all"))
    return first.withColumn("conflicts", F.size(F.filter("all", lambda t: t != F.col("text")))).drop("all")


def align_text(glyphs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which code shows which character, for runs (doc_id, run) whose text is known: (text, font_alias, code and conflicts by run; the runs, with how they fit).

    glyphs: doc_id, run, pos, font_alias, code, x0, x1, size; texts: doc_id, run, text. Glyphs
    and characters are put side by side if they are as many: all glyphs with the characters
    but blanks, or with all; else the same with only those wider than max(0.15 * size, 0.5),
    which leaves out blanks and marks of no width. `fit` says which (1 to 4), null that none
    does; line ends never count. The first code of a character stands, conflicts counts later ones.
    """
    key = ["doc_id", "run"]
    solid = F.col("x1") - F.col("x0") > F.greatest(F.col("size") * 0.15, F.lit(0.5))
    plain = texts.select(*key, F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", "").alias("every")).withColumn("bare", F.regexp_replace("every", r"(?U)\s", ""))
    n = glyphs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(solid).alias("n_solid"))
    tried, fit = plain.join(n, key, "left").na.fill(0, ["n_all", "n_solid"]), F.lit(None).cast("int")
    for k, (g, c) in reversed(list(enumerate([("n_all", "bare"), ("n_all", "every"), ("n_solid", "bare"), ("n_solid", "every")], 1))):
        fit = F.when(F.col(g) == F.char_length(c), k).otherwise(fit)
    runs = tried.withColumn("fit", F.when(F.char_length("bare") > 0, fit)).drop("n_all", "n_solid")
    fitted = runs.where("fit IS NOT NULL")
    chars = fitted.select(*key, F.posexplode(F.split(F.when(F.col("fit") % 2 == 1, F.col("bare")).otherwise(F.col("every")), "")).alias("at", "text")).where("text <> ''")
    place = Window.partitionBy(*key).orderBy("pos")
    chosen = glyphs.withColumn("solid", solid).join(fitted.select(*key, "fit"), key).where("fit <= 2 OR solid")
    placed = chosen.withColumn("at", F.row_number().over(place) - 1).select(*key, "at", "font_alias", "code")
    pairs = placed.join(chars, [*key, "at"])
    first = pairs.groupBy(*key, "text").agg(F.min_by(F.struct("font_alias", "code"), "at").alias("shown"), F.collect_list(F.struct("font_alias", "code")).alias("all"))
    found = first.select(*key, "text", "shown.*", F.size(F.filter("all", lambda x: x != F.col("shown"))).alias("conflicts"))
    return found, runs.select(*key, "fit")


def locate_cell(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cell for each wanted (id, doc_id, text, row, col): equal text, nearest by rows and columns, then first."""
    joined = wanted.join(cells.select("doc_id", "text", F.col("row").alias("c_row"), F.col("col").alias("c_col")), ["doc_id", "text"])
    far = F.abs(F.col("row") - F.col("c_row")) + F.abs(F.col("col") - F.col("c_col"))
    return joined.groupBy("id").agg(F.min(F.struct(far.alias("far"), "c_row", "c_col")).alias("x")).select("id", "x.*")


def list_paragraphs(paragraphs: DataFrame, rows: DataFrame) -> DataFrame:
    """paragraphs (doc_id, page, para, ...) with their rows as an array from the top."""
    lines = rows.groupBy(*PAGE, "para").agg(F.array_sort(F.collect_list(F.struct((-F.col("row_y")).alias("d"), "row_y", "x0", "x1", "text"))).alias("rows"))
    return paragraphs.join(lines, [*PAGE, "para"]).withColumn("rows", F.transform("rows", lambda r: F.struct(r["row_y"].alias("row_y"), r["x0"].alias("x0"), r["x1"].alias("x1"), r["text"].alias("text"))))


def row_bars(rects: DataFrame, bands: DataFrame) -> DataFrame:
    """Distinct places of upright bars (at most 1.5 wide, at least 1.5 high) inside bands (doc_id, page, id, low, high)."""
    bars = rects.where("NOT rotated AND painted AND x1 - x0 <= 1.5 AND y1 - y0 >= 1.5")
    inside = bars.join(bands, PAGE).where((F.col("y0") < F.col("high")) & (F.col("y1") > F.col("low")))
    return inside.select(*PAGE, "id", F.round((F.col("x0") + F.col("x1")) / 2, 2).alias("x")).distinct()
