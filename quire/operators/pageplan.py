"""Page plans: selecting, deleting, reordering, rotating, inserting, splitting and merging pages.

Pages of a document are an array of structs (number, width, height, rotate), which is how a
plan sees them; documents are dealt by nothing and plans run as one map. Operators between
documents (split, merge) work on page rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.staging import staged

from quire.functions.text import let

DEFAULT_BOX = (0.0, 0.0, 595.0, 842.0)
#: Paper sizes in points (fixed values).
PAPER = {"a4": (595.28, 841.89), "a3": (841.89, 1190.55), "a5": (419.53, 595.28), "letter": (612.0, 792.0), "legal": (612.0, 1008.0)}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def page_info(pages: DataFrame) -> DataFrame:
    """x, y, width, height and rotate of pages whose box (x0, y0, x1, y1) or rotate may be missing."""
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    x0, y0, x1, y1 = (F.when(whole, F.col(c)).otherwise(F.lit(d)) for c, d in zip(("x0", "y0", "x1", "y1"), DEFAULT_BOX))
    turned = F.coalesce(F.pmod(F.expr("try_cast(rotate AS int)"), F.lit(360)), F.lit(0))
    return pages.select(*[c for c in pages.columns if c not in ("x0", "y0", "x1", "y1", "rotate")],
                        x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"), turned.alias("rotate"))


def parse_pages(spec: Column | str, total: Column | str) -> Column:
    """The page numbers of a list like 1-3,5,8-, in order and with repeats; null where it cannot be read or names no page."""
    spec, total = _col(spec), _col(total).cast("int")
    tokens = F.filter(F.transform(F.split(F.replace(spec, F.lit("，"), F.lit(",")), ","), lambda t: F.trim(t)), lambda t: t != "")
    readable = F.forall(tokens, lambda t: t.rlike(r"^\s*([+]?\d+|[+]?\d*\s*-\s*[+]?\d*)\s*$"))

    def numbers(t: Column) -> Column:
        span = t.contains("-")
        a = F.when(span, F.coalesce(_int(F.trim(F.substring_index(t, "-", 1))), F.lit(1))).otherwise(_int(t))
        b = F.when(span, F.coalesce(_int(F.trim(F.regexp_replace(t, r"^[^-]*-", ""))), total)).otherwise(_int(t))
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), total)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    found = F.flatten(F.transform(tokens, numbers))
    blank = spec.isNull() | (F.trim(spec) == "")
    every = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.when(blank, every).when(readable & (F.size(found) > 0), found)


def _int(t: Column) -> Column:
    return F.when(t.rlike(r"^[+]?\d{1,9}$"), t.cast("int"))


def sanitize_plan(plan: DataFrame) -> DataFrame:
    """order, delete, rotate and insert cleaned, with `dropped` counting what went.

    Negative places go, rotation is a multiple of 90 taken mod 360, inserted sizes are kept
    within 10 to 20000 and an empty order is none.
    """
    order = F.filter("order", lambda i: i >= 0)
    deleted = F.filter("delete", lambda i: i >= 0)
    rotate = F.transform_values(F.map_filter("rotate", lambda k, v: (k >= 0) & (v % 90 == 0)), lambda k, v: F.pmod(v, F.lit(360)))
    side = lambda v, d: F.least(F.greatest(F.coalesce(v, F.lit(d)), F.lit(10.0)), F.lit(20000.0))
    insert = F.transform(F.filter("insert", lambda x: x["at"].isNotNull()), lambda x: F.struct(F.greatest(x["at"], F.lit(0)).alias("at"), side(x["width"], 595.0).alias("width"), side(x["height"], 842.0).alias("height")))
    size = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0))
    lost = size(F.col("order")) - size(order) + size(F.col("delete")) - size(deleted) + size(F.col("rotate")) - size(rotate) + size(F.col("insert")) - size(insert)
    return plan.withColumns({"order": F.when(F.size(order) > 0, order), "delete": deleted, "rotate": rotate, "insert": insert, "dropped": lost})


def delete_pages(pages: Column, gone: Column) -> Column:
    """Without the pages at the given places (from 0)."""
    return F.filter(pages, lambda p, i: ~F.array_contains(gone, i))


def remapped(order: Column, gone: Column) -> Column:
    """An order of old places as places after deletion; an entry that names a deleted page stays as it is."""
    return F.transform(order, lambda o: F.when(F.array_contains(gone, o), o).otherwise(o - F.size(F.filter(F.array_distinct(gone), lambda g: g < o))))


def reorder_pages(pages: Column, order: Column) -> Column:
    """The pages at the places in order: others go, repeats stay, places that do not exist are passed over."""
    return let(pages, lambda ps: F.transform(F.filter(order, lambda o: (o >= 0) & (o < F.size(ps))), lambda o: F.get(ps, o)))


def rotate_pages(pages: Column, turns: Column) -> Column:
    """Turns are added to the page at each place, mod 360."""
    return F.transform(pages, lambda p, i: p.withField("rotate", F.pmod(p["rotate"] + F.coalesce(F.try_element_at(turns, i), F.lit(0)), F.lit(360))))


def insert_blank(pages: Column, inserts: Column) -> Column:
    """Blank pages put in one after another; the first page's size wins over the given one."""

    def put(ps: Column, x: Column) -> Column:
        at = F.least(F.greatest(x["at"], F.lit(0)), F.size(ps))
        first = F.get(ps, F.lit(0))
        blank = F.struct(F.lit(None).cast("int").alias("number"), F.coalesce(first["width"], x["width"]).alias("width"), F.coalesce(first["height"], x["height"]).alias("height"), F.lit(0).alias("rotate"))
        return F.concat(F.slice(ps, F.lit(1), at), F.array(blank), F.slice(ps, at + 1, F.size(ps)))

    # A blank page has no number, so numbers must be able to be null from the start.
    unnumbered = F.transform(pages, lambda p: p.withField("number", F.nullif(p["number"], F.lit(-1))))
    return F.aggregate(inserts, unnumbered, put)


def apply_page_plan(pages: Column, gone: Column, order: Column, turns: Column, inserts: Column) -> Column:
    """Delete, reorder, rotate, insert, in that order; null parts of a plan change nothing."""
    none = F.array().cast("array<int>")
    gone = F.coalesce(gone, none)
    kept = delete_pages(pages, gone)
    ordered = F.when(order.isNull(), kept).otherwise(reorder_pages(kept, remapped(order, gone)))
    turned = F.when(turns.isNull(), ordered).otherwise(rotate_pages(ordered, turns))
    return F.when(inserts.isNull(), turned).otherwise(insert_blank(turned, inserts))


def effective_order(total: Column, gone: Column, order: Column) -> Column:
    """The given order, or all places from 0, without deleted ones."""
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.coalesce(order, every), lambda o: ~F.array_contains(F.coalesce(gone, F.array().cast("array<int>")), o))


def export_pages(pages: Column, numbers: Column) -> Column:
    """The pages of the given numbers (from 1), in the given order."""
    return reorder_pages(pages, F.transform(numbers, lambda n: n - 1))


def split_parts(pages: DataFrame, per: int) -> DataFrame:
    """part, first and last page of each page row (doc_id, page from 1); documents of no more than `per` pages give none."""
    if per < 1:
        raise ValueError("a part has at least 1 page")
    doc = Window.partitionBy("doc_id")
    part = Window.partitionBy("doc_id", "part")
    parted = pages.withColumn("total", F.count(F.lit(1)).over(doc)).where(F.col("total") > per).withColumn("part", (F.floor((F.col("page") - 1) / per) + 1).cast("int"))
    return parted.withColumns({"first": F.min("page").over(part), "last": F.max("page").over(part)}).drop("total")


def merge_documents(pages: DataFrame, members: DataFrame) -> DataFrame:
    """Pages of all members (target, ord, doc_id) in order, renumbered from 1 per target by offsets.

    Only counts per member are put in order, so no target's pages meet in one task.
    """
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("target").orderBy("ord")) - F.col("n")
    placed = members.join(counts, "doc_id").withColumn("offset", before)
    return pages.join(placed, "doc_id").select("target", "ord", "doc_id", F.col("page").alias("old_page"), (F.col("page") + F.col("offset")).cast("long").alias("page"))


def object_offsets(members: DataFrame) -> DataFrame:
    """The shift of object ids of each member (target, ord, doc_id, max_id): what stands before it in the target."""
    return members.withColumn("offset", F.sum("max_id").over(Window.partitionBy("target").orderBy("ord")) - F.col("max_id"))


def blank_documents(requests: DataFrame) -> DataFrame:
    """One row per page of each request (doc_id, size, landscape, n), n from 1 to 200 of a named size; others give none."""
    width, height = (F.coalesce(*[F.when(F.lower("size") == k, F.lit(v[i])) for k, v in PAPER.items()]) for i in (0, 1))
    sized = requests.withColumns({"w": width, "h": height}).where(F.col("w").isNotNull() & F.col("n").between(1, 200))
    return sized.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page"),
                        F.when(F.col("landscape"), F.col("h")).otherwise(F.col("w")).alias("width"), F.when(F.col("landscape"), F.col("w")).otherwise(F.col("h")).alias("height"))


def attach_objects(pages: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects on pages that exist after the plan (doc_id, page); others are passed over."""
    return objects.join(pages, ["doc_id", "page"])


def flatten_tree(nodes: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Leaves of (node, parent, ord, is_leaf, attributes) in depth-first order, with the nearest ancestor's attributes.

    Pointers are doubled: every node takes over what the node at its pointer knows, and its
    pointer, until all point past a root. That takes as many steps as the depth has binary
    digits, each written and read back. A step after which as many nodes as before are left
    leaves those on or below a circle, which are never reached from a root; nodes below a
    missing one drop out. path orders the leaves.
    """
    up = staged(nodes.select("node", F.col("parent").alias("up"), F.array("ord").alias("path"), F.col("parent").isNotNull().cast("int").alias("depth"), "is_leaf", *attributes), "tree")
    left = None
    while left != (left := up.where("up IS NOT NULL").count()) and left:
        above = up.select(F.col("node").alias("__node"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("depth").alias("__depth"), *[F.col(a).alias(f"__{a}") for a in attributes])
        joined = up.where("up IS NOT NULL").join(above, F.col("up") == F.col("__node"))
        moved = joined.select("node", F.col("__up").alias("up"), F.concat("__path", "path").alias("path"), (F.col("depth") + F.col("__depth")).alias("depth"), "is_leaf", *[F.coalesce(a, f"__{a}").alias(a) for a in attributes])
        up = staged(up.where("up IS NULL").unionByName(moved), "tree")
    return up.where("up IS NULL AND is_leaf").select("node", "path", "depth", *attributes)
