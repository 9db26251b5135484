"""Literal cases of page lists, page plans, trees and files."""

import pytest
from pyspark.sql import functions as F

from quire.operators import glyphs as G
from quire.operators import pageplan as P
from quire.sources import catalog as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("spec", "want"), [
    ("1-3,5,8-", [1, 2, 3, 5, 8, 9, 10]), ("3-1", [1, 2, 3]), ("-4", [1, 2, 3, 4]), ("2,2", [2, 2]), ("1，3", [1, 3]), ("  ", list(range(1, 11))), ("abc", None), ("0,11", None), ("99-100", None), ("1-x", None), ("7, ,9", [7, 9])])
def test_parse_pages(spark, spec, want):
    assert one(spark, P.parse_pages(F.lit(spec), F.lit(10))) == want


def pages(n):
    return F.array(*[F.struct(F.lit(i).alias("number"), F.lit(100.0 + i).alias("width"), F.lit(200.0).alias("height"), F.lit(0).alias("rotate")) for i in range(n)])


def ints(*values):
    return F.array(*map(F.lit, values)).cast("array<int>")


def test_plan(spark):
    none = F.lit(None)
    plan = lambda turns=none.cast("map<int,int>"), inserts=none.cast("array<struct<at:int,width:double,height:double>>"): P.apply_page_plan(pages(5), ints(1), ints(4, 0, 1, 2), turns, inserts)
    assert [p["number"] for p in one(spark, plan())] == [4, 0, 2, 2]
    turned = one(spark, plan(F.create_map(F.lit(0), F.lit(90))))
    assert [(p["number"], p["rotate"]) for p in turned] == [(4, 90), (0, 0), (2, 0), (2, 0)]
    blank = F.array(F.struct(F.lit(99).alias("at"), F.lit(5.0).alias("width"), F.lit(5.0).alias("height")))
    assert one(spark, plan(inserts=blank))[-1]["width"] == 104.0


def test_split(spark):
    seven = spark.createDataFrame([(1, i) for i in range(1, 8)], "doc_id long, page int")
    parts = {(r.part, r["first"], r["last"]) for r in P.split_parts(seven, 3).collect()}
    assert parts == {(1, 1, 3), (2, 4, 6), (3, 7, 7)}
    assert P.split_parts(seven, 7).count() == 0
    with pytest.raises(ValueError):
        P.split_parts(seven, 0)


def test_tree_with_circle(spark):
    nodes = spark.createDataFrame([("r", None, 0, False, "A"), ("b", "r", 2, True, None), ("a", "r", 1, False, "B"), ("c", "a", 1, True, None), ("x", "y", 1, False, None), ("y", "x", 1, False, None)], "node string, parent string, ord long, is_leaf boolean, box string")
    found = P.flatten_tree(nodes, ["box"]).orderBy("path").collect()
    assert [(r.node, r.box, r.depth) for r in found] == [("c", "B", 2), ("b", "A", 1)]


def test_names(spark):
    rows = spark.createDataFrame([(1, "a/b:c"), (2, "abc"), (3, "???"), (4, "abc")], "k long, name string")
    found = {r.k: r.out_name for r in C.unique_names(rows, "name", "k").collect()}
    assert found == {1: "abc", 2: "abc-2", 3: "document", 4: "abc-3"}


def test_sizes_and_keys(spark):
    assert one(spark, C.human_size(F.lit(512))) == "512 B" and one(spark, C.human_size(F.lit(2048))) == "2.0 KB"
    assert one(spark, C.doc_key(F.lit("report.pdf"), F.lit(1024))) == "4e620f6417387387"


def test_files(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", ".git/d.pdf", "sub/e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-1.7 " + name[:1].encode())
    found = C.scan_catalog(spark, [str(tmp_path)]).collect()
    assert sorted(r.name for r in found) == ["a", "e"] or sorted(r.name for r in found) == ["a", "b", "e"]
    df = spark.createDataFrame([(1,)], "x int")
    C.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        C.write_new(df, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        C.write_new(df.limit(0), str(tmp_path / "none"))
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{"doc_id": "d",\n "items": [{"page": 2, "type": "note"}]}')
    (tmp_path / "j" / "2.json").write_text('{"doc_id": "e"}')
    read = {r.doc_id: (len(r["items"]), r.updated) for r in C.load_json(spark, str(tmp_path / "j")).collect()}
    assert read == {"d": (1, 0.0), "e": (0, 0.0)}


def test_json_and_outcome(spark):
    rows = spark.createDataFrame([(1, '{"doc_id": "a", "updated": 2}'), (2, "{oops"), (3, None), (4, "{}")], "k int, value string")
    read = {r.k: (r.doc_id, len(r["items"]), r.updated, r["_corrupt_record"]) for r in C.parse_json(rows).collect()}
    assert read == {1: ("a", 0, 2.0, None), 2: (None, 0, 0.0, "{oops"), 3: (None, 0, 0.0, None), 4: (None, 0, 0.0, None)}
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None), (None, "a")], "x string, y string")
    assert [r.o for r in pairs.select(C.outcome("x", "y").alias("o")).collect()] == ["unchanged", "changed", "unchanged", "changed"]


def test_clean_metadata(spark):
    rows = spark.createDataFrame([(1, {"Author": "x"}, "<x/>"), (2, {}, None), (3, None, "<x/>"), (4, None, None)], "k int, info map<string,string>, xmp string")
    done = {r.k: (r["info"], r.xmp, r.removed) for r in G.clean_metadata(rows, "p").collect()}
    assert done == {1: ({"Producer": "p"}, None, ["Info", "XMP Metadata"]), 2: ({"Producer": "p"}, None, ["Info"]), 3: (None, None, ["XMP Metadata"]), 4: (None, None, [])}
