"""Running sums, free numbers, trees, and rows pushed from page to page."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import pageplan, ranks, reflow
from quire.sources import catalog
from quire.sources.staging import staged


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "a", "a", "b"]), i, r.randrange(9)) for i in range(400)]
    found = ranks.running(spark.createDataFrame(rows, "g string, i long, v int"), ["g"], ["i"], {"before": F.col("v"), "place": F.lit(1)}, rows_each=30).collect()
    for x in found:
        earlier = [v for g, i, v in rows if g == x.g and i < x.i]
        assert (x.before, x.place) == (sum(earlier), len(earlier))
    assert len(found) == 400


def names_of(spark, names, taken=()):
    rows = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    used = spark.createDataFrame([(t,) for t in taken], "name string") if taken else None
    return [r.out_name for r in catalog.unique_names(rows, "name", "i", used).orderBy("i").collect()]


@pytest.mark.parametrize(("names", "taken", "want"), [
    (["a", "a", "a-2"], (), ["a", "a-3", "a-2"]), (["a", "a", "a", "a"], ["a-3"], ["a", "a-2", "a-4", "a-5"]), (["a", "a"], ["a", "a-2"], ["a-3", "a-4"]),
    (["a-2", "a-2", "a", "a"], (), ["a-2", "a-2-2", "a", "a-3"]), (["a-02", "a", "a"], (), ["a-02", "a", "a-2"]), ([None, ":", "x"], (), ["document", "document-2", "x"]), ([], (), [])])
def test_free_numbers(spark, names, taken, want):
    assert names_of(spark, names, taken) == want


def test_no_two_names_are_equal(spark):
    r = random.Random(4)
    names = [r.choice("ab") + r.choice(["", "", "-2", "-3", "-7", "-2-2"]) for _ in range(300)]
    taken = ["a", "b-4", "b-5", "a-2-3"]
    got = names_of(spark, names, taken)
    assert len({*got, *taken}) == 304


def test_a_deep_tree_takes_few_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(pageplan, "staged", lambda df, name: steps.append(name) or staged(df, name))
    chain = [(i, i - 1 if i else None, i, i == 32, "deep" if i == 3 else None) for i in range(33)]
    circle = [(100, 101, 0, False, None), (101, 100, 0, False, None), (102, 101, 0, True, None), (200, 999, 0, True, None)]
    found = pageplan.flatten_tree(spark.createDataFrame(chain + circle, "node long, parent long, ord int, is_leaf boolean, box string"), ["box"]).collect()
    assert [(r.node, r.depth, list(r.path), r.box) for r in found] == [(32, 32, list(range(33)), "deep")]
    assert len(steps) <= 8  # the table, five doublings for a depth of 32, and those in which the circle stays


def plain_flow(rows, top, bottom):
    out, page, y = {}, None, top
    for doc, own, n, height in sorted(rows):
        if page is None or doc != last or own > page:
            page, y = own, top
        elif y - height < bottom and y < top:
            page, y = page + 1, top
        out[doc, own, n], y, last = (page, y), y - height, doc
    return out


def test_flow_in_chunks(spark):
    r = random.Random(6)
    rows = [(d, p, n, float(r.choice([10, 20, 45]))) for d in (1, 2) for p in range(1, 15) for n in range(r.randint(1, 9))]
    found = reflow.flow_pages(spark.createDataFrame(rows, "doc_id long, page int, n int, height double"), 120.0, 24.0, 50, 50, rows_each=12).collect()
    assert {(x.doc_id, x.page, x.n): (x.new_page, x.new_y) for x in found} == plain_flow(rows, 120.0, 24.0) and all(x.fits for x in found)


def test_flow_limits(spark):
    rows = [(1, 1, n, 50.0) for n in range(9)] + [(2, 1, 0, 50.0)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, n int, height double")
    kept = reflow.flow_pages(frame, 120.0, 24.0, most_new=3).where("doc_id = 1").collect()
    assert all(not x.fits and x.new_page == 1 and x.new_y is None for x in kept)
    assert all(x.fits for x in reflow.flow_pages(frame, 120.0, 24.0, most_new=8).collect())
    assert not any(x.fits for x in reflow.flow_pages(frame, 120.0, 24.0, 20, most_pushed=2).where("doc_id = 1").collect())
