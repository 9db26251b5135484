"""Annotations of a document with very many, and caps that are asked for."""

from quire.operators import annotations as A
from quire.sources import catalog as C


def many(spark, n):
    return spark.range(n).selectExpr("1L doc_id", "id seq", "'note' type", "1 page", "array(array(0d, 0d, 9d, 9d)) rects", "'#000' color", "'' note")


def test_nothing_is_cut_unasked(spark):
    assert A.annotation_stats(A.sanitize_annotations(many(spark, 5010))).first().written == 5010
    files = spark.range(310).selectExpr("concat('a', id) name", "concat('/a', id) path")
    assert C.catalog_search(files, "a").count() == 310


def test_rows_over_the_cap_are_counted(spark):
    found = A.annotation_stats(A.sanitize_annotations(many(spark, 10), cap=4)).first()
    assert (found.written, found.skipped) == (4, 6)
