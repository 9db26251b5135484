import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "2g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, h1 long, id long, n int, seg int, label string, u long, slice long"


def passage(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    base = passage(1, 300)
    near = base.split(" ")
    near[100] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " "), (7, "word"), (8, "x" * 300_000), (9, passage(2, 30_000)),
        (10, passage(3, 200) + " " + passage(9, 90) + " " + passage(4, 200)), (11, passage(5, 150) + " " + passage(9, 90) + " " + passage(6, 250)),
        (None, base), (None, None), (12, "Grüße\n\n日本語 ‍😀\r\nΣΑΣ İı <|endoftext|> end  \t x \n"), (13, "same"), (13, "same"), (14, "same"), (14, "other"), (-5, "12345 !!! ###"),
    ]
    rows = [(i, t, [None, "en", "xx"][k % 3], [None, "s1", "s2", ""][k % 4], None if k % 2 else 7, "key", k, 1, 2, 3, 4, "label", 5, 6) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
