"""Shared helpers: durable intermediate tables and stable row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a single process, where that is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash128(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the same values; never null."""
    return [F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]) for seed in (17, 8191)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(v) with v bound to the value, so that it is computed once however often it stands in lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


_held: dict = {}


def per_worker(key, make: Callable):
    """What the operator at work keeps in its Python worker. Workers serve one operator after the other, so what an earlier one kept goes."""
    found = _held.get(key)
    if found is None:
        _held.clear()
        found = _held[key] = make()
    return found


class Memo(dict):
    """A dict that computes what it lacks. Past its limit it starts afresh, taking back from the last generation what is asked for again."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.last = make, limit, {}

    def __missing__(self, key):
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.last = dict(self)
            self.clear()
        self[key] = value
        return value


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
