"""What edit logs leave: versions and histories.

A log leaves little: a current state, at most so many older ones, and what was undone. Each
event acts on what those before it left, so logs are folded in chunks (operators/chunks.py).
As older states fall off the end, what a chunk leaves rarely hangs on what it started from.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.chunks import CHUNK_ROWS, Fold, agreed

LEFT = "struct<current:string,done:array<string>,undone:array<string>>"


class Left(NamedTuple):
    """What a log leaves so far: the current state, those before it (oldest first), and what was undone (latest undo last)."""

    current: str | None = None
    done: tuple[str, ...] = ()
    undone: tuple[str, ...] = ()


Step = Callable[[Left, str, "str | None"], tuple[Left, int]]


def versions_step(keep: int) -> Step:
    """A save puts the current state away, at most `keep` of them; an undo takes the last one back, or is an error."""

    def step(left: Left, op: str, state: str | None) -> tuple[Left, int]:
        if op == "save":
            put_away = left.done if left.current is None else (*left.done, left.current)[-keep:]
            return Left(state, put_away), 0
        if op == "undo":
            return (Left(left.done[-1], left.done[:-1]), 0) if left.done else (left, 1)
        return left, 0

    return step


def history_step(keep: int) -> Step:
    """As versions, but an unchanged save is passed over, what is undone can be redone until the next save, and an undo or redo of nothing is passed over."""

    def step(left: Left, op: str, state: str | None) -> tuple[Left, int]:
        if op == "save" and state != left.current:
            put_away = left.done if left.current is None else (*left.done, left.current)[-keep:]
            return Left(state, put_away), 0
        if op == "undo" and left.done:
            return Left(left.done[-1], left.done[:-1], (*left.undone, left.current)), 0
        if op == "redo" and left.undone:
            return Left(left.undone[-1], (*left.done, left.current), left.undone[:-1]), 0
        return left, 0

    return step


def fold_log(log: DataFrame, step: Step, rows_each: int = CHUNK_ROWS) -> DataFrame:
    """stage, left and errors of each stage of a log (stage, seq, op, state); seq is unique within a stage."""
    lists = pa.list_(pa.string())
    arrow = pa.struct([("current", pa.string()), ("done", lists), ("undone", lists)])
    fold = Fold(LEFT, arrow, Left(), step, lambda d: Left(d["current"], tuple(d["done"]), tuple(d["undone"])), Left._asdict)
    found = agreed(log, "stage", ["seq"], ["op", "state"], fold, rows_each).chunks
    return found.groupBy("stage").agg(F.max_by("left", "part").alias("left"), F.sum("total").alias("errors"))
