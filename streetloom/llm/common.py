"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns_of(df: DataFrame, *names: str) -> list[str]:
    """``names`` if each is a column of ``df``; a clear error otherwise."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the frame has {df.columns}")
    return list(names)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_text(df: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """``text_col, label`` of each id once: its least label, and the text with the least XXH64 (a null text counts as one)."""
    one = df.groupBy(id_col).agg(F.min_by(text_col, F.xxhash64(text_col)).alias(text_col), F.min(label).alias(label))
    return one.select(text_col, label)


_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What an operator keeps in a worker process, from one task to the next.

    Spark reuses worker processes, so what other operators kept is let go
    first: a process never holds more than one operator's working set.
    """
    if owner not in _HELD:
        _HELD.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
        _HELD[owner] = {}
    return _HELD[owner]


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that few texts are unpacked at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
