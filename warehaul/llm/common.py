"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Batches = Iterator[pa.RecordBatch]


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column in ``taken`` has it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column name that may hold dots or back ticks, for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; none of a null.

    ``bytes.split`` splits at exactly these six characters.
    """
    return text.encode().split() if text else []


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """A partition function that maps each Arrow batch by ``fn``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield fn(batch)

    return run


def released(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A partition function that at its end gives what it has freed back to the system.

    Spark keeps Python workers for later tasks, and an idle one would hold the most that any of its tasks took.
    """

    def run(batches: Batches) -> Batches:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def texts(batch: pa.RecordBatch, column: int) -> Iterator[str | None]:
    """The texts of a column one at a time, so that only one is held as a Python string."""
    return (value.as_py() for value in batch.column(column))


def empty(df: DataFrame) -> bool:
    """True when ``df`` has no rows."""
    return df.isEmpty()
