"""What a Python worker keeps from task to task.

Workers are used again, by tasks of other operators too, and what one keeps they would all have to
carry. So a process holds one operator's things at a time, and memory that was given back inside
the process is given back to the machine at the end of a task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa

_held: tuple[Any, Any, Any] | None = None


def held(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What make() gave for this owner and key, as long as no other has asked; else made anew, after the former is gone."""
    global _held
    if _held is None or _held[:2] != (owner, key):
        drop()
        _held = owner, key, make()
    return _held[2]


def drop() -> None:
    global _held
    _held = None
    trim()


def trim() -> None:
    """Give free memory back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with trim() once its last batch has left."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole
