"""Memory of Python workers: Spark keeps them from task to task, and with them whatever they hold.

An executor's memory is its heap, what Arrow holds beside it, and its workers. What one
operator has left in them is missing for all that come after it, be they plain Spark.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Freed memory goes back to the system each time that so many bytes have come in, and at a task's end.
RETURN_EACH = 8 << 20

_kept: dict[str, Callable[[], None]] = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Says that ``owner`` leaves tables in its worker, and how to let go of them."""
    _kept[owner] = drop


def give_back() -> None:
    """Returns freed memory to the system; both allocators hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _enter(owner: str) -> None:
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name)()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 0
    for batch in batches:
        size += batch.nbytes
        yield batch
        del batch
        if size >= RETURN_EACH:
            size = 0
            give_back()


def lean(work: Work, owner: str = "") -> Work:
    """``work`` for mapInArrow, in a worker without the tables of other operators; what it frees goes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(owner)
        try:
            yield from work(_counted(batches))
        finally:
            give_back()

    return run
