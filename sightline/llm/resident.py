"""What Python workers keep between their tasks.

A worker outlives its tasks and serves all operators of an application, one after
another. What one operator keeps in it (ranks and known words, a scorer) would
stay beside all that later ones need, so a task first lets go what other operators
kept, and in the end gives freed memory back to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa

#: Rows of a batch that are taken, and given on, at once; bounds what a task holds beside the batch.
ROWS = 500
_KEPT: dict[str, tuple] = {}


def kept(operator: str, key, make):
    """What the operator keeps in this worker under the key; made anew, without the former one, if the key is another."""
    if operator not in _KEPT or _KEPT[operator][0] != key:
        _KEPT.pop(operator, None)
        _KEPT[operator] = key, make()
    return _KEPT[operator][1]


def only(operator: str) -> None:
    """Let go what other operators kept in this worker."""
    for other in _KEPT.keys() - {operator}:
        del _KEPT[other]


def trim() -> None:
    """Give freed memory back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches):
    """All rows of the batches, in batches of at most ``ROWS``."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def lean(operator: str = ""):
    """For a function over batches: nothing of other operators stays in its worker, and freed memory does not either."""

    def wrap(run):
        @functools.wraps(run)
        def task(batches):
            only(operator)
            trim()
            try:
                yield from run(batches)
            finally:
                trim()

        return task

    return wrap
