"""What Python workers hold between tasks: they are reused by later stages, so each task gives its memory back."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa


def tidy() -> None:
    """Return free memory of Python, Arrow and the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: list[tuple[frozenset[str], Callable[[], bool]]] = []


def keep_for(modules: set[str], forget: Callable[[], bool]) -> None:
    """What a module keeps between tasks is for the functions of these modules; `forget` drops it, and tells whether there was any."""
    _KEPT.append((frozenset(modules), forget))


def begin(module: str) -> None:
    """A task of a module's function begins: what others have kept in this worker goes."""
    if any([forget() for modules, forget in _KEPT if module not in modules]):
        tidy()


def tidied(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over batches, tidy at its end."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # its free memory can be given back
        begin(function.__module__)
        try:
            yield from function(batches)
        finally:
            tidy()

    return run


_LAST = [0.0]


def tidied_group(function: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The function over a group's rows, tidy once in a while."""

    @functools.wraps(function)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        begin(function.__module__)
        out = function(rows)
        if time.monotonic() - _LAST[0] > 1:
            tidy()
            _LAST[0] = time.monotonic()
        return out

    return run
