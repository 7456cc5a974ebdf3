"""Objects that a Python worker makes once and keeps for its later tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _store() -> dict:
    return sys.modules.setdefault("_rolecall_worker", ModuleType("_rolecall_worker")).__dict__.setdefault("kept", {})


def dropped(key: Hashable) -> None:
    """Frees what :func:`kept` made for this key."""
    _store().pop(key, None)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` made for this key in this process. Functions reach workers by
    value and bring their module's state anew each time, so it is kept beside them."""
    store = _store()
    if key not in store:
        store[key] = make()
    return store[key]


def _give_back() -> None:
    """Hands memory that is free to the system: Arrow's, and where the C library can, its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Batches) -> Batches:
    """``run`` for ``mapInArrow``, giving back after each batch what Arrow freed but would hold
    on to. Else that stays with the worker, beside what its next batch or task takes."""
    def spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(spare(batches))
        finally:
            _give_back()
    return whole


def only(run: Batches, *keys: Hashable) -> Batches:
    """``run``, freeing first what is :func:`kept` under other ``keys``: a worker goes on from
    stage to stage, and what an earlier one made would stay beside what this one takes."""
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if others := _store().keys() - set(keys):
            for key in others:
                dropped(key)
            gc.collect()
            _give_back()
        yield from run(batches)
    return alone
