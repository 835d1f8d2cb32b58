"""Caches of the Python workers, one operator's at a time.

Workers outlive stages, so what one operator remembers would stay beside what the next one does. A task
says whose caches it is going to use; those of the other operators are emptied.
"""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}
_USED: set[str] = set()


def register(name: str, clear: Callable[[], None]) -> None:
    """``clear`` empties what operator ``name`` remembers in this process."""
    _CLEAR[name] = clear


def only(name: str) -> None:
    """From now on operator ``name`` runs here."""
    others = _USED - {name}
    _USED.add(name)
    for other in others:
        _USED.discard(other)
        if other in _CLEAR:
            _CLEAR[other]()
    if others:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)  # back to the system, where the C library can
        except (AttributeError, OSError):
            pass
