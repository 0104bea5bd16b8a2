"""What a Python worker keeps between tasks: the cache of one operator at a time.

Workers outlive the stages of a pipeline, so what one stage has cached would stand beside the memory of all later ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa

_HELD: dict[tuple[str, str], Any] = {}


def held(operator: str, key: str, make: Callable[[], Any]) -> Any:
    """The operator's cache for a key, made if this worker has none; any other cache goes."""
    if (operator, key) not in _HELD:
        _HELD.clear()
        _HELD[operator, key] = make()
    return _HELD[operator, key]


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function of batches that needs its memory for itself: caches go before it, and what Arrow has left over after it."""

    @wraps(run)
    def apply(*args) -> Iterator:
        _HELD.clear()
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()

    return apply
