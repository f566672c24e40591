"""What a Python worker keeps from one task to the next. Spark uses its workers again for other jobs, so what these kept has to go."""

from __future__ import annotations

_KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    """Registers a cache."""
    _KEPT.append(cache)
    return cache


def only(cache: dict) -> None:
    """Empties all other caches."""
    for other in _KEPT:
        if other is not cache:
            other.clear()
