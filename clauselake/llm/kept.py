"""What a Python worker keeps from task to task, and lets go when it turns to other work."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_KEPT: dict[str, Any] = {}


def keep(name: str, build: Callable[[], Any]) -> Any:
    """The worker's own ``name``, built when it is first asked for."""
    if name not in _KEPT:
        release()
        _KEPT[name] = build()
    return _KEPT[name]


def release() -> None:
    """Give back what earlier tasks have kept. Spark hands a worker from query to query, so
    work that needs none of it begins with this."""
    _KEPT.clear()
