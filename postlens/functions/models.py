"""Models loaded once per Python worker.

The cache lives in an importable module: a function that a task runs is pickled by
reference here, so every task of a worker sees the same dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

_LOADED: dict[str, object] = {}


def load_once(name: str, loader: Callable[[], object]) -> object:
    """The model called ``name``; ``loader`` runs when the worker first asks for it."""
    if name not in _LOADED:
        _LOADED[name] = loader()
    return _LOADED[name]
