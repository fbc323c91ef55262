"""What a Python worker keeps from one task to the next.

Workers outlive the operator that they ran for, and an executor has one for each core, so what is kept is one thing at a time:
another one takes its place, and tasks of operators that keep nothing let it go first.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

_held: dict = {}


def keep(key: Hashable, make: Callable[[], object]):
    """The thing made under this key, made anew if the worker has another one or none."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()
