"""One model, with its caches, that a Python worker keeps from task to task. A model of another operator takes its place,
so that a worker that serves many operators holds the memory of one."""

from __future__ import annotations

from collections.abc import Callable

_slot: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]
