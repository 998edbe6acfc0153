"""Tables that Python workers keep between tasks, at most one operator's at a time.

Workers are reused, so what one operator keeps would stay while the next runs. enter(name) in a task
empties what other operators have kept in this process.
"""

from __future__ import annotations

from collections.abc import Callable

_kept: dict[str, list[Callable[[], None]]] = {}


def enter(name: str) -> None:
    for other in [k for k in _kept if k != name]:
        for clear in _kept.pop(other):
            clear()


def hold(name: str, clear: Callable[[], None]) -> None:
    """clear() empties something that operator `name` keeps; every task may say so again."""
    if clear not in (held := _kept.setdefault(name, [])):
        held.append(clear)
