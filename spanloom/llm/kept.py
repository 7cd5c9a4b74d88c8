"""What a Python worker keeps from task to task: the tables of one operator at a time.

Spark hands a worker from one query or stage to the next; without this, tables of an earlier one stay in it for good.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_kept: dict[tuple[str, Hashable], Any] = {}


def only(operator: str) -> None:
    """Let go of the tables of all other operators."""
    for key in [k for k in _kept if k[0] != operator]:
        del _kept[key]


def kept(operator: str, key: Hashable, build: Callable[[], Any]) -> Any:
    """The operator's table of this key, built at its first use in this worker."""
    only(operator)
    if (operator, key) not in _kept:
        _kept[operator, key] = build()
    return _kept[operator, key]
