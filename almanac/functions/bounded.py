"""Calls within bounds of time."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

Answer = TypeVar("Answer")


def within(call: Callable[[], Answer], seconds: float | None) -> Answer:
    """What ``call`` gives; TimeoutError when it takes longer, whatever it does after that."""
    if seconds is None:
        return call()
    found: list = []

    def run() -> None:
        try:
            found.append((True, call()))
        except BaseException as problem:  # noqa: BLE001  raised again by the caller
            found.append((False, problem))

    asked = threading.Thread(target=run, daemon=True)
    asked.start()
    asked.join(seconds)
    if not found:
        raise TimeoutError(f"no answer within {seconds} s")
    good, value = found[0]
    if not good:
        raise value
    return value


def or_none(call: Callable[[], Answer], seconds: float) -> Answer | None:
    """What ``call`` gives in time; else None, as for a search that goes by words when its model does not answer."""
    try:
        return within(call, seconds)
    except Exception:  # noqa: BLE001  None says so
        return None
