"""Calls that are tried again: for clients that run on the driver."""

from __future__ import annotations

import time
from collections.abc import Callable

ATTEMPTS, FIRST_WAIT, FACTOR, SHORT_WAIT = 3, 0.25, 2.0, 2.0


class RateLimited(Exception):
    """``wait``: the seconds that the server asks for, or None."""

    def __init__(self, wait: float | None = None):
        super().__init__(f"rate limited, wait {wait}")
        self.wait = wait


def call(f: Callable, *, transient: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """The result of ``f``: transient errors are tried ATTEMPTS times in all, waiting twice as long each time; a rate limit once more if its wait is short."""
    wait, patient = FIRST_WAIT, True
    for attempt in range(1, ATTEMPTS + 1):
        while True:
            try:
                return f()
            except RateLimited as e:
                if not patient or e.wait is None or e.wait > SHORT_WAIT:
                    raise
                patient = False
                sleep(e.wait)
            except transient:
                if attempt == ATTEMPTS:
                    raise
                sleep(wait)
                wait *= FACTOR
                break
    raise AssertionError("unreachable")
