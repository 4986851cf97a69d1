"""Which failures are worth another try, and how long to wait."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from orrery.sources.versioned import ConcurrentCommit

R = TypeVar("R")

#: Names in a failure's text that speak of something passing: lost machines and connections, files that another writer has just replaced.
PASSING = ("FetchFailed", "ExecutorLost", "Connection refused", "Connection reset", "SocketTimeout", "NoRouteToHost", "ConnectException", "TimeoutException", "LeaseExpired", "FileNotFoundException", "StandbyException")


class Retriable(RuntimeError):
    """A failure that the next try may not meet."""


def retriable(e: BaseException) -> bool:
    """Concurrent commits, what is marked as Retriable, timeouts and lost connections, and JVM failures that speak of such. Broken rules and wrong definitions never are."""
    if isinstance(e, (Retriable, ConcurrentCommit, ConnectionError, TimeoutError)):
        return True
    if isinstance(e, (ValueError, TypeError, KeyError, AttributeError)):
        return False
    return any(name in str(e) for name in PASSING)


def attempt(work: Callable[[], R], tries: int = 3, wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> R:
    """``work()``, tried again after ``wait``, 2 x ``wait``, 4 x ``wait`` ... seconds while its failures are retriable; concurrent commits wait a thirtieth of that."""
    for n in range(tries):
        try:
            return work()
        except Exception as e:
            if n + 1 == tries or not retriable(e):
                raise
            sleep((wait / 30 if isinstance(e, ConcurrentCommit) else wait) * 2**n)
    raise AssertionError("unreachable")
