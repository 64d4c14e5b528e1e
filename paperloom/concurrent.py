"""Calls of a slow function over a batch: some at a time, failures tried again later, results in input order."""

from __future__ import annotations

import asyncio
import inspect
import random
from collections.abc import Awaitable, Callable, Sequence
from dataclasses import dataclass, field

Call = Callable[..., object]
Sleep = Callable[[float], Awaitable[None]]


@dataclass
class Retry:
    """How often a call is tried, and how long a failed one waits: delay, doubled each time up to `longest`, plus up to `jitter` of itself.

    `budget` bounds the retries of all calls that share this object; None is no bound.
    """

    attempts: int = 1
    delay: float = 0.0
    longest: float = 60.0
    jitter: float = 0.0
    budget: int | None = None
    seed: int = 0
    sleep: Sleep = asyncio.sleep
    used: int = field(default=0, init=False)

    def wait(self, failed: int, place: int) -> float:
        """Seconds before the next attempt of the call at this place; the same for the same seed."""
        base = min(self.delay * 2 ** (failed - 1), self.longest)
        return base * (1 + self.jitter * random.Random(f"{self.seed} {place} {failed}").random())

    def take(self) -> bool:
        if self.budget is not None and self.used >= self.budget:
            return False
        self.used += 1
        return True


async def _call(function: Call, arguments: tuple) -> object:
    if inspect.iscoroutinefunction(function) or inspect.iscoroutinefunction(getattr(function, "__call__", None)):
        return await function(*arguments)
    found = await asyncio.to_thread(function, *arguments)
    return await found if inspect.isawaitable(found) else found


async def gather(function: Call, rows: Sequence[tuple], concurrency: int, retry: Retry) -> list[tuple[object, Exception | None]]:
    """For each row of arguments, the result and None, or None and the last failure. A failed call gives its place up while it waits."""
    gate = asyncio.Semaphore(max(1, concurrency))

    async def one(place: int, arguments: tuple) -> tuple[object, Exception | None]:
        for failed in range(1, max(1, retry.attempts) + 1):
            async with gate:
                try:
                    return await _call(function, arguments), None
                except Exception as e:
                    error = e
            if failed >= retry.attempts or not retry.take():
                break
            await retry.sleep(retry.wait(failed, place))
        return None, error

    return await asyncio.gather(*(one(k, row) for k, row in enumerate(rows)))


def call_all(function: Call, rows: Sequence[tuple], concurrency: int = 10, retry: Retry | None = None) -> list[tuple[object, Exception | None]]:
    """`gather` for callers without an event loop. A plain function that is called one at a time runs in this thread."""
    retry = retry or Retry()
    if concurrency <= 1 and retry.delay == 0 and not inspect.iscoroutinefunction(function):
        return [_in_turn(function, row, retry) for row in rows]
    return asyncio.run(gather(function, rows, concurrency, retry))


def _in_turn(function: Call, arguments: tuple, retry: Retry) -> tuple[object, Exception | None]:
    for failed in range(1, max(1, retry.attempts) + 1):
        try:
            return function(*arguments), None
        except Exception as e:
            error = e
        if failed >= retry.attempts or not retry.take():
            break
    return None, error
