"""Calls of a service from a task: some at once on an event loop, answers in the order of the questions."""

from __future__ import annotations

import asyncio
import inspect
import random
from collections import deque
from collections.abc import Awaitable, Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from lettermill.functions import patterns as P

#: Calls of one task at once, if nothing else is said.
IN_FLIGHT = 4


class Rejected(Exception):
    """What a service answered with a status that isn't tried again."""


async def once(call: Callable, pool: ThreadPoolExecutor, *args):
    """The answer of a call, which is a coroutine function or a plain one (then it runs in a thread)."""
    if inspect.iscoroutinefunction(call):
        return await call(*args)
    return await asyncio.get_running_loop().run_in_executor(pool, call, *args)


async def retried(call: Callable, pool: ThreadPoolExecutor, content, tries: int = 5, base: float = 1.0, jitter: float = 1.0, sleep: Callable[[float], Awaitable | None] = asyncio.sleep) -> str:
    """The answer of a call (status, body); overload and transport errors are tried again after growing waits, in which other calls go on."""
    for k in range(1, tries + 1):
        try:
            status, body = await once(call, pool, content)
            if status < 400:
                return body
            error: Exception = Rejected(f"HTTP {status}")
            if status not in P.RETRIED:
                raise error
        except (ConnectionError, TimeoutError, ValueError) as e:  # a ValueError: the answer isn't what was asked for
            error = e
        if k < tries and (wait := sleep(base * 2 ** (k - 1) + random.uniform(0, jitter))) is not None:
            await wait
    raise error


def in_order(questions: Iterable, ask: Callable[[ThreadPoolExecutor, object], Awaitable], in_flight: int = IN_FLIGHT) -> Iterator[tuple]:
    """(question, answer, error) of each question, in order; no more than in_flight are asked at once, and no more are read ahead.

    ask gets the threads for plain calls and a question. The loop belongs to the caller's task and ends with it.
    """
    if in_flight < 1:
        raise ValueError("one call at least is in flight")
    loop, pool, waiting = asyncio.new_event_loop(), ThreadPoolExecutor(in_flight), deque()

    def first() -> tuple:
        question, future = waiting.popleft()
        try:
            return question, loop.run_until_complete(future), None
        except Exception as e:  # noqa: BLE001  every failure is reported in its row
            return question, None, f"{type(e).__name__}: {e}"

    try:
        for question in questions:
            waiting.append((question, loop.create_task(ask(pool, question))))
            if len(waiting) == in_flight:
                yield first()
        while waiting:
            yield first()
    finally:
        for _, future in waiting:
            future.cancel()
        loop.run_until_complete(asyncio.sleep(0))
        loop.close()
        pool.shutdown(wait=False, cancel_futures=True)


def then(call: Callable, check: Callable) -> Callable:
    """call, whose answer goes through check; a coroutine function, if call is one."""
    if not inspect.iscoroutinefunction(call):
        return lambda *args: check(*call(*args))

    async def both(*args):
        return check(*await call(*args))

    return both


def tasks_for(most: int | None, in_flight: int) -> int | None:
    """So many tasks that all of them together have no more than most calls in flight."""
    if most is not None and most < in_flight:
        raise ValueError("a task alone would have more calls in flight than all may have")
    return None if most is None else most // in_flight
