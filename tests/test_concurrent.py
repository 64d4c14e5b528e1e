import asyncio
import time

import pytest

from paperloom.concurrent import Retry, call_all, gather
from paperloom.plans import documents as plans
from paperloom.providers import apply_function, apply_provider


class Clock:
    """Time that passes only while someone sleeps."""

    def __init__(self):
        self.now, self.waits = 0.0, []

    async def sleep(self, seconds):
        self.waits.append(seconds)
        due = self.now + seconds
        while self.now < due:
            await asyncio.sleep(0)
            self.now = max(self.now, min(due, self.now + 1))


def test_results_keep_their_order_and_some_run_at_a_time():
    running, most = 0, 0

    async def slow(x):
        nonlocal running, most
        running += 1
        most = max(most, running)
        await asyncio.sleep(0.01 * (5 - x % 5))
        running -= 1
        return x * 2

    assert [r for r, _ in call_all(slow, [(x,) for x in range(40)], 10)] == [2 * x for x in range(40)]
    assert most == 10


def test_a_failed_call_waits_without_holding_others_up():
    clock, log = Clock(), []

    async def call(x):
        log.append(x)
        if x == 0 and log.count(0) < 4:
            raise OSError("busy")
        return x

    retry = Retry(attempts=4, delay=5, longest=12, sleep=clock.sleep)
    found = asyncio.run(gather(call, [(x,) for x in range(5)], 1, retry))
    assert [r for r, _ in found] == [0, 1, 2, 3, 4]
    assert log[:5] == [0, 1, 2, 3, 4] and log[5:] == [0, 0, 0]
    assert clock.waits == [5, 10, 12]


def test_attempts_and_budget_end():
    def broken(x):
        raise ValueError(f"no {x}")

    clock = Clock()
    retry = Retry(attempts=3, delay=1, budget=3, sleep=clock.sleep)
    found = asyncio.run(gather(broken, [(1,), (2,)], 2, retry))
    assert [str(e) for _, e in found] == ["no 1", "no 2"] and retry.used == 3 == len(clock.waits)
    assert call_all(broken, [(3,)], 1, Retry(attempts=2))[0][1].args == ("no 3",)


def test_waits_are_the_same_for_a_seed():
    a, b = Retry(delay=2, jitter=0.5, seed=1), Retry(delay=2, jitter=0.5, seed=1)
    assert a.wait(1, 7) == b.wait(1, 7) and 2 <= a.wait(1, 7) <= 3 and a.wait(1, 8) != a.wait(1, 7)


def sleeper():
    async def run(path, content):
        await asyncio.sleep(0.05)
        if path == "bad":
            raise RuntimeError("cannot read")
        return None if content is None else f"{path} {len(content)}"

    return run


def test_a_callers_coroutine_over_members(spark):
    rows = [(k, "bad" if k == 7 else f"m{k}", None if k == 9 else bytes(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "key int, member_path string, content binary").coalesce(1)
    start = time.perf_counter()
    got = {r.key: (r.text, r.error) for r in apply_function(df, sleeper, ["member_path", "content"]).collect()}
    assert time.perf_counter() - start < 40 * 0.05 + 2
    assert got[7] == (None, "cannot read") and got[9] == (None, None) and got[11] == ("m11 11", None) and len(got) == 40
    with pytest.raises(Exception, match="cannot read"):
        apply_function(df, sleeper, ["member_path", "content"], strict=True).collect()


def test_plain_functions_and_wrong_results(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "key int, path string")
    got = {r.key: (r.text, r.error) for r in apply_function(df, lambda: lambda p: 5 if p else "none", ["path"], concurrency=3).collect()}
    assert got == {1: (None, "a text is expected, not int"), 2: ("none", None)}


def test_provider_with_a_coroutine_and_an_enhancement(spark):
    def reader():
        async def run(value):
            await asyncio.sleep(0)
            return value.decode() if value != b"" else ""

        return run

    df = spark.createDataFrame([(1, b"x"), (2, b"")], "key int, content binary")
    got = {r.key: r.text for r in apply_provider(df, reader, "content", then=lambda: lambda t: t + "!", concurrency=4, retries=1, delay=0.01).collect()}
    assert got == {1: "x!", 2: ""}


def test_members_of_archives_through_a_function(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/one.txt", "1")
        z.writestr("bad", "2")
    df = spark.createDataFrame([(1, out.getvalue(), "application/zip"), (2, b"?", "application/zip")], "key int, content binary, mime string")
    got = sorted((r.key, r.member_path, r.text, r.error) for r in plans.process_members(df, "key", sleeper).collect())
    assert got[:2] == [(1, "a/one.txt", "a/one.txt 1", None), (1, "bad", None, "cannot read")] and got[2][0] == 2 and "BadZipFile" in got[2][3]
