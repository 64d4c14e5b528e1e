"""Models behind one interface: a factory, called once per task, of a function from inputs to texts.

Recognition, translation and transcription models are not part of the library. `stub` is a
deterministic stand-in for tests and examples; its texts are not recognised or translated.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.concurrent import Retry, call_all

Provider = Callable[[], Callable[..., object]]


def stub(prefix: str = "") -> Provider:
    def make() -> Callable[[object], str | None]:
        def run(value: object) -> str | None:
            text = value.decode("utf-8", "replace") if isinstance(value, bytes) else value
            return None if text is None else f"{prefix}{text.strip()}"

        return run

    return make


async def _result(found: object) -> object:
    return await found if inspect.isawaitable(found) else found


def apply_function(rows: DataFrame, make: Provider, sources: list[str], target: str = "text", strict: bool = False, concurrency: int = 10, retry: Callable[[], Retry] | None = None) -> DataFrame:
    """Rows with `target` (string) and `error`: a caller's function of the source columns, plain or a coroutine, at most `concurrency` calls at a time in a task.

    Order and columns are kept. A call that fails, after the retries that `retry` allows a task, gives
    null and the error's text; with `strict` it fails the task. Results that are not strings are errors.
    """
    names = rows.columns
    places = [names.index(s) for s in sources]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, again = make(), retry() if retry else Retry()
        for batch in batches:
            found = call_all(function, list(zip(*(batch.column(p).to_pylist() for p in places))), concurrency, again)
            for text, error in found:
                if strict and error is not None:
                    raise error
                if strict and not isinstance(text, (str, type(None))):
                    raise TypeError(f"a text is expected, not {type(text).__name__}")
            wrong = [error or (None if isinstance(text, (str, type(None))) else TypeError(f"a text is expected, not {type(text).__name__}")) for text, error in found]
            texts = [None if e else text for (text, _), e in zip(found, wrong)]
            errors = [None if e is None else str(e) or type(e).__name__ for e in wrong]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*names, target, "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{target}` string", "error string"])
    return rows.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def apply_provider(rows: DataFrame, provider: Provider, source: str, target: str = "text", then: Provider | None = None, strict: bool = False, retries: int = 0, concurrency: int = 1, delay: float = 0.0) -> DataFrame:
    """Rows with `target` and `error`: one pass in Arrow batches, order and columns kept.

    An input that fails, after `retries` more attempts with `delay` seconds before them, gives null and
    the error's text; with `strict` it fails the task instead. `then` (an enhancement) runs on results
    that are not empty; its failure always counts for the whole row.
    """

    def make() -> Callable[[object], object]:
        first, second = provider(), then() if then else None

        def plain(value: object) -> object:
            text = first(value)
            return second(text) if text and second else text

        async def waiting(value: object) -> object:
            text = await _result(first(value))
            return await _result(second(text)) if text and second else text

        return waiting if any(inspect.iscoroutinefunction(f) for f in (first, second)) else plain

    return apply_function(rows, make, [source], target, strict, concurrency, lambda: Retry(retries + 1, delay, jitter=0.5))
