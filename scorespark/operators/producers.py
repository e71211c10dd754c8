"""Run user-supplied producers over samples, in Arrow batches, one error per failing row."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame

REGISTRY: dict[str, Callable[[str], str]] = {}
BATCHES: dict[str, Callable[[list[str]], list[str]]] = {}


def register(name: str):
    """Add a producer `text -> output` under a tool name."""

    def add(fn: Callable[[str], str]) -> Callable[[str], str]:
        REGISTRY[name] = fn
        return fn

    return add


def register_batch(name: str):
    """Add a producer `texts -> outputs` for tools that are dear to start: it is called once per batch of texts."""

    def add(fn: Callable[[list[str]], list[str]]) -> Callable[[list[str]], list[str]]:
        BATCHES[name] = fn
        return fn

    return add


@contextmanager
def _time_limit(seconds: float | None) -> Iterator[None]:
    """Stop what runs inside after so many seconds. Workers run their task in the main thread, where the timer's signal
    arrives."""

    def expire(*_) -> None:
        raise TimeoutError(f"stopped after {seconds:g} s")

    if seconds is None:
        yield
        return
    before = signal.signal(signal.SIGALRM, expire)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _attempt(fn: Callable, argument, seconds: float | None) -> tuple[object, str | None]:
    try:
        with _time_limit(seconds):
            return fn(argument), None
    except Exception as exc:
        return None, f"{type(exc).__name__}: {exc}"


def _in_batches(fn: Callable[[list[str]], list[str]], texts: list[str], size: int, seconds: float | None) -> Iterator[tuple[str | None, str | None]]:
    """A batch that fails as a whole, or returns another number of outputs, is run again text by text, so that only the
    texts that fail alone have an error. A batch has the time of all its texts."""
    for start in range(0, len(texts), size):
        own = texts[start : start + size]
        outputs, error = _attempt(fn, own, seconds and seconds * len(own))
        if error is None and len(outputs) == len(own):
            yield from ((o, None) for o in outputs)
        elif len(own) > 1:
            yield from _in_batches(fn, own, 1, seconds)
        else:
            yield None, error or f"ValueError: {len(outputs)} outputs for one text"


def run(samples: DataFrame, tool: str, text: str = "expected_text", seconds: float | None = None, batch_size: int = 10) -> DataFrame:
    """(sample_id, tool, output, error). A row that fails, or takes longer than ``seconds``, gives its error and does not
    stop the others; a NULL text gives the error `no input`. A batch producer gets ``batch_size`` texts at a time."""
    many, one = BATCHES.get(tool), REGISTRY.get(tool)
    if many is None and one is None:
        raise KeyError(f"no producer {tool}")

    def results(texts: list[str | None]) -> list[tuple[str | None, str | None]]:
        given = [t for t in texts if t is not None]
        done = iter(_in_batches(many, given, batch_size, seconds) if many else (_attempt(one, t, seconds) for t in given))
        return [(None, "no input") if t is None else next(done) for t in texts]

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = results([None if pd.isna(v) else v for v in frame[text]])
            yield pd.DataFrame(
                {"sample_id": frame["sample_id"], "tool": tool, "output": [r[0] for r in found], "error": [r[1] for r in found]}
            )

    return samples.select("sample_id", text).mapInPandas(batch, "sample_id string, tool string, output string, error string")
