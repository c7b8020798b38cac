"""Calls to a model or provider with several in flight inside each task.

A task keeps a window of rows whose calls are under way on a bounded pool of threads, and gives rows back in
their order as the first of them is answered. A slow row holds back only what is given back after it: the calls
behind it go on, as far as the window reaches. A failed row is asked again after a pause, alone; rows that were
answered are never asked twice. ``spacing_s`` keeps that time between the starts of any two calls of a task.

Rows come and go as Arrow batches; a task holds the window's rows and no more.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Ask = Callable[[dict], object]


class _Pace:
    """At least ``spacing_s`` between the starts of calls."""

    def __init__(self, spacing_s: float) -> None:
        self.spacing_s, self.lock, self.next = spacing_s, threading.Lock(), 0.0

    def wait(self) -> None:
        if self.spacing_s <= 0:
            return
        with self.lock:
            now = time.monotonic()
            start = max(now, self.next)
            self.next = start + self.spacing_s
        if start > now:
            time.sleep(start - now)


def answers(rows: Iterator[dict], ask: Ask, in_flight: int, ahead: int, retries: int, pause_s: float, spacing_s: float) -> Iterator[tuple[dict, object, str | None, int]]:
    """(row, answer, error, calls) in the order of the rows."""
    pace = _Pace(spacing_s)

    def call(row: dict) -> tuple[object, str | None, int]:
        for n in range(retries + 1):
            pace.wait()
            try:
                return ask(row), None, n + 1
            except Exception as fault:  # noqa: BLE001  whatever a provider raises costs only its row
                error = type(fault).__name__
                if n < retries:
                    time.sleep(pause_s * 2**n)
        return None, error, retries + 1

    window: deque = deque()
    with ThreadPoolExecutor(max_workers=in_flight) as pool:
        for row in rows:
            if len(window) >= ahead:
                first, future = window.popleft()
                yield (first, *future.result())
            window.append((row, pool.submit(call, row)))
            while window and window[0][1].done():
                first, future = window.popleft()
                yield (first, *future.result())
        while window:
            first, future = window.popleft()
            yield (first, *future.result())


def call_each(
    rows: DataFrame, ask: Ask, out: str = "answer", kind: str = "string", columns: list[str] | None = None, tasks: int | None = None,
    in_flight: int = 8, ahead: int = 256, retries: int = 1, pause_s: float = 0.0, spacing_s: float = 0.0,
) -> DataFrame:
    """rows with ``out`` (what ``ask`` returns for the row's ``columns`` as a dict), ``error`` (the kind of the last fault) and ``calls``.

    Calls in flight are ``tasks`` x ``in_flight`` at most: with ``tasks`` the rows are dealt out to so many tasks, else to as many as they
    come in. The order of rows within a task is kept."""
    from pyspark.sql.pandas.types import to_arrow_schema

    given = columns or rows.columns
    own = [f for f in rows.schema.fields if f.name not in (out, "error", "calls")]
    shape = T.StructType([*own, *T.StructType.fromDDL(f"`{out}` {kind}, error string, calls int").fields])
    schema, names = to_arrow_schema(shape), [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for i in range(len(batch)):
                    one = batch.slice(i, 1)
                    yield {"row": one, **{c: one.column(c)[0].as_py() for c in given}}

        def ask_row(row: dict) -> object:
            return ask({c: row[c] for c in given})

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches([h[0] for h in held]).select(names).combine_chunks().to_batches()[0]
            arrays = [pa.array([h[k] for h in held], type=schema.field(len(names) + k - 1).type) for k in (1, 2, 3)]
            held.clear()
            return pa.RecordBatch.from_arrays([*[c.cast(schema.field(i).type) for i, c in enumerate(whole.columns)], *arrays], schema=schema)

        for row, answer, error, calls in answers(each(), ask_row, in_flight, max(ahead, in_flight), retries, pause_s, spacing_s):
            held.append((row["row"], answer, error, calls))
            if len(held) >= 1024:
                yield flush()
        if held:
            yield flush()

    dealt = rows.repartition(tasks) if tasks else rows
    return dealt.mapInArrow(run, shape)
