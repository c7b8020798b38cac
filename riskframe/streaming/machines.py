"""Keyed machines: one step function for a stream and for a batch.

A machine is a pair of plain functions over the rows of one key in the order of their time:

- ``step(state, row) -> (state, rows)``: the state after a row, and the rows that it gives;
- ``expire(state) -> (state, rows)``: the same when the state's ``until`` has come.

The state is a dict with the fields of a declared schema, among them ``until`` (event time in ms), or
None. A row is a dict of the wanted columns and ``ms``, its event time.

As a stream (``transformWithState`` on RocksDB) a key has a typed value state, and a list state of the
rows that wait. Rows settle: they wait until the watermark has passed them and then go through the
machine in the order of their time, whatever micro-batches they came in, so that the stream gives the
rows of the batch. A key has a timer for each micro-batch that brought rows and one for its ``until``.
With ``settle=False`` rows go through as they come, in order within a micro-batch: answers at once,
which depend on the arrival. Rows without a key have no state: they never meet in one state group.

As a batch the rows are dealt out by key, sorted there by Spark, and go through one after the other;
no group is ever held in memory.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[dict | None, dict], tuple[dict | None, list[dict]]]
Expire = Callable[[dict], tuple[dict | None, list[dict]]]


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state and timers need the RocksDB store; a session's own choice of it is left as it is."""
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def gone(state: dict) -> tuple[None, list]:
    """The plainest ``expire``: the state goes and gives nothing."""
    return None, []


def _until(state: dict | None, ms: float, expire: Expire, out: list[dict]) -> dict | None:
    while state is not None and state["until"] <= ms:
        state, more = expire(state)
        out += more
    return state


def run(state: dict | None, rows: Iterable[dict], step: Step, expire: Expire, end: float | None = None) -> tuple[dict | None, list[dict]]:
    """The rows of one key in order, then what runs out until ``end``."""
    out: list[dict] = []
    for row in rows:
        state = _until(state, row["ms"], expire, out)
        state, more = step(state, row)
        out += more
    if end is not None:
        state = _until(state, end, expire, out)
    return state, out


def _place(order: list[str]):
    return lambda row: (row["us"], *((row[c] is not None, row[c] if row[c] is not None else 0) for c in order))


class _Machine(StatefulProcessor):
    def __init__(self, key: str, state: T.StructType, row: T.StructType, out: T.StructType, order: list[str], step: Step, expire: Expire, settle: bool) -> None:
        self.key, self.state, self.row, self.out, self.order, self.step, self.expire, self.settle = key, state, row, out.names, order, step, expire, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)
        if self.settle:
            self.waiting = handle.getListState("waiting", self.row)

    def _go(self, key: object, rows: list[dict], end: float | None) -> Iterator[Row]:
        before = dict(zip(self.state.names, self.held.get())) if self.held.exists() else None
        rows = [{**r, self.key: key, "ms": r["us"] // 1000} for r in sorted(rows, key=_place(self.order))]
        after, made = run(None if before is None else dict(before), rows, self.step, self.expire, end)
        if after is None:
            if before is not None:
                self.held.clear()
        elif after != before:
            self.held.update(tuple(after[f] for f in self.state.names))
            if before is None or after["until"] != before["until"]:
                self.handle.registerTimer(int(after["until"]))
        for row in made:
            yield Row(**{f: {self.key: key, **row}.get(f) for f in self.out})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        arrived = [{f: r[f] for f in self.row.names} for r in rows]
        if not self.settle:
            return self._go(key[0], arrived, None)
        self.waiting.appendList([tuple(r.values()) for r in arrived])
        self.handle.registerTimer(max(r["us"] for r in arrived) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed, rows = timerValues.getCurrentWatermarkInMs(), []
        if self.settle and self.waiting.exists():
            waiting = [dict(zip(self.row.names, r)) for r in self.waiting.get()]
            rows = [r for r in waiting if r["us"] // 1000 <= passed]
            if rows:
                later = [tuple(r.values()) for r in waiting if r["us"] // 1000 > passed]
                self.waiting.put(later) if later else self.waiting.clear()
        return self._go(key[0], rows, passed)

    def close(self) -> None:
        pass


def _parts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The key, event time in microseconds, and the wanted columns."""
    return rows.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *[c for c in columns if c != key], F.col("ts").cast("timestamp").alias("ts"))


def stream(rows: DataFrame, key: str, columns: list[str], order: list[str], state: str, out: str, step: Step, expire: Expire = gone, delay: str = "10 minutes", settle: bool = True) -> DataFrame:
    """The machine over a stream with a timestamp column ``ts``; rows without a key are left out."""
    use_rocksdb(rows.sparkSession)
    parts = _parts(rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay), key, columns).where(F.col(key).isNotNull())
    row, shape = T.StructType([parts.schema[n] for n in ("us", *[c for c in columns if c != key])]), T.StructType.fromDDL(out)
    machine = _Machine(key, T.StructType.fromDDL(state), row, shape, order, step, expire, settle)
    return parts.groupBy(key).transformWithState(machine, shape, "Append", "EventTime")


def batch(rows: DataFrame, key: str, columns: list[str], order: list[str], out: str, step: Step, expire: Expire = gone, end: datetime.datetime | None = None, close: bool = False) -> DataFrame:
    """The machine over a table. States that run out until ``end``, or all with ``close``, give their last rows."""
    parts = _parts(rows, key, columns).drop("ts").where(F.col(key).isNotNull())
    names, shape = parts.columns, T.StructType.fromDDL(out)
    last = float("inf") if close else None if end is None else end.replace(tzinfo=end.tzinfo or datetime.timezone.utc).timestamp() * 1000
    types = [pa.field(f.name, _arrow(f.dataType)) for f in shape.fields]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, made, any_row = None, None, [], False

        def flush() -> pa.RecordBatch:
            columns_ = [pa.array([r.get(f.name) for r in made], type=f.type) for f in types]
            made.clear()
            return pa.RecordBatch.from_arrays(columns_, schema=pa.schema(types))

        def ended() -> None:
            if last is not None:
                made.extend({key: current, **r} for r in run(held, (), step, expire, last)[1])

        for part in batches:
            lists = [part.column(i).to_pylist() for i in range(len(names))]
            for values in zip(*lists):
                row = dict(zip(names, values))
                if not any_row or row[key] != current:
                    if any_row:
                        ended()
                    current, held, any_row = row[key], None, True
                held, more = run(held, ({**row, "ms": row["us"] // 1000},), step, expire)
                made.extend({key: current, **r} for r in more)
            if made:
                yield flush()
        if any_row:
            ended()
            if made:
                yield flush()

    return parts.repartition(F.col(key)).sortWithinPartitions(key, "us", *order).mapInArrow(go, shape)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
