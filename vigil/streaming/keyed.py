"""Keyed state of the interval scorer: one state value per block of sensors, intervals closed by event-time timers.

``closed_intervals`` turns event lines into a stream of rows about intervals that are over::

    lines -> parse -> watermark -> one row per (batch of rows, sensor, interval)   partial, in the tasks
          -> keyed state per block of sensors (``transformWithStateInPandas`` on a RocksDB store)

A call into Python, a state value and a timer per sensor and micro-batch cost far more than the readings in them, so the sensors
above the first ``SINGLE`` share a key by ``BLOCK`` and are handled as columns.  A block's state holds the last value of
its sensors' closed intervals and, for each open interval of a sensor, the last reading so far.
A timer at the end of its first open interval fires when the watermark has passed it, and the interval's readings go out
with the values before them.  Key 0 is the clock: it counts the lines of each interval, malformed ones included, and
its timers report every interval as it ends, with readings, with malformed lines only or empty.  Lines of
intervals that are over count as late.  A micro-batch touches the state of the blocks it holds
readings or ends intervals of; no other state is read or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.functions import events as fe
from vigil.operators.events import parse_event_lines
from vigil.operators.intervals import interval_id

FAR_FUTURE = "9999-12-31 00:00:00"
CLOCK = 0  # the key that counts lines; sensors begin at 1
#: Sensors up to SINGLE have keys of their own, those above share one by BLOCK.  Fixed values: a checkpoint's keys depend on them
#: (and on nothing else, so a query may start anew with more sensors).
SINGLE, BLOCK = 64, 256

#: Settings of the state store: RocksDB, of which a batch uploads the changes only.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Kinds of output rows.
READING, INTERVAL, EMPTY, GAP, LATE = "reading", "interval", "empty", "gap", "late"
OUTPUT = "kind string, interval_id bigint, sensor int, value double, prev double, n bigint, n_lines bigint"
_PARTIAL = "key int, interval_id bigint, at bigint, part string, seq bigint, value double, n bigint, n_lines bigint"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of rows: the last reading and the count of each (sensor, interval), the line counts of each interval."""
    for b in batches:
        rows = b.to_pandas()
        ok = rows[rows["ok"]].sort_values(["key", "interval_id", "at", "part", "seq"], kind="stable")
        by = ["key", "interval_id"]
        last = ok.drop_duplicates(by, keep="last")[by + ["at", "part", "seq", "value"]]
        last = last.merge(ok.groupby(by, as_index=False).agg(n=("ok", "size")), on=by).assign(n_lines=0)
        lines = rows.groupby("interval_id", as_index=False).agg(n=("ok", "sum"), n_lines=("ok", "size"))
        lines = lines.assign(key=CLOCK, at=0, part="", seq=0, value=0.0)
        out = pd.concat([last, lines], ignore_index=True)
        if len(out):
            fields = {"key": pa.int32(), "interval_id": pa.int64(), "at": pa.int64(), "part": pa.string(), "seq": pa.int64(), "value": pa.float64(), "n": pa.int64(), "n_lines": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c].to_numpy(), t) for c, t in fields.items()], names=list(fields))


def state_key(sensor: Column) -> Column:
    """The key that holds a sensor's state; CLOCK stays itself."""
    return F.when(sensor <= SINGLE, sensor).otherwise(F.floor((sensor - SINGLE - 1) / BLOCK).cast("int") + SINGLE + 1)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in OUTPUT.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"interval_id": "int64", "sensor": "int32", "value": "float64", "prev": "float64", "n": "int64", "n_lines": "int64"})


_LAST = pa.schema([("sensor", pa.int32()), ("value", pa.float64())])
_OPEN = pa.schema([("sensor", pa.int32()), ("interval_id", pa.int64()), ("at", pa.int64()), ("part", pa.string()), ("seq", pa.int64()), ("value", pa.float64()), ("n", pa.int64())])


def _to_bytes(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(rows[f.name].to_numpy(), f.type, from_pandas=False) for f in schema], schema=schema))
    return sink.getvalue().to_pybytes()


def _from_bytes(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(raw))).read_all().to_pandas()


def _latest(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per (sensor, interval), in their order: the last reading (of equals the one that came last), and the sum of ``n``."""
    by = ["sensor", "interval_id"]
    rows = rows.sort_values([*by, "at", "part", "seq"], kind="stable")
    last = rows.drop_duplicates(by, keep="last")
    return last.assign(n=rows.groupby(by, sort=False)["n"].sum().to_numpy()).reset_index(drop=True)


class IntervalState(StatefulProcessor):
    """The state of one key; see the module's text.  Lengths and times are in milliseconds here.

    ``longest_gap``: intervals without lines are reported one by one up to so many in a row, more as one row of kind ``gap``
    with their number, so that a single time far ahead cannot flood the output."""

    def __init__(self, seconds: float, longest_gap: int = 10_000):
        self.us, self.longest_gap = int(round(seconds * 1_000_000)), int(longest_gap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "following bigint, ids array<bigint>, n array<bigint>, n_lines array<bigint>")
        self.block = handle.getValueState("block", "last binary, open binary")  # Arrow streams

    def _end(self, interval):
        """The first millisecond at which the interval is over."""
        return -(-((interval + 1) * self.us) // 1000)

    def _load_clock(self) -> tuple[int | None, dict]:
        if not self.clock.exists():
            return None, {}
        following, ids, *columns = self.clock.get()
        return following, {i: list(v) for i, *v in zip(ids, *columns)}

    def _save_clock(self, following: int | None, open_: dict) -> None:
        ids = sorted(open_)
        self.clock.update((following, ids, *[[open_[i][c] for i in ids] for c in range(2)]))

    def _load_block(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        if not self.block.exists():
            return _LAST.empty_table().to_pandas(), _OPEN.empty_table().to_pandas()
        last, open_ = self.block.get()
        return _from_bytes(last), _from_bytes(open_)

    def _save_block(self, last: pd.DataFrame, open_: pd.DataFrame) -> None:
        self.block.update((_to_bytes(last, _LAST), _to_bytes(open_, _OPEN)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        return self._count(rows, now) if int(key[0]) == CLOCK else self._keep(rows, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        return self._report(now) if int(key[0]) == CLOCK else self._close(now)

    def _keep(self, rows, now: int) -> Iterator[pd.DataFrame]:
        """Takes a block's readings; those that are late are counted by the clock."""
        last, open_ = self._load_block()
        for part in rows:
            part = part[self._end(part["interval_id"]) > now]
            if len(part):
                part = part[_OPEN.names]
                open_ = _latest(pd.concat([open_, part], ignore_index=True) if len(open_) else part)
        if len(open_):
            self.handle.registerTimer(int(self._end(open_["interval_id"].min())))
            self._save_block(last, open_)
        yield from ()

    def _close(self, now: int) -> Iterator[pd.DataFrame]:
        """Sends out a block's readings of the intervals that are over."""
        last, open_ = self._load_block()
        over = self._end(open_["interval_id"]) <= now
        out, open_ = open_[over], open_[~over]
        if len(open_):
            self.handle.registerTimer(int(self._end(open_["interval_id"].min())))
        if len(out):
            first = ~out["sensor"].duplicated()
            before = out["sensor"].map(last.set_index("sensor")["value"])
            prev = out["value"].shift().where(~first, before)  # the rows are in the order of sensors and intervals
            last = pd.concat([last, out[_LAST.names]], ignore_index=True).drop_duplicates("sensor", keep="last")
            self._save_block(last, open_)
            out = pd.DataFrame({"kind": READING, "interval_id": out["interval_id"], "sensor": out["sensor"], "value": out["value"], "prev": prev.astype("float64"), "n": out["n"], "n_lines": 0})
            yield out.reset_index(drop=True)

    def _count(self, rows, now: int) -> Iterator[pd.DataFrame]:
        """Counts lines by interval."""
        following, open_ = self._load_clock()
        late: dict[int, list[int]] = {}
        for part in rows:
            sums = part.groupby("interval_id")[["n", "n_lines"]].sum()
            for i, n, lines in zip(sums.index.tolist(), sums["n"].tolist(), sums["n_lines"].tolist()):
                counts = (late if self._end(i) <= now else open_).setdefault(i, [0, 0])
                counts[0], counts[1] = counts[0] + n, counts[1] + lines
        if open_:
            self.handle.registerTimer(self._end(min(open_) if following is None else following))
        if open_ or following is not None:
            self._save_clock(following, open_)
        if late:
            yield _frame([(LATE, i, CLOCK, None, None, n, lines) for i, (n, lines) in sorted(late.items())])

    def _report(self, now: int) -> Iterator[pd.DataFrame]:
        """Reports the intervals that are over."""
        following, open_ = self._load_clock()
        out = []
        for i in sorted(i for i in open_ if self._end(i) <= now):
            out += self._gap(i if following is None else following, i)
            n, lines = open_.pop(i)
            out.append((INTERVAL, i, CLOCK, None, None, n, lines))
            following = i + 1
        if open_ and following is not None:  # what lies before the watermark is empty: later lines have come
            upto = min(now * 1000 // self.us, min(open_))
            if upto > following:
                out += self._gap(following, upto)
                following = upto
        if open_:
            self.handle.registerTimer(self._end(min(open_) if following is None else following))
        if out:
            self._save_clock(following, open_)
            yield _frame(out)

    def _gap(self, first: int, to: int) -> list[tuple]:
        """Rows for the intervals from ``first`` up to ``to``, all empty."""
        if to - first > self.longest_gap:
            return [(GAP, first, CLOCK, None, None, to - first, 0)]
        return [(EMPTY, i, CLOCK, None, None, 0, 0) for i in range(first, to)]

    def close(self) -> None:
        pass


def closed_intervals(lines: DataFrame, n_sensors: int | Column, seconds: float, delay: str, longest_gap: int = 10_000) -> DataFrame:
    """Streaming frame of ``OUTPUT`` rows for the intervals that a micro-batch's watermark has passed.

    Kinds: ``reading`` (a sensor's last ``value`` of the interval, its value ``prev`` of an earlier one, null if there is
    none, and its ``n`` readings), ``interval`` (``n`` readings and ``n_lines`` lines of an interval that had
    lines), ``empty`` and ``gap`` (intervals without lines), ``late`` (lines that came after their interval was over).
    Lines without a time belong to no interval and count as rejected only.  Of two readings of a sensor at one
    millisecond the later one by (``partition``, ``seq``) counts, if the source has these columns.

    Observed metrics per micro-batch: ``eos`` (any end-of-stream record), ``lines`` and ``rejected``."""
    parsed = parse_event_lines(lines, n_sensors)
    parsed = parsed.observe("eos", F.max((F.col("status") == fe.CONTROL).cast("int")).alias("eos"),
                            F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("status").isin(fe.OK, fe.CONTROL)).alias("rejected"))
    far = F.lit(FAR_FUTURE).cast("timestamp")
    timed = parsed.withColumn("ts", F.when(F.col("status") == fe.CONTROL, far).otherwise(F.col("ts")))
    # the filter must reference the event-time column, or Catalyst pushes it below the
    # watermark and the end-of-stream record never advances it
    timed = timed.withWatermark("ts", delay).where(F.col("ts") < far)
    arrival = [F.col("partition").cast("string") if "partition" in timed.columns else F.lit(""), F.col("seq").cast("long") if "seq" in timed.columns else F.lit(0).cast("long")]
    rows = timed.select(F.coalesce("sensor", F.lit(0)).alias("key"), interval_id(F.col("ts"), seconds).alias("interval_id"), F.unix_micros("ts").alias("at"),
                        arrival[0].alias("part"), arrival[1].alias("seq"), F.coalesce("value", F.lit(0.0)).alias("value"), (F.col("status") == fe.OK).alias("ok"))
    partial = rows.mapInArrow(_partial, _PARTIAL).withColumn("sensor", F.col("key")).withColumn("key", state_key(F.col("key")))
    return partial.groupBy("key").transformWithStateInPandas(
        IntervalState(seconds, longest_gap), OUTPUT, "append", "EventTime")


def with_store(spark: SparkSession, start):
    """``start()`` with the settings of the state store in force (a query keeps them in its checkpoint)."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
