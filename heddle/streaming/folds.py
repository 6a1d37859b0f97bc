"""Keyed state machines over ordered events, in batch and as streams.

Each machine is a class whose step() takes one event and gives one row. In
batch, events are sorted by key and time and folded partition by partition as Arrow
batches, so a key's events never have to fit in memory; as a stream, the same
class lives in keyed state. Times are microseconds.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import written


class RollingQuota:
    """At most `limit` admissions in any period, booked ahead (T1); holds only extend (T4); a wait over the budget is refused and withdrawn (T6); a cancelled booking is withdrawn (T5).

    Events: kind (call, hold, cancel), amount (hold: its length; cancel: the booked instant, or with `call` given the call that booked it),
    call (the call's id, so that it can be cancelled by it).
    """

    fields = (("admitted", T.LongType()), ("outcome", T.StringType()))

    def __init__(self, limit: int, period: int, budget: int | None = None) -> None:
        self.limit, self.period, self.budget = limit, period, budget
        self.sent: list[int] = []
        self.hold = 0
        self.calls: dict[str, int] = {}

    def step(self, at: int, kind: str = "call", amount: int | None = None, call: int | None = None) -> tuple:
        if kind == "hold":
            self.hold = max(self.hold, at + (amount or 0))
            return None, "held"
        if kind == "cancel":
            booked = self.calls.pop(str(amount), None) if call is not None else amount
            if booked not in self.sent:
                return None, "unknown"
            self.sent.remove(booked)
            return None, "cancelled"
        when = max(at, self.hold)
        # an admission exactly one period ago no longer counts
        del self.sent[: bisect_right(self.sent, when - self.period)]
        if call is not None:
            # calls whose bookings are gone can't be cancelled
            self.calls = {c: t for c, t in self.calls.items() if t > when - self.period}
        if len(self.sent) >= self.limit:
            when = max(when, self.sent[-self.limit] + self.period)
        if self.budget is not None and when - at > self.budget:
            return None, "quota_exhausted"
        self.sent.append(when)
        if call is not None:
            self.calls[str(call)] = when
        return when, "sent"

    def idle(self, now: int, last_used: int, floor: int = 300_000_000) -> bool:
        """Whether the state may be dropped (T7): unused for longer than the period and the floor, and no hold left; a new one would act alike."""
        return now - last_used > max(floor, self.period) and now > self.hold

    def dump(self) -> str:
        return json.dumps([self.sent, self.hold, self.calls])

    def load(self, text: str) -> None:
        self.sent, self.hold, self.calls = json.loads(text)


class Spaced:
    """A least delay between sends, from the last booking (T3); or from the last completion, which is send plus `took` (T2, without its jitter)."""

    fields = (("sent", T.LongType()), ("wait", T.LongType()))

    def __init__(self, delay: int, from_completion: bool = False) -> None:
        self.delay, self.from_completion, self.last = delay, from_completion, None

    def step(self, at: int, took: int = 0) -> tuple:
        when = at if self.last is None else max(at, self.last + self.delay)
        self.last = when + (took if self.from_completion else 0)
        return when, when - at

    def dump(self) -> str:
        return json.dumps(self.last)

    def load(self, text: str) -> None:
        self.last = json.loads(text)


class TtlCache:
    """Fixed time to live from the store (T11): a hit iff now < expiry, or at equality too if `closed` (T16). bypass reads nothing and stores afresh."""

    fields = (("outcome", T.StringType()), ("stored", T.LongType()))

    def __init__(self, ttl: int, closed: bool = False) -> None:
        self.ttl, self.closed, self.stored = ttl, closed, None

    def step(self, at: int, bypass: bool = False) -> tuple:
        age = None if self.stored is None else at - self.stored
        if bypass:
            self.stored = at
            return "bypass", at
        if age is not None and (age < self.ttl or self.closed and age == self.ttl):
            return "hit", self.stored
        self.stored = at
        return "miss", at

    def dump(self) -> str:
        return json.dumps(self.stored)

    def load(self, text: str) -> None:
        self.stored = json.loads(text)


class Holds:
    """A method's hold after a failure (T15): its cooldown or a longer Retry-After, never shorter than one that runs.

    An upstream fault is no verdict on the method: it holds it only if another method is left to try. A success clears
    a hold that had ended when it started.
    """

    fields = (("allowed", T.BooleanType()), ("held_until", T.LongType()))

    def __init__(self, cooldown: int) -> None:
        self.cooldown, self.until = cooldown, 0

    def step(self, at: int, failed: bool = False, retry_after: int = 0, upstream: bool = False, last: bool = False) -> tuple:
        allowed = at >= self.until
        if failed and not (upstream and last):
            self.until = max(self.until, at + max(self.cooldown, retry_after))
        elif not failed and allowed:
            self.until = 0
        return allowed, self.until

    def dump(self) -> str:
        return json.dumps(self.until)

    def load(self, text: str) -> None:
        self.until = json.loads(text)


class Budget:
    """A running budget that skips what doesn't fit and goes on."""

    fields = (("kept", T.BooleanType()), ("used", T.LongType()))

    def __init__(self, most: int) -> None:
        self.most, self.used = most, 0

    def step(self, size: int) -> tuple:
        fits = self.used + size <= self.most
        self.used += size if fits else 0
        return fits, self.used

    def dump(self) -> str:
        return json.dumps(self.used)

    def load(self, text: str) -> None:
        self.used = json.loads(text)


class LruBytes:
    """Least recently used entries go when the bytes exceed the limit (T12): an entry's own, its key's and `overhead`. One order over all keys.

    A lookup of a live entry is a hit. Anything else stores the entry afresh, in place of an older one under its key;
    an entry larger than the limit is not stored. Entries live for `ttl` (None: for ever); refresh stores without a lookup.
    """

    fields = (("outcome", T.StringType()), ("bytes", T.LongType()), ("evicted", T.LongType()))

    def __init__(self, most: int, overhead: int = 256, ttl: int | None = None) -> None:
        self.most, self.overhead, self.ttl, self.entries, self.bytes = most, overhead, ttl, OrderedDict(), 0

    def _drop(self, key: Any) -> None:
        self.bytes -= self.entries.pop(key)[0]

    def dump(self) -> str:
        return json.dumps([[k, *e] for k, e in self.entries.items()])

    def load(self, text: str) -> None:
        self.entries = OrderedDict((k, (size, expiry)) for k, size, expiry in json.loads(text))
        self.bytes = sum(size for size, _ in self.entries.values())

    def step(self, key: Any, size: int, at: int = 0, refresh: bool = False) -> tuple:
        if key in self.entries and not refresh:
            if self.ttl is None or at < self.entries[key][1]:
                self.entries.move_to_end(key)
                return "hit", self.bytes, 0
            self._drop(key)
        size += self.overhead + len(str(key).encode())
        if size > self.most:
            return "too_large", self.bytes, 0
        if key in self.entries:
            self._drop(key)
        self.entries[key] = size, at + (self.ttl or 0)
        self.bytes += size
        gone = 0
        while self.bytes > self.most:
            self._drop(next(iter(self.entries)))
            gone += 1
        return "refresh" if refresh else "miss", self.bytes, gone


class SingleFlight:
    """Calls for a key while one is under way share its result (T13); a follower of a cancelled leader leads anew."""

    fields = (("role", T.StringType()), ("leader", T.LongType()))

    def __init__(self) -> None:
        self.until, self.leader, self.cancelled = None, None, False

    def step(self, at: int, end: int, call: int, cancelled: bool = False) -> tuple:
        if self.until is not None and at < self.until and not self.cancelled:
            return "follower", self.leader
        self.until, self.leader, self.cancelled = end, call, cancelled
        return "leader", call

    def dump(self) -> str:
        return json.dumps([self.until, self.leader, self.cancelled])

    def load(self, text: str) -> None:
        self.until, self.leader, self.cancelled = json.loads(text)


#: Events of a range, where one machine reads all events.
RANGE = 250_000


def _folded(dealt: DataFrame, key: str, make: Callable[[], Any], args: list[str], starts: dict[Any, str]) -> DataFrame:
    """The rows, sorted by key within their partitions, with what each key's machine says; starts: states that machines begin with."""
    machine = make()
    schema = T.StructType(list(dealt.schema.fields))
    for name, kind in machine.fields:
        schema = schema.add(name, kind)
    names = dealt.columns
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            keys = batch.column(key).to_pylist()
            said = []
            for k, *values in zip(keys, *(batch.column(a).to_pylist() for a in args), strict=True):
                if state is None or k != now:
                    now, state = k, make()
                    if k in starts:
                        state.load(starts[k])
                said.append(state.step(*values))
            more = [pa.array([s[i] for s in said], arrow.field(len(names) + i).type) for i in range(len(machine.fields))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=pa.schema([*batch.schema, *list(arrow)[len(names) :]]))

    return dealt.mapInArrow(run, schema)


def _ends(dealt: DataFrame, key: str, make: Callable[[], Any], args: list[str], starts: dict[Any, str]) -> dict[Any, str]:
    """The state that each key's machine ends in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple[Any, str]] = []
        for batch in batches:
            for k, *values in zip(batch.column(key).to_pylist(), *(batch.column(a).to_pylist() for a in args), strict=True):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, state.dump()))
                    now, state = k, make()
                    if k in starts:
                        state.load(starts[k])
                state.step(*values)
        if state is not None:
            done.append((now, state.dump()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int32()), pa.array([x for _, x in done], pa.string())], names=["part", "state"])

    return {r["part"]: r["state"] for r in dealt.mapInArrow(run, "part int, state string").collect()}


def fold(rows: DataFrame, key: str | None, order: list[str], make: Callable[[], Any], args: list[str]) -> DataFrame:
    """The rows with what a machine says of each, a machine for each key (None: one for all), events in the order given."""
    if key is None:
        return fold_all(rows, order, make, args)
    return _folded(rows.repartition(key).sortWithinPartitions(key, *order), key, make, args, {})


def fold_all(rows: DataFrame, order: list[str], make: Callable[[], Any], args: list[str]) -> DataFrame:
    """The rows with what one machine says of each, all events in one order, without all of them in one task.

    The events are dealt to ranges of the order and stored. Every range is folded from a guess of the machine's state, at first that of
    a new one and then what the range before ended in, until each range began with what the one before ended in: the
    rows are those of one pass. A machine whose state forgets (a cache of some size) takes a few rounds. One that never does takes as
    many as there are ranges, each over the ranges that are left. States have to be small: the driver holds one for each range.
    """
    n = max(1, -(-rows.count() // RANGE))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    own = list(dict.fromkeys(["__range", *order, *args]))
    sort = lambda df: df.repartition(n, "__range").sortWithinPartitions("__range", *order)
    starts = dict.fromkeys(range(n), make().dump())
    ends: dict[int, str] = {}
    left = list(range(n - 1))  # nothing asks for the last one's end
    while left:
        ends |= _ends(sort(dealt.select(*own).where(F.col("__range").isin(left))), "__range", make, args, starts)
        left = []
        for i in range(1, n):
            # a range without rows ends as it began
            before = ends.get(i - 1, starts[i - 1])
            if starts[i] != before:
                starts[i] = before
                left += [i] if i < n - 1 else []
    return _folded(sort(dealt), "__range", make, args, starts).drop("__range")


def fold_stream(rows: DataFrame, key: str, order: str, make: Callable[[], Any], args: list[str], idle_ms: int | None = None) -> DataFrame:
    """The same over a stream: a machine's state is kept for each key; events of a micro-batch are taken in order.

    idle_ms: a key's state goes when no event has come for that long (T7), so keys that are gone cost nothing. It has to be longer than
    the period, the delay and any hold; then a new machine acts as the dropped one would have. None: state is kept for ever.
    Needs the RocksDB state store. Late events are folded when they arrive.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    machine = make()
    schema = T.StructType(list(rows.schema.fields))
    for name, kind in machine.fields:
        schema = schema.add(name, kind)

    class Keep(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("machine", T.StructType().add("text", "string"), idle_ms)

        def handleInputRows(self, k, frames, timers):
            state = make()
            if self.state.exists():
                state.load(self.state.get()[0])
            rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
            said = [state.step(*values) for values in zip(*(rows[a].tolist() for a in args), strict=True)]
            self.state.update((state.dump(),))
            for i, (name, _) in enumerate(machine.fields):
                rows[name] = pd.Series([s[i] for s in said], index=rows.index, dtype=object)
            yield rows

        def close(self) -> None:
            pass

    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Keep(), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None")


def retry_schedule(attempts: DataFrame, base_ms: int = 500, cap_ms: int = 4000, most: int = 3) -> DataFrame:
    """Wait before each retry and whether it is made (T10), jitter left out. attempts: call_id, attempt (from 1), status, retry_after_ms, vetoed."""
    wait = F.least(F.lit(cap_ms), (F.lit(base_ms) * F.pow(F.lit(2.0), F.col("attempt") - 1)).cast("long"))
    transient = (F.col("status") == 429) | (F.col("status") >= 500)
    again = transient & (F.col("attempt") < most) & ~F.coalesce("vetoed", F.lit(False))
    return attempts.withColumn("again", again).withColumn("wait_ms", F.when(again, F.greatest(wait, F.coalesce("retry_after_ms", F.lit(0)).cast("long"))))
