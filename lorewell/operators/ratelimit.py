"""Fixed windows that start at a key's first request, exact at any key size.

A window runs for ``window_ms`` from the request that opened it; the first
request after its end opens the next. That is sequential per key, so a hot key
is cut into time slices instead of being gathered:

1. requests are counted per (key, millisecond), which bounds every slice by its
   length in milliseconds whatever the traffic;
2. each slice is summarised independently as a step function: window end carried
   in -> window end carried out;
3. step functions compose, and the composition of a run of slices is no larger than
   the function of its first slice. ``FAN`` neighbouring slices of a key become one, the
   results again, until a key has one run left; what every slice inherits then comes
   down the same tree. No task sees more than ``FAN`` rows of a key;
4. each slice, now knowing what it inherits, lists its windows independently.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_MS = 600_000
FAN = 1024
_ANY_END = 2 ** 62
_NOTHING_CARRIED = -(2 ** 62)


def _following(times: np.ndarray, window: int) -> np.ndarray:
    """For each request, the index of the first request after a window opened by it."""
    return np.searchsorted(times, times + window, side="left")


def _steps(times: np.ndarray, window: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """``(upto, leave)``: a window end carried in up to ``upto[i]`` leaves the slice as ``leave[i]``."""
    leave = times + window
    if len(times) == 1:
        return times, leave
    following = _following(times, window)
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            leave[i] = leave[following[i]]
    # a carried end lies at most one window into the slice
    reach = int(np.searchsorted(times, start + window, side="left")) + 1
    upto, leave = times[:reach], leave[:reach]
    changes = np.append(leave[1:] != leave[:-1], True)
    return upto[changes], leave[changes]


def _apply(upto: np.ndarray, leave: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """Window ends carried out for those carried in; an end beyond the function's reach stays as it is."""
    at = np.searchsorted(upto, carried, side="left")
    return np.where(at < len(upto), leave[np.minimum(at, len(upto) - 1)], carried)


def _then(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two runs of slices, the second later than the first."""
    upto, leave = first
    leave = _apply(*second, leave)
    if upto[-1] != _ANY_END:
        # an end that the first run leaves alone lies before the second one
        upto, leave = np.append(upto, _ANY_END), np.append(leave, second[1][0])
    changes = np.append(leave[1:] != leave[:-1], True)
    return upto[changes], leave[changes]


def _windows(times: np.ndarray, counts: np.ndarray, window: int, carried: int):
    """``(start, requests)`` of the part of every window inside this slice."""
    if len(times) == 1:
        yield (carried - window if times[0] < carried else int(times[0])), int(counts[0])
        return
    total = np.concatenate([[0], np.cumsum(counts)])
    following = _following(times, window)
    at = int(np.searchsorted(times, carried, side="left"))
    if at:  # these belong to the window carried in
        yield carried - window, int(total[at])
    while at < len(times):
        yield int(times[at]), int(total[following[at]] - total[at])
        at = int(following[at])


def _runs(batches, n_keys: int):
    """Consecutive rows with equal leading columns, as ``(key, numpy columns)``; a run may span batches."""
    key, held = None, []
    for batch in batches:
        heads = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        tails = [c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys:]]
        start = 0
        for stop in range(1, len(heads) + 1):
            if stop < len(heads) and heads[stop] == heads[start]:
                continue
            if held and heads[start] != key:
                yield key, [np.concatenate(c) for c in zip(*held)]
                held = []
            key = heads[start]
            held.append([t[start:stop] for t in tails])
            start = stop
    if held:
        yield key, [np.concatenate(c) for c in zip(*held)]


def _emit(rows, schema: pa.Schema, size: int = 8192):
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _composed(batches, schema: pa.Schema):
    """One row per (key, block): the composition of its runs, which come in time order."""
    def fold():
        current, whole = None, None
        for batch in batches:
            for key, block, upto, leave in zip(*(c.to_pylist() for c in batch.columns)):
                step = np.array(upto, np.int64), np.array(leave, np.int64)
                if (key, block) == current:
                    whole = _then(whole, step)
                    continue
                if current is not None:
                    yield (*current, whole[0].tolist(), whole[1].tolist())
                current, whole = (key, block), step
        if current is not None:
            yield (*current, whole[0].tolist(), whole[1].tolist())

    yield from _emit(fold(), schema)


def _inherited(batches, schema: pa.Schema):
    """What every run of a block inherits, from what the block does."""
    def walk():
        current, carried = None, None
        for batch in batches:
            for key, block, number, upto, leave, inherited in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, block) != current:
                    current, carried = (key, block), inherited
                yield key, number, carried
                at = int(np.searchsorted(upto, carried, side="left"))
                if at < len(upto):
                    carried = leave[at]

    yield from _emit(walk(), schema)


def _carries(slices: DataFrame, arrow_kind: pa.DataType, span: int, fan: int) -> DataFrame:
    """``(key, run, carried)`` for ``slices(key, run, upto, leave)`` whose run numbers lie in ``0 .. span - 1``."""
    kind = slices.schema["key"].dataType.simpleString()
    steps = pa.schema([("key", arrow_kind), ("run", pa.int64()), ("upto", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64()))])
    ends = pa.schema([("key", arrow_kind), ("run", pa.int64()), ("carried", pa.int64())])
    block = F.floor(F.col("run") / fan).cast("long").alias("block")
    levels = [slices]
    while span > fan:
        span = -(-span // fan)
        levels.append(
            levels[-1].select("key", block, "run", "upto", "leave").repartition("key", "block").sortWithinPartitions("key", "block", "run")
            .select("key", "block", "upto", "leave")
            .mapInArrow(lambda batches: _composed(batches, steps), f"key {kind}, run long, upto array<long>, leave array<long>"))
    carries = None
    for level in reversed(levels):
        rows = level.select("key", block, "run", "upto", "leave")
        if carries is None:  # the top: one block a key, which inherits nothing
            rows = rows.withColumn("carried", F.lit(_NOTHING_CARRIED))
        else:
            rows = rows.join(carries.withColumnRenamed("run", "block"), ["key", "block"])
        carries = rows.repartition("key", "block").sortWithinPartitions("key", "block", "run").mapInArrow(
            lambda batches: _inherited(batches, ends), f"key {kind}, run long, carried long")
    return carries


def anchored_windows(
    requests: DataFrame, key: str, ts: Column | str, limit: int, window_ms: int = 60_000, slice_ms: int = SLICE_MS, fan: int = FAN
) -> DataFrame:
    """``(key, window_start_ms, n_requests, breach)`` for every window; a request without a time belongs to none."""
    if slice_ms < window_ms:
        raise ValueError("a slice must be at least as long as a window")
    if fan < 2:
        raise ValueError("at least two runs must become one")
    stamp = F.col(ts) if isinstance(ts, str) else ts
    kind = requests.schema[key].dataType
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    slice_key = [T.StructField("key", kind), T.StructField("slice", T.LongType())]
    number = F.floor(F.col("ms") / slice_ms).cast("long")
    timed = requests.select(F.col(key).alias("key"), F.unix_millis(stamp.cast("timestamp")).alias("ms")).where("ms IS NOT NULL")
    # the height of the tree depends on the time that the log covers, two numbers of one column
    first, last = timed.agg(F.min(number), F.max(number)).first()
    first, span = first or 0, (last or 0) - (first or 0) + 1
    counted = timed.groupBy("key", "ms").agg(F.count("*").alias("n")).select("key", number.alias("slice"), "ms", "n")

    def summarise(batches):
        schema = pa.schema([("key", arrow_kind), ("slice", pa.int64()), ("upto", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64()))])
        found = (
            (*k, upto.tolist(), leave.tolist())
            for k, (ms,) in _runs(batches, 2) for upto, leave in [_steps(ms, window_ms, k[1] * slice_ms)]
        )
        yield from _emit(found, schema)

    def list_windows(batches):
        schema = pa.schema([("key", arrow_kind), ("start", pa.int64()), ("n", pa.int64())])
        found = (
            (k[0], start, n)
            for k, (ms, counts, carried) in _runs(batches, 2)
            for start, n in _windows(ms, counts, window_ms, int(carried[0]))
        )
        yield from _emit(found, schema)

    longs = T.ArrayType(T.LongType())
    slices = (
        counted.repartition("key", "slice").sortWithinPartitions("key", "slice", "ms").select("key", "slice", "ms")
        .mapInArrow(summarise, T.StructType([*slice_key, T.StructField("upto", longs), T.StructField("leave", longs)]))
    )
    runs = slices.select("key", (F.col("slice") - first).alias("run"), "upto", "leave")
    carries = _carries(runs, arrow_kind, span, fan).select("key", (F.col("run") + first).alias("slice"), "carried")
    pieces = (
        counted.join(carries, ["key", "slice"]).repartition("key", "slice").sortWithinPartitions("key", "slice", "ms")
        .select("key", "slice", "ms", "n", "carried")
        .mapInArrow(list_windows, T.StructType([slice_key[0], T.StructField("start", T.LongType()), T.StructField("n", T.LongType())]))
    )
    # a window reaching into the next slice comes in two pieces
    return pieces.groupBy("key", "start").agg(F.sum("n").alias("n_requests")).select(
        F.col("key").alias(key), F.col("start").alias("window_start_ms"), "n_requests",
        (F.col("n_requests") > limit).alias("breach"),
    )
