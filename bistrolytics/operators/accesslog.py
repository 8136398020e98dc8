"""Over-limit requests in an access log, by one token bucket per caller and path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import fixed
from ..functions.checks import check_columns, check_range
from ..functions.sizing import cut_lineage

# Capacity and refill per second by path class; None is every other path.
DEFAULT_LIMITS = {
    None: (fixed.LIMIT_CAPACITY, fixed.LIMIT_REFILL),
    "chat": (fixed.CHAT_LIMIT_CAPACITY, fixed.CHAT_LIMIT_REFILL),
}


# Requests of one busy run that one task decides; longer runs are cut into chunks of about this size.
CHUNK_ROWS = 200_000
_NANOS = 1_000_000_000


def serve(owed: int, now: int, gap: int, slack: int) -> tuple[int, bool]:
    """One request against a bucket, all in nanoseconds.

    ``owed`` is the time at which the bucket is full again, ``gap`` the time one
    token takes and ``slack`` the time of all tokens but one. The bucket holds a
    token as long as it is full again within ``slack``. Whole numbers keep the
    result free of rounding, however the requests are cut up.
    """
    if owed <= now:
        return now + gap, True
    return (owed + gap, True) if owed - now <= slack else (owed, False)


class Course:
    """What a stretch of requests makes of every possible ``owed`` at its start.

    The map is piecewise: from ``low`` to ``high`` the outcome is either fixed or
    the start plus a shift. Pieces split where a decision differs and merge when
    their outcomes agree again.
    """

    def __init__(self, first: int, gap: int, slack: int, most: int = 0):
        """``most`` is a start that may lie beyond what requests in order of time can cause."""
        self.gap, self.slack = gap, slack
        self.low = np.array([first], dtype=np.int64)
        self.high = np.array([max(first + slack + gap, most)], dtype=np.int64)
        self.fixed = np.array([False])
        self.value = np.zeros(1, dtype=np.int64)

    def _split(self, edge: int) -> None:
        """Cut pieces whose outcomes lie on both sides of ``edge``."""
        border = edge - self.value
        cut = (self.low <= border) & (border < self.high) & ~self.fixed
        at = np.flatnonzero(cut)
        if len(at):
            twice = np.repeat(np.arange(len(cut)), 1 + cut)
            border, right = border[at], at + np.arange(1, len(at) + 1)
            self.low, self.high = self.low[twice], self.high[twice]
            self.fixed, self.value = self.fixed[twice], self.value[twice]
            self.high[right - 1] = border
            self.low[right] = border + 1

    def serve(self, now: int) -> None:
        self._split(now)
        self._split(now + self.slack)
        stop = np.where(self.fixed, self.value, self.high + self.value)
        full = stop <= now
        self.value += self.gap * (stop <= now + self.slack)
        if full.any():
            self.fixed |= full
            self.value[full] = now + self.gap
        if len(stop) > 1:
            differs = (self.value[1:] != self.value[:-1]) | (self.fixed[1:] != self.fixed[:-1])
            if not differs.all():
                keep = np.flatnonzero(np.concatenate(([True], differs)))
                last = np.concatenate((keep[1:] - 1, [len(stop) - 1]))
                self.low, self.high = self.low[keep], self.high[last]
                self.fixed, self.value = self.fixed[keep], self.value[keep]

    @staticmethod
    def end(low, fixed, value, owed: int) -> int:
        """The outcome for one start; a start before the first request counts as its time."""
        owed = max(int(owed), int(low[0]))
        at = int(np.searchsorted(low, owed, side="right")) - 1
        return int(value[at]) if fixed[at] else owed + int(value[at])


def with_limits(log: DataFrame, limits: dict) -> DataFrame:
    """``log`` with the time, the token gap and the slack of its path's limit, in nanoseconds."""
    gap = slack = None
    for path, (capacity, rate) in sorted(limits.items(), key=lambda item: item[0] is not None):
        check_range("capacity", capacity, 1, 10**9)
        check_range("refill_per_second", rate, 1e-9, 10**9)
        check_range("capacity / refill_per_second", capacity / rate, 1e-9, 10**9)
        one = max(1, round(_NANOS / rate))
        g, s = F.lit(one).cast("long"), F.lit((int(capacity) - 1) * one).cast("long")
        if path is None:
            gap, slack = g, s
        else:
            gap, slack = F.when(F.col("path") == path, g).otherwise(gap), F.when(F.col("path") == path, s).otherwise(slack)
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return log.withColumns(
        {
            "_at": at, "_gap": gap, "_slack": slack,
            "_caller": F.coalesce(F.col("caller").cast("string"), F.lit("unknown")),
            "_path": F.coalesce(F.col("path").cast("string"), F.lit("")),
        }
    )


#: A missing caller counts as "unknown" and a missing path as the empty one.
_KEY = ["_caller", "_path"]


def _stretches(timed: DataFrame, owed: DataFrame | None) -> DataFrame:
    """(key, _stretch, _run, _rows, _before, _run_rows, _first): the busy stretches of every caller and path.

    Counted before any window, so a window sees one row per stretch, not per request. ``_first`` is
    what a bucket owes at the start of its run: the key's entry of ``owed`` in the first run, which
    lasts at least until that is paid, and 0 later.
    """
    in_time = Window.partitionBy(*_KEY).orderBy("_stretch")
    apart = F.col("_stretch") - F.lag("_stretch").over(in_time) > 1
    paid = F.col("_stretch") * F.col("_whole") >= F.col("_debt")
    opens = F.when(apart.isNull(), F.lit(True)).otherwise(apart & paid)
    run = Window.partitionBy(*_KEY, "_run")
    counted = timed.groupBy(*_KEY, "_stretch").agg(
        F.count(F.lit(1)).alias("_rows"), F.first(F.col("_slack") + F.col("_gap")).alias("_whole")
    )
    if owed is None:
        counted = counted.withColumn("_debt", F.lit(0).cast("long"))
    else:
        counted = counted.join(owed.select(*_KEY, F.col("owed").alias("_debt")), _KEY, "left").fillna(0, ["_debt"])
    return (
        counted
        .withColumn("_opens", opens.cast("int"))
        .withColumn("_run", F.sum("_opens").over(in_time))
        .withColumn("_before", F.sum("_rows").over(run.orderBy("_stretch")) - F.col("_rows"))
        .withColumn("_run_rows", F.sum("_rows").over(run))
        .withColumn("_first", F.when(F.col("_run") == 1, F.col("_debt")).otherwise(F.lit(0).cast("long")))
        .drop("_opens", "_whole", "_debt")
    )


def _in_order(df: DataFrame, *unit: str) -> DataFrame:
    return df.repartition(*_KEY, *unit).sortWithinPartitions(*_KEY, *unit, "_at", "request_id")


def _openings(batches, *unit: str):
    """Sorted batches, each with a flag per row that opens a new unit."""
    last = None
    for batch in batches:
        if len(batch):
            opens = np.zeros(len(batch), dtype=bool)
            names = [batch[c].to_numpy() for c in (*_KEY, *unit)]
            for column in names:
                opens[1:] |= column[1:] != column[:-1]
            opens[0] = last != tuple(column[0] for column in names)
            last = tuple(column[-1] for column in names)
            yield batch, opens.tolist()


def _decide(ordered: DataFrame, columns: list[str], fields: list, *unit: str) -> DataFrame:
    """Serve each unit's requests in order, from the unit's ``_owed``; ``_after`` is what the bucket then owes."""
    schema = T.StructType([*fields, T.StructField("allowed", T.BooleanType()), T.StructField("_after", T.LongType())])

    def replay(batches):
        owed = 0
        for batch, opens in _openings(batches, *unit):
            flags, after = [], []
            for new, start, now, gap, slack in zip(
                opens, *[batch[c].tolist() for c in ("_owed", "_at", "_gap", "_slack")]
            ):
                owed, allowed = serve(start if new else owed, now, gap, slack)
                flags.append(allowed)
                after.append(owed)
            yield batch[columns].assign(allowed=flags, _after=after)

    return ordered.mapInPandas(replay, schema)


def _chunk_starts(chunked: DataFrame) -> DataFrame:
    """(key, _run, _chunk, _owed): the bucket at the start of every chunk of the long runs.

    Chunks are summed up independently; only their summaries, a few pieces per
    chunk, are gone through in order.
    """
    head = "_caller string, _path string, _run long, _chunk long"
    courses = _in_order(chunked.select(*_KEY, "_run", "_chunk", "_at", "_gap", "_slack", "_first", "request_id"), "_run", "_chunk")

    def summarise(batches):
        name, course, debt = None, None, 0
        row = lambda: pd.DataFrame(
            [(*name, debt, course.low.tolist(), course.fixed.tolist(), course.value.tolist())],
            columns=[*_KEY, "_run", "_chunk", "_first", "low", "fixed", "value"],
        )
        for batch, opens in _openings(batches, "_run", "_chunk"):
            for at, (new, now) in enumerate(zip(opens, batch["_at"].tolist())):
                if new:
                    if course is not None:
                        yield row()
                    first = batch.iloc[at]
                    name = tuple(first[c] for c in (*_KEY, "_run", "_chunk"))
                    debt = int(first["_first"])
                    course = Course(now, int(first["_gap"]), int(first["_slack"]), debt)
                course.serve(now)
        if course is not None:
            yield row()

    def chain(batches):
        owed = 0
        for batch, opens in _openings(batches, "_run"):
            starts = []
            for new, first, low, fixed_, value in zip(opens, *[batch[c] for c in ("_first", "low", "fixed", "value")]):
                owed = first if new else owed
                starts.append(owed)
                owed = Course.end(low, fixed_, value, owed)
            yield batch[[*_KEY, "_run", "_chunk"]].assign(_owed=starts)

    pieces_ = f"{head}, _first long, low array<bigint>, fixed array<boolean>, value array<bigint>"
    summed = courses.mapInPandas(summarise, pieces_)
    in_turn = summed.repartition(*_KEY, "_run").sortWithinPartitions(*_KEY, "_run", "_chunk")
    return in_turn.mapInPandas(chain, f"{head}, _owed long")


def token_bucket(log: DataFrame, limits: dict | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``log`` with ``allowed``. ``log(request_id, caller, path, ts)``; equal times go by request_id.

    A pause of capacity / refill seconds fills a bucket whatever came before.
    Time is cut into stretches of that length; busy stretches in a row form a
    run, and runs, not callers, are what is spread over tasks. A run longer than
    ``chunk_rows`` is cut into chunks by time: each chunk's effect on any bucket
    is worked out in parallel, the effects are chained, and the chunks are then
    decided in parallel. No task holds a run in memory. A request without a time is
    not decided (``allowed`` is null).
    """
    check_columns(log, "request_id", "caller", "path", "ts")
    check_range("chunk_rows", chunk_rows, 1, 10**9)
    return _decided(log, limits, chunk_rows, None).select(*log.columns, "allowed")


def token_bucket_from(
    log: DataFrame, owed: DataFrame | None, limits: dict | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """As ``token_bucket``, going on from owed(_caller, _path, owed), for logs that arrive in parts.

    Also gives ``_caller``, ``_path``, ``_at`` and ``_after``, the bucket after each request, from which
    ``owed_after`` makes the state for the next part.
    """
    check_columns(log, "request_id", "caller", "path", "ts")
    keyed = with_limits(log, limits or DEFAULT_LIMITS).select(*log.columns, *_KEY, "_at")
    return _decided(keyed, limits, chunk_rows, owed)


def owed_after(decided: DataFrame) -> DataFrame:
    """(_caller, _path, owed): every bucket that served a request, after its last one."""
    last = F.max_by("_after", F.struct("_at", "request_id"))
    return decided.where(F.col("_after").isNotNull()).groupBy(*_KEY).agg(last.alias("owed"))


def _decided(log: DataFrame, limits: dict | None, chunk_rows: int, owed: DataFrame | None) -> DataFrame:
    """The columns of ``log`` with ``allowed`` and ``_after``."""
    columns, fields = log.columns, log.schema.fields
    whole = F.col("_slack") + F.col("_gap")
    everything = with_limits(log, limits or DEFAULT_LIMITS)
    timed = everything.where(F.col("_at").isNotNull()).withColumn("_stretch", F.floor(F.col("_at") / whole))
    undated = everything.where(F.col("_at").isNull()).select(
        *columns, F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("long").alias("_after")
    )
    runs = cut_lineage(_stretches(timed, owed))
    placed = timed.join(runs, [*_KEY, "_stretch"])
    short = placed.where(F.col("_run_rows") <= chunk_rows).withColumn("_owed", F.col("_first"))
    decided = _decide(_in_order(short, "_run"), columns, fields, "_run").unionByName(undated)
    if runs.where(F.col("_run_rows") > chunk_rows).isEmpty():
        return decided
    within = F.floor((F.col("_at") - F.col("_stretch") * whole) / whole * F.col("_rows"))
    chunked = placed.where(F.col("_run_rows") > chunk_rows).withColumn(
        "_chunk", F.floor((F.col("_before") + within) / chunk_rows)
    )
    starts = cut_lineage(_chunk_starts(chunked))
    ready = chunked.join(starts, [*_KEY, "_run", "_chunk"])
    return decided.unionByName(_decide(_in_order(ready, "_run", "_chunk"), columns, fields, "_run", "_chunk"))
