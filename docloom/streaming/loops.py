"""Repeated tool calls: batch windows and a stateful stream; round guards; telemetry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

WINDOW, WARN, STOP = 20, 3, 5
TOOL_WARN, TOOL_STOP = 30, 50
OUT = "thread_id string, seq long, same long, tool_calls long, action string"


def call_hash(calls: Column) -> Column:
    """First 12 digits of the md5 of a turn's calls (name, args), in any order."""
    keys = F.array_sort(F.transform(calls, lambda c: F.concat_ws(":", c["name"], c["args"])))
    return F.substring(F.md5(F.array_join(keys, "\n")), 1, 12)


SALIENT = ("cmd", "command", "glob", "path", "pattern", "query", "url")
WHOLE = ("write_file", "str_replace")
LINES = 200


def _json_text(value: Column) -> Column:
    return F.substring(F.to_json(F.struct(value.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6)


def _json_object(entries: Column) -> Column:
    """Entries of a map by name as a JSON object, a blank behind each comma and colon."""
    pairs = F.transform(F.array_sort(entries), lambda e: F.concat(_json_text(e["key"]), F.lit(": "), F.when(e["value"].isNull(), "null").otherwise(_json_text(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def stable_key(name: Column, args: Column) -> Column:
    """What makes two calls of a tool the same: ``args`` is a map of strings.

    Reading a file counts by blocks of 200 lines, writing by all arguments; other tools by the
    arguments that say what is asked for, or by all if there is none.  Byte-exact for ASCII.
    """
    number = lambda c: F.expr(f"try_cast({c} as int)") if isinstance(c, str) else c.try_cast("int")
    start = F.coalesce(number(F.element_at(args, "start_line")), F.lit(1))
    end = F.coalesce(number(F.element_at(args, "end_line")), start)
    block = lambda c: F.floor((F.greatest(c, F.lit(1)) - 1) / LINES).cast("string")
    lines = F.concat(F.coalesce(F.element_at(args, "path"), F.lit("")), F.lit(":"), block(F.least(start, end)), F.lit("-"), block(F.greatest(start, end)))
    entries = F.map_entries(args)
    some = F.filter(entries, lambda e: e["key"].isin(*SALIENT) & e["value"].isNotNull())
    return F.when(name == "read_file", lines).when(name.isin(*WHOLE) | (F.size(some) == 0), _json_object(entries)).otherwise(_json_object(some))


def stable_hash(calls: Column) -> Column:
    """First 12 digits of the md5 of a turn's calls (name, args map), in any order."""
    keys = F.array_sort(F.transform(calls, lambda c: F.concat(c["name"], F.lit(":"), stable_key(c["name"], c["args"]))))
    return F.substring(F.md5(F.concat(F.lit("["), F.array_join(F.transform(keys, _json_text), ", "), F.lit("]"))), 1, 12)


def repeated(calls: DataFrame) -> DataFrame:
    """Rows (thread_id, seq, hash) with ``same`` and ``action`` over each thread's last 20 calls.

    ``stop`` at five equal calls in the window; ``warn`` at three when the hash did not stand
    at three or more one call of it before, within the window.
    """
    order = Window.partitionBy("thread_id").orderBy("seq")
    same = F.size(F.filter(F.collect_list("hash").over(order.rowsBetween(1 - WINDOW, 0)), lambda h: h == F.col("hash"))).cast("long")
    out = calls.withColumn("same", same)
    before = F.lag("same").over(Window.partitionBy("thread_id", "hash").orderBy("seq"))
    warned = F.coalesce(before >= WARN, F.lit(False))
    return out.withColumn("action", F.when(F.col("same") >= STOP, "stop").when((F.col("same") >= WARN) & ~warned, "warn"))


def round_guard(rounds: DataFrame) -> DataFrame:
    """Rows (thread_id, round, signature, failed) with the reason to stop there, or null."""
    order = Window.partitionBy("thread_id").orderBy("round")
    again = F.col("signature") == F.lag("signature").over(order)
    streak = F.sum(F.col("failed").cast("int")).over(order.rowsBetween(-2, 0))
    return rounds.withColumn("reason", F.when(again, "identical").when(streak >= 3, "errors").when(F.col("round") >= 10, "rounds"))


STATE = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("hashes", "tools", "warned", "warned_tools")])


def judged(state: tuple, hash_: str, tool: str) -> tuple[tuple, int, int, str | None]:
    """(state, equal calls in the window, calls of the tool, action) after one more call of a thread."""
    hashes, tools, warned, warned_tools = (list(x) for x in state)
    hashes = (hashes + [hash_])[-WINDOW:]
    warned = [h for h in warned if h in hashes]
    same, action = hashes.count(hash_), None
    if same >= STOP:
        action = "stop"
    elif same >= WARN and hash_ not in warned:
        warned.append(hash_)
        action = "warn"
    tools = (tools + [tool])[-max(TOOL_STOP, WINDOW):]
    used = tools.count(tool)
    if action is None and used >= TOOL_STOP:
        action = "stop"
    elif action is None and used >= TOOL_WARN and tool not in warned_tools:
        warned_tools.append(tool)
        action = "warn"
    return (hashes, tools, warned, [t for t in warned_tools if tools.count(t) >= TOOL_WARN]), same, used, action


class LoopDetector(StatefulProcessor):
    """Per thread: the last hashes and tool names; with ``ttl_ms`` a silent thread is forgotten."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("thread", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else ([], [], [], [])
        out = []
        for r in pd.concat(rows).sort_values("seq").itertuples():
            state, same, used, action = judged(state, r.hash, r.tool)
            out.append((key[0], r.seq, same, used, action))
        self.state.update(state)
        yield pd.DataFrame(out, columns=["thread_id", "seq", "same", "tool_calls", "action"])

    def close(self) -> None:
        pass


class RecentThreads(StatefulProcessor):
    """Per shard: the ``most`` threads with the latest calls, in that order; the oldest is forgotten."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = T.StructType([T.StructField("thread", T.StringType()), *STATE.fields])
        self.state = handle.getValueState("threads", T.StructType([T.StructField("threads", T.ArrayType(one))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        threads = {t[0]: tuple(t[1:]) for t in self.state.get()[0]} if self.state.exists() else {}
        out = []
        for r in pd.concat(rows).sort_values("seq").itertuples():
            name = str(r.thread_id)
            state, same, used, action = judged(threads.pop(name, ([], [], [], [])), r.hash, r.tool)
            threads[name] = state  # behind all others
            if len(threads) > self.most:
                threads.pop(next(iter(threads)))
            out.append((r.thread_id, r.seq, same, used, action))
        self.state.update(([(name, *state) for name, state in threads.items()],))
        yield pd.DataFrame(out, columns=["thread_id", "seq", "same", "tool_calls", "action"])

    def close(self) -> None:
        pass


def detect_recent(calls: DataFrame, most: int = 100, shards: int = 1) -> DataFrame:
    """Streaming form that keeps only the ``most`` most recent threads of each shard, exactly.

    With one shard these are the most recent of all threads, and all calls meet in one task; more
    shards (by a hash of the thread) share the work, each with its own order.  Calls of a batch are
    taken in the order of ``seq``.
    """
    shard = F.pmod(F.xxhash64("thread_id"), F.lit(shards))
    return calls.withColumn("_shard", shard).groupBy("_shard").transformWithStateInPandas(statefulProcessor=RecentThreads(most), outputStructType=OUT, outputMode="append", timeMode="None")


def detect_stream(calls: DataFrame, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Streaming form of the detector over (thread_id, seq, tool, hash).

    Threads are forgotten by time to live, not by a global list of recent ones, which could
    not be partitioned.  Without ``ttl_ms`` state is kept for good and no timer runs.
    """
    return calls.groupBy("thread_id").transformWithStateInPandas(statefulProcessor=LoopDetector(ttl_ms), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime" if ttl_ms else "None")


def event_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Our own addition: tumbling counts of events by type, with a watermark on streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
