"""Lines out of chunks of output, and the state machine of a staged run: one rule each for tables and streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Chunks of one process that are counted together.
BLOCK = 1024


def lines_of(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """(key, n, line): complete lines of each process, numbered from 0 with the blank ones, which are left out; an unfinished last line is dropped.

    A piece of a chunk belongs to the line whose number is the count of line ends before it. Ends are counted
    in blocks of BLOCK chunks and then over blocks, so no task sorts a whole process; only the
    pieces of one line come together. A null chunk is empty; chunks of equal order come in any order.
    """
    c = chunks.select(key, F.col(order).alias("_o"), F.coalesce(chunk, F.lit("")).alias("_c")).withColumn("_b", F.floor(F.col("_o") / BLOCK))
    ends = F.size(F.split("_c", "\n")) - 1
    blocks = c.groupBy(key, "_b").agg(F.sum(ends).alias("_n"))
    base = blocks.select(F.col(key).alias("_key"), F.col("_b").alias("_block"), (F.sum("_n").over(Window.partitionBy(key).orderBy("_b")) - F.col("_n")).alias("_base"))
    within = F.sum(ends).over(Window.partitionBy(key, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)) - ends
    at = c.withColumn("_w", within).join(base, F.col(key).eqNullSafe(F.col("_key")) & F.col("_b").eqNullSafe(F.col("_block")))
    pieces = at.select(key, "_o", (F.col("_base") + F.col("_w")).alias("_f"), F.size(F.split("_c", "\n")).alias("_m"), F.posexplode(F.split("_c", "\n")).alias("_i", "_p"))
    whole = pieces.groupBy(key, (F.col("_f") + F.col("_i")).alias("n")).agg(F.array_sort(F.collect_list(F.struct("_o", "_i", "_p"))).alias("_l"), F.max((F.col("_i") < F.col("_m") - 1)).alias("_done"))
    text = F.array_join(F.transform("_l", lambda p: p["_p"]), "")
    return whole.where("_done").select(key, "n", text.alias("line")).where(F.trim(F.regexp_replace("line", r"\s", "")) != "")


def cut(carry: str, chunks: list[str]) -> tuple[list[str], str]:
    """(complete lines, the unfinished rest) of a carried line and the chunks after it."""
    *whole, rest = (carry + "".join(chunks)).split("\n")
    return whole, rest


def stream_lines(chunks: DataFrame, key: str, order: str, chunk: str, late: str = "1 day", idle: int = 24 * 3600 * 1000) -> DataFrame:
    """The same lines of a stream of (key, ts, order, chunk): each process carries its unfinished line and its line count from batch to batch.

    A process of which nothing came for ``idle`` milliseconds of event time is given up with its unfinished line.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        carry, n = state.get if state.exists else ("", 0)
        own = pd.concat(list(frames)).sort_values(order)
        whole, carry = cut(carry, own[chunk].fillna("").tolist())
        state.update((carry, n + len(whole)))
        state.setTimeoutTimestamp(max(int(own["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle)
        kept = [(n + i, line) for i, line in enumerate(whole) if line.strip()]
        yield pd.DataFrame({key: [k[0]] * len(kept), "n": [i for i, _ in kept], "line": [t for _, t in kept]})

    return chunks.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, line string", "carry string, n long", "append", GroupStateTimeout.EventTimeTimeout)


@dataclass(frozen=True)
class Run:
    """Where a staged run stands: its stage, whether that is being worked on, and the state of each stage (p, a, c or e)."""

    current: int
    running: bool
    stages: str

    def marked(self, state: str) -> Run:
        return replace(self, stages=self.stages[: self.current] + state + self.stages[self.current + 1 :])

    def advanced(self) -> Run:
        return replace(self.marked("c"), current=min(self.current + 1, len(self.stages) - 1))

    def after(self, event: str, manual: tuple[int, ...]) -> Run:
        """run: begins the stage unless one is being worked on or the stage is a manual one. ok, fail: its outcome. confirm: done by hand. retry: pending again."""
        if event == "run" and not self.running and self.current not in manual:
            return replace(self.marked("a"), running=True)
        if event == "ok" and self.running:
            return replace(self.advanced(), running=False)
        if event == "fail" and self.running:
            return replace(self.marked("e"), running=False)
        if event == "confirm":
            return self.advanced()
        return self.marked("p") if event == "retry" else self


def run_states(events: DataFrame, key: str, order: list[str], event: str, stages: int, manual: tuple[int, ...] = ()) -> DataFrame:
    """(key, current, running, stages, seen): the state of each run after all its events in order.

    Events are dealt by key and sorted within their partition, then folded as they pass: a task
    holds one state, however many events a run has. Unknown and null events change nothing.
    """
    kind = events.schema[key].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, seen, out = None, None, 0, []
        for frame in frames:
            for k, e in zip(frame["k"], frame["e"], strict=True):
                if state is None or k != now:
                    if state is not None:
                        out.append((now, state.current, state.running, state.stages, seen))
                    now, state, seen = k, Run(0, False, "p" * stages), 0
                state, seen = state.after(e, manual), seen + 1
            if out:
                yield pd.DataFrame(out, columns=[key, "current", "running", "stages", "seen"])
                out = []
        if state is not None:
            yield pd.DataFrame([(now, state.current, state.running, state.stages, seen)], columns=[key, "current", "running", "stages", "seen"])

    dealt = events.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(event).alias("e"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    ordered = dealt.repartition("k").sortWithinPartitions("k", *(f"o{i}" for i in range(len(order)))).select("k", "e")
    return ordered.mapInPandas(fold, f"{key} {kind}, current int, running boolean, stages string, seen long")


def stream_states(events: DataFrame, key: str, order: list[str], event: str, stages: int, manual: tuple[int, ...] = (), late: str = "400 days", idle: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """The same states of a stream of events with a column ts; a run's row comes anew with every batch that holds events of it."""
    kind = events.schema[key].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        current, running, marks, seen = state.get if state.exists else (0, False, "p" * stages, 0)
        run = Run(current, running, marks)
        own = pd.concat(list(frames)).sort_values(order)
        for e in own[event]:
            run, seen = run.after(e, manual), seen + 1
        state.update((run.current, run.running, run.stages, seen))
        state.setTimeoutTimestamp(max(int(own["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame({key: [k[0]], "current": [run.current], "running": [run.running], "stages": [run.stages], "seen": [seen]})

    shape = f"{key} {kind}, current int, running boolean, stages string, seen long"
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, shape, "current int, running boolean, stages string, seen long", "update", GroupStateTimeout.EventTimeTimeout)
