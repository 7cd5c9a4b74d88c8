"""Stateful folds, in batch per key and as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bin of chat activity, and how late a reaction may come.
BIN, LATE = "15 seconds", "8 seconds"
#: Steps of a run, and the states each state may turn into.
MOVES = {"pending": {"running", "skipped", "cancelled"}, "running": {"done", "failed", "cancelled", "interrupted"}, "interrupted": {"running", "cancelled"}}


def chat_activity_stream(messages: DataFrame) -> DataFrame:
    """Counts by tumbling bin of a stream with a column ts; a bin is final once the watermark has passed it."""
    return messages.withWatermark("ts", LATE).groupBy(F.window("ts", BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(F.col("bin.start").alias("bin_start"), "n")


def fold_open(rows: list[tuple[str, int, int, bool]], seen: dict[str, list]) -> dict[str, list]:
    """Carry open events over windows: (key, start_id, end_id, ended) in order into {key: [start, end, ended]}.

    A row continues the event of its key, else the open one that starts at the same place; an ended event
    takes no more rows; an end moves back only when the event ends.
    """
    for key, start, end, ended in rows:
        event = seen.get(key)
        if event is None:
            same = next((k for k, x in seen.items() if not x[2] and x[0] == start), None)
            if same is None:
                seen[key] = [start, end, ended]
                continue
            event = seen[same]
        if event[2]:
            continue
        event[1] = end if ended else max(event[1], end)
        event[2] = ended
    return seen


def open_events(rows: DataFrame) -> DataFrame:
    """rec, key, start_id, end_id, ended after all rows (rec, ord, key, start_id, end_id, ended) of a recording."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        seen = fold_open(list(zip(group["key"], group["start_id"].tolist(), group["end_id"].tolist(), group["ended"].tolist(), strict=True)), {})
        return pd.DataFrame([(group["rec"].iloc[0], k, *x) for k, x in seen.items()], columns=["rec", "key", "start_id", "end_id", "ended"])

    return rows.groupBy("rec").applyInPandas(run, "rec long, key string, start_id long, end_id long, ended boolean")


def step_states(events: list[str]) -> tuple[str, int]:
    """(the state after the moves asked for in order, how many were refused)."""
    state, refused = "pending", 0
    for wanted in events:
        if wanted in MOVES.get(state, ()):
            state = wanted
        else:
            refused += 1
    return state, refused


def step_machine(events: DataFrame) -> DataFrame:
    """rec, state, refused of moves (rec, ord, state)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state, refused = step_states(group.sort_values("ord")["state"].tolist())
        return pd.DataFrame([(group["rec"].iloc[0], state, refused)], columns=["rec", "state", "refused"])

    return events.groupBy("rec").applyInPandas(run, "rec long, state string, refused long")


def step_machine_stream(events: DataFrame) -> DataFrame:
    """The same over a stream of (rec, state); the state and the refusals of each recording are kept between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, refused = held.get if held.exists else ("pending", 0)
        for batch in batches:
            for wanted in batch["state"]:
                if wanted in MOVES.get(state, ()):
                    state = wanted
                else:
                    refused += 1
        held.update((state, refused))
        yield pd.DataFrame([(key[0], state, refused)], columns=["rec", "state", "refused"])

    return events.groupBy("rec").applyInPandasWithState(run, "rec long, state string, refused long", "state string, refused long", "update", GroupStateTimeout.NoTimeout)


def thread_counts(loads: list[float], most: int = 8, high: float = 85.0, low: float = 60.0, patience: int = 3) -> list[int]:
    """Threads after each sample of load: half at once when the smoothed load is high, one more after some calm samples."""
    threads, smooth, calm, out = most, None, 0, []
    for load in loads:
        smooth = load if smooth is None else 0.5 * smooth + 0.5 * load
        if smooth > high:
            threads, calm = max(1, threads // 2), 0
        else:
            calm = calm + 1 if smooth < low else 0
            if calm >= patience and threads < most:
                threads, calm = threads + 1, 0
        out.append(threads)
    return out


def thread_policy(samples: DataFrame) -> DataFrame:
    """rec, ord, threads of samples (rec, ord, load)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        return pd.DataFrame({"rec": group["rec"], "ord": group["ord"], "threads": thread_counts(group["load"].tolist())})

    return samples.groupBy("rec").applyInPandas(run, "rec long, ord long, threads long")
