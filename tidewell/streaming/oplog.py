"""Replay of ordered operation logs on a multimap, in batch and as a stream.

``s k`` searches, ``i k p`` inserts, ``d k`` removes one entry (the smallest payload), ``u k p``
removes one if there is any and inserts.  Keys are independent of each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _apply(live: list[int], op: str, ptr) -> None:
    """Run one change on a heap of payloads."""
    if op in "du" and live:
        heapq.heappop(live)
    if op in "iu":
        heapq.heappush(live, int(ptr))


def _replayed(log: DataFrame, searches: bool) -> DataFrame:
    """Replay keys one after the other as their operations stream by; a task holds one key's live payloads.

    What a delete removes depends on all before it, so a key's operations can't be split.
    """
    names = ["seq", "key", "n", "ptr"] if searches else ["key", "ptr"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live = None, []
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for own, seq, op, ptr in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if not searches:
                        out[0] += [key] * len(live)
                        out[1] += live
                    key, live = own, []
                if op != "s":
                    _apply(live, op, ptr)
                elif searches:
                    for column, value in zip(out, (seq, key, len(live), live[0] if live else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
        if live and not searches:
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(live), pa.int64()), pa.array(live, pa.int64())], schema=schema)

    rows = log.where("key is not null").select("key", "seq", "op", "ptr")
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def final_state(log: DataFrame) -> DataFrame:
    """Live entries (key, ptr) after the whole log."""
    return _replayed(log.where("op != 's'"), searches=False)


def search_results(log: DataFrame) -> DataFrame:
    """For each search: seq, key, number of live entries then, and the smallest payload."""
    return _replayed(log, searches=True)


def replay_stream(log: DataFrame) -> DataFrame:
    """Streaming replay: after each batch, the live payloads of every key that it touched."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = list(state.get[0]) if state.exists else []  # a heap
        rows = pd.concat(list(frames)).sort_values("seq")
        for op, ptr in zip(rows["op"], rows["ptr"], strict=True):
            if op != "s":
                _apply(live, op, ptr)
        state.update((live,))
        yield pd.DataFrame({"key": [key[0]], "ptrs": [sorted(live)]})

    return log.groupBy("key").applyInPandasWithState(run, "key long, ptrs array<long>", "live array<long>", "update", GroupStateTimeout.NoTimeout)
