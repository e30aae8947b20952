"""Gaps between the events of a key, with state that the watermark settles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor


def packed(pdf: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(pdf, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def gap_processor(seconds: float) -> StatefulProcessor:
    """Its groups are slots of many keys (columns none, some and at), so that the state is called a few times a slot and
    batch, and not a few times a key or an event time."""

    class Gaps(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "events binary")
            self.last = handle.getValueState("last", "events binary")

        def wake(self, at: int) -> None:
            """Comes back when the watermark has passed an event time."""
            self.handle.registerTimer(int(at) // 1000 + 1)

        def settled(self, watermark_ms: int, new: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Moves the events that the watermark has passed out of the state, in order, and tells their gaps."""
            parts = [unpacked(x) for (x,) in self.waiting.get()] + new
            if not parts:
                return
            events = pd.concat(parts, ignore_index=True)
            is_past = events["at"] <= watermark_ms * 1000
            past, rest = events[is_past], events[~is_past]
            if len(rest):
                self.waiting.put([(packed(rest),)])
                self.wake(rest["at"].min())
            else:
                self.waiting.clear()
            if not len(past):
                return
            known = [unpacked(self.last.get()[0])] if self.last.exists() else []
            past = pd.concat([*known, past], ignore_index=True)
            key, at = past.groupby(["none", "some"], sort=False, dropna=False).ngroup().to_numpy(), past["at"].to_numpy()
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
            same, gap = key[1:] == key[:-1], np.diff(at)
            self.last.update((packed(past.iloc[order[np.append(~same, True)]]),))
            told = np.flatnonzero(same & (gap > seconds * 1e6))
            if len(told):
                rows = past.iloc[order[told + 1]]
                yield pd.DataFrame({"none": rows["none"].to_numpy(), "some": rows["some"].to_numpy(), "start": at[told + 1], "gap_s": gap[told] / 1e6})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            watermark, new = timerValues.getCurrentWatermarkInMs(), [pdf[["none", "some", "at"]] for pdf in rows]
            first = min(int(pdf["at"].min()) for pdf in new)
            if first <= watermark * 1000:
                yield from self.settled(watermark, new)
            else:  # what waited before has a timer of its own
                for pdf in new:
                    self.waiting.appendValue((packed(pdf),))
                self.wake(first)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self.settled(timerValues.getCurrentWatermarkInMs(), [])

        def close(self) -> None:
            """Nothing is held outside the state."""

    return Gaps()
