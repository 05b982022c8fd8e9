"""Per-item queue state for the event stream (pickled into the Python state workers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_SCHEMA = "status string, accepted int, rejected long, retry_count int"
OUTPUT_SCHEMA = "item_id long, status string, accepted int, rejected long, retry_count int, expired boolean"


class QueueReplay(StatefulProcessor):
    """Moves an item along the allowed edges; illegal requests only count as rejected.

    With ``stale_ms`` an event-time timer drops items that saw no event for that long.
    """

    def __init__(self, edges: tuple[tuple[str, str], ...], start: str = "PENDING", stale_ms: int | None = None) -> None:
        self.edges = frozenset(edges)
        self.start = start
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, accepted, rejected, retries = self.state.get() if self.state.exists() else (self.start, 0, 0, 0)
        # Order needs all events of an item in the micro-batch; of each only a key of 17 bytes is held, and the
        # trigger's file limit bounds their number.
        codes: dict[str, int] = {}
        held = [
            (f["ts"].to_numpy("datetime64[us]").astype("int64"), f["event_id"].to_numpy("int64"),
             np.fromiter((codes.setdefault(t, len(codes)) for t in f["target"]), "uint8", len(f)))
            for f in rows
        ]
        seconds, events, targets = (np.concatenate(x) for x in zip(*held))
        names = list(codes)
        for code in targets[np.lexsort((events, seconds))].tolist():
            target = names[code]
            if (status, target) in self.edges:
                status = target
                accepted += 1
                retries += target == "FAILED"
            else:
                rejected += 1
        self.state.update((status, int(accepted), int(rejected), int(retries)))
        if self.stale_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = int(seconds.max() // 1000)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.stale_ms)
        yield self._row(key, status, accepted, rejected, retries, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, accepted, rejected, retries = self.state.get()
        self.state.clear()
        yield self._row(key, status, accepted, rejected, retries, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, status, accepted, rejected, retries, expired) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "item_id": [key[0]],
                "status": [status],
                "accepted": pd.Series([accepted], dtype="int32"),
                "rejected": [rejected],
                "retry_count": pd.Series([retries], dtype="int32"),
                "expired": [expired],
            }
        )


ITEM_SCHEMA = "status string, accepted int, rejected long, retry_count int, released long"
EVENT_TIME_SCHEMA = "item_id long, status string, accepted int, rejected long, retry_count int, late boolean, event_id long, ts timestamp, target string"
_EVENT = np.dtype([("ts", "<i8"), ("event_id", "<i8"), ("target", "u1")])
_UNKNOWN = 255


class EventTimeReplay(StatefulProcessor):
    """Moves an item along the allowed edges in the order of (ts, event_id), whichever batch an event comes in.

    Events wait in a list, 17 bytes each, until the watermark (and ``late_ms`` beyond it) has passed their slot of event
    time; a timer for the earliest slot releases what is due and sets the next. A batch appends to an item's list and
    reads none of it, so it costs a few state calls an item however many slots it fills. Of an item only what waits is
    held together, which the watermark's delay bounds. An event of a slot that is released already comes out as a late
    row and changes nothing. Rows without a target only move the watermark.
    """

    def __init__(self, edges: tuple[tuple[str, str], ...], start: str, slot_ms: int, late_ms: int) -> None:
        self.edges, self.start, self.slot_ms, self.late_ms = frozenset(edges), start, slot_ms, late_ms
        self.targets = sorted({t for edge in edges for t in edge})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", ITEM_SCHEMA)
        self.waiting = handle.getListState("waiting", "events binary")

    def _now(self) -> tuple[str, int, int, int, int]:
        return self.state.get() if self.state.exists() else (self.start, 0, 0, 0, -(1 << 62))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        codes = {t: i for i, t in enumerate(self.targets)}
        released, new = None, []
        for frame in rows:
            here = frame["target"].notna().to_numpy()
            if not here.any():
                continue
            released = self._now()[4] if released is None else released
            times = frame["ts"].to_numpy("datetime64[us]").astype("int64")
            late = here & (times < released)
            if late.any():
                yield self._late(key, frame[late])
            kept = here & ~late
            events = np.zeros(int(kept.sum()), _EVENT)
            events["ts"], events["event_id"] = times[kept], frame["event_id"].to_numpy("int64")[kept]
            events["target"] = [codes.get(t, _UNKNOWN) for t in frame["target"].to_numpy()[kept]]
            if len(events):
                new.append(events)
        if new:
            self.waiting.appendList([(events.tobytes(),) for events in new])
            self._wake(min(int(events["ts"].min()) for events in new))

    def _wake(self, ts: int) -> None:
        self.handle.registerTimer((ts // (self.slot_ms * 1000) + 1) * self.slot_ms - self.late_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bound = timerValues.getCurrentWatermarkInMs() + self.late_ms
        held = [np.frombuffer(bytes(e), _EVENT) for (e,) in self.waiting.get()]
        if not held:
            return
        events = np.concatenate(held)
        slots = events["ts"] // (self.slot_ms * 1000)
        due = (slots + 1) * self.slot_ms <= bound
        if not due.any():
            return
        rest, last = events[~due], int(slots[due].max())
        events = events[due]
        status, accepted, rejected, retries, _ = self._now()
        for code in events["target"][np.lexsort((events["event_id"], events["ts"]))].tolist():
            target = self.targets[code] if code != _UNKNOWN else ""
            if (status, target) in self.edges:
                status = target
                accepted += 1
                retries += target == "FAILED"
            else:
                rejected += 1
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self._wake(int(rest["ts"].min()))
        else:
            self.waiting.clear()
        self.state.update((status, int(accepted), int(rejected), int(retries), int((last + 1) * self.slot_ms * 1000)))
        yield self._rows(key, [status], [accepted], [rejected], [retries], False, [None], [pd.NaT], [None])

    def close(self) -> None:
        pass

    def _late(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        none = [None] * len(frame)
        return self._rows(key, none, none, none, none, True, frame["event_id"].tolist(), frame["ts"].tolist(), frame["target"].tolist())

    @staticmethod
    def _rows(key, status, accepted, rejected, retries, late, events, times, targets) -> pd.DataFrame:
        n = len(status)
        return pd.DataFrame(
            {
                "item_id": [key[0]] * n,
                "status": pd.Series(status, dtype="object"),
                "accepted": pd.Series(accepted, dtype="Int32"),
                "rejected": pd.Series(rejected, dtype="Int64"),
                "retry_count": pd.Series(retries, dtype="Int32"),
                "late": [late] * n,
                "event_id": pd.Series(events, dtype="Int64"),
                "ts": pd.Series(pd.to_datetime(times)).astype("datetime64[us]"),
                "target": pd.Series(targets, dtype="object"),
            }
        )
