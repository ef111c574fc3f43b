"""Live re-identification of a stream, with state in Spark's state store.

Rows wait until the watermark has passed their frame, so that frames are complete and in order whatever the order of
arrival; rows that are later than the watermark are dropped. What a sequence needs from frame to frame is small: pending
and active tracks and those lost within the memory. Identities and merge records are looked up one by one. A sequence
without rows for a while is ended by a timer: pending ids are decided, and all its state goes.

Decisions are those of ``operators.ledger``, whose batch form gives the same rows if the same frames exist: a row
without id says that a frame passed without boxes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackspark.operators.ledger import Candidate, LedgerConfig, Merges, choose, round6

ROWS = "sequence string, frame int, raw_id int, id int, x double, y double, w double, h double, class_id int, decision_frame int"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


@dataclass
class Track:
    """A track of the last frames: its rows while pending, else the last ones of its run."""

    since: int
    rows: list[list[float]] = field(default_factory=list)  # frame, x, y, w, h, class
    canonical: int | None = None
    state: str = "pending"  # pending, active or lost

    def means(self) -> tuple[list[float], list[float]]:
        """Mean w, h and centre, and the velocity of the centre from the first row to the last."""
        n = len(self.rows)
        cx, cy = ([r[1 + k] + r[3 + k] / 2 for r in self.rows] for k in (0, 1))
        steps = max(self.rows[-1][0] - self.rows[0][0], 1)
        return [round6(sum(v) / n) for v in ([r[3] for r in self.rows], [r[4] for r in self.rows], cx, cy)], [round6((v[-1] - v[0]) / steps) for v in (cx, cy)]


class LiveMapper:
    """Frame by frame. ``tracks`` holds what is near in time; ``identities`` and ``merges`` are mappings that may live elsewhere."""

    def __init__(self, config: LedgerConfig, tracks: dict[int, Track] | None = None, identities=None, merges=None, next_id: int = 1):
        self.config, self.tracks, self.next_id = config, {} if tracks is None else tracks, next_id
        self.identities = {} if identities is None else identities
        self.merges = {} if merges is None else merges
        self.given: set[int] = set()

    def update(self, frame: int, rows: list[tuple]) -> Iterator[tuple]:
        """Rows (id, x, y, w, h, class) of one frame; yields rows (frame, raw id, id, x, y, w, h, class, decision frame) as their id is settled."""
        rows = sorted(rows)
        here = {r[0] for r in rows}
        for raw in [i for i, t in self.tracks.items() if t.state == "pending" and i not in here]:
            yield from self._decide(raw, frame)
        for raw, t in self.tracks.items():
            if t.state == "active" and raw not in here:
                t.state = "lost"
        for raw in [i for i, t in self.tracks.items() if t.state == "lost" and frame - t.rows[-1][0] - 1 > self.config.memory]:
            del self.tracks[raw]
        for raw, *box in rows:
            self.next_id = max(self.next_id, raw + 1)
            t = self.tracks.get(raw)
            known = self.identities.get(raw) if t is None else t.canonical
            if known is None:
                t = self.tracks.setdefault(raw, Track(frame))
                t.rows.append([frame, *box])
                if len(t.rows) >= self.config.confirm:
                    yield from self._decide(raw, frame)
                continue
            if t is None or t.state == "lost":  # back again: a run of its own
                self.tracks[raw] = t = Track(frame, [], known, "active")
            t.rows = [*t.rows, [frame, *box]][-self.config.tail :]
            yield frame, raw, known, *box, frame

    def flush(self, frame: int) -> Iterator[tuple]:
        for raw in [i for i, t in self.tracks.items() if t.state == "pending"]:
            yield from self._decide(raw, frame)

    def _decide(self, raw: int, frame: int) -> Iterator[tuple]:
        t = self.tracks[raw]
        found = [c for other, lost in self.tracks.items() if lost.state == "lost" and (c := self._eligible(t, other, lost))]
        found.sort(key=lambda c: (-c.score, c.motion_distance, c.gap, c.id))
        touched: dict[int, Merges] = {}

        def record(whole: int) -> Merges:
            if whole not in touched:
                touched[whole] = self.merges.get(whole) or Merges()
            return touched[whole]

        best = choose(found, lambda i: self.tracks[i].canonical, frame, raw, record, self.config)
        if best is not None:
            whole = self.tracks[best.id].canonical
            self.merges[whole] = touched[whole]
            del self.tracks[best.id]
        else:
            whole = self._new_id(raw)
        self.identities[raw] = whole
        for row in t.rows:
            yield int(row[0]), raw, whole, *row[1:], frame
        self.tracks.pop(raw)
        self.tracks[raw] = Track(t.since, t.rows[-self.config.tail :], whole, "active")

    def _new_id(self, raw: int) -> int:
        if raw > 0 and raw not in self.given:
            return raw
        while self.next_id in self.given:
            self.next_id += 1
        self.given.add(self.next_id)
        self.next_id += 1
        return self.next_id - 1

    def _eligible(self, new: Track, other: int, lost: Track) -> Candidate | None:
        limits, last, first = self.config.pairs, lost.rows[-1], new.rows[0]
        gap, elapsed = max(0, first[0] - last[0] - 1), max(1, first[0] - last[0])
        if last[5] != first[5] or gap > self.config.longest_gap:
            return None
        (w, h, *at), _ = new.means()
        (lw, lh, *_), speed = lost.means()
        end = last[1] + last[3] / 2, last[2] + last[4] / 2
        away = lambda x, y: ((x - at[0]) ** 2 + (y - at[1]) ** 2) ** 0.5
        direct, moved = away(*end), away(end[0] + speed[0] * elapsed, end[1] + speed[1] * elapsed)
        radius = limits.base_region_radius + limits.growth_per_frame * gap
        areas = max(lw * lh, 1e-9), max(w * h, 1e-9)
        ratio, aspect = max(areas) / min(areas), abs(lw / max(lh, 1e-9) - w / max(h, 1e-9))
        if not (moved <= radius or direct <= limits.max_center_distance) or ratio > limits.max_area_ratio or aspect > limits.max_aspect_delta:
            return None
        share = lambda value, most: 1.0 if most <= 0 else min(1.0, max(0.0, 1 - value / most))
        by_ratio = 1.0 if ratio <= 1 else share(ratio - 1, limits.max_area_ratio - 1)
        parts = share(gap, self.config.longest_gap) + share(min(direct, moved), max(limits.max_center_distance, radius)) + by_ratio + share(aspect, limits.max_aspect_delta)
        return Candidate(other, (other, lost.since), gap, round6(parts / 4 + 1e-9), round6(moved + 1e-9))


class _Stored:
    """A mapping over a state variable, read and written one key at a time."""

    def __init__(self, state, read: Callable, write: Callable):
        self.state, self.read, self.write = state, read, write

    def get(self, key: int, default=None):
        return self.read(self.state.getValue((int(key),))) if self.state.containsKey((int(key),)) else default

    def __getitem__(self, key: int):
        return self.get(key)

    def __setitem__(self, key: int, value) -> None:
        self.state.updateValue((int(key),), self.write(value))


class LiveProcessor(StatefulProcessor):
    """One sequence. ``idle_ms`` of event time without rows, and the watermark beyond it, end the sequence."""

    def __init__(self, config: LedgerConfig, idle_ms: int):
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame int", "ts long, rows string")
        self.near = handle.getMapState("near", "id int", "track string")
        self.known = handle.getMapState("known", "id int", "canonical int")
        self.merged = handle.getMapState("merged", "canonical int", "absorbed int, last int")
        self.clock = handle.getValueState("clock", "frame int, next_id int, last_ts long, given string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, next_id, last_ts, given = self.clock.get() if self.clock.exists() else (-(2**31), 1, -(2**62), "[]")
        newest, last_ts = last_ts, int(last_ts)
        for part in rows:
            for number, group in part.groupby("frame", sort=True):
                if number <= frame:
                    continue  # the frame is over: too late
                ts = int(group["ts_ms"].max())
                held = json.loads(self.waiting.getValue((int(number),))[1]) if self.waiting.containsKey((int(number),)) else []
                boxes = group[group["id"].notna()]
                held += [[int(r.id), float(r.x), float(r.y), float(r.w), float(r.h), int(r.class_id)] for r in boxes.itertuples()]
                self.waiting.updateValue((int(number),), (ts, json.dumps(held)))
                self.handle.registerTimer(ts + 1)
                last_ts = max(last_ts, ts)
        if last_ts > newest:
            self.handle.registerTimer(last_ts + self.idle_ms)
        self.clock.update((int(frame), int(next_id), last_ts, given))
        yield from self._advance(key[0], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.clock.exists():
            yield from self._advance(key[0], timerValues)

    def _advance(self, sequence: str, timers) -> Iterator[pd.DataFrame]:
        """Take the frames that the watermark has passed, in order; end the sequence if it has been idle long enough."""
        now = timers.getCurrentWatermarkInMs()
        frame, next_id, last_ts, given = self.clock.get()
        ready = sorted((int(k[0]), json.loads(v[1])) for k, v in self.waiting.iterator() if v[0] < now)
        over = now >= last_ts + self.idle_ms
        if not ready and not over:
            return
        before = {int(k[0]): v[0] for k, v in self.near.iterator()}
        # in order of arrival, as ids that vanish together are decided in that order
        tracks = {i: Track(**json.loads(t)) for i, t in before.items()}
        tracks = dict(sorted(tracks.items(), key=lambda x: (x[1].since, x[0])))
        identities = _Stored(self.known, lambda v: int(v[0]), lambda v: (int(v),))
        merges = _Stored(self.merged, lambda v: Merges(int(v[0]), None if v[1] is None else int(v[1])), lambda m: (m.absorbed, m.last))
        mapper = LiveMapper(self.config, tracks, identities, merges, int(next_id))
        mapper.given = set(json.loads(given))
        out = []
        for frame, rows in ready:
            out += mapper.update(frame, [tuple(r) for r in rows])
            self.waiting.removeKey((frame,))
        if over:
            out += mapper.flush(frame)
            for state in (self.waiting, self.near, self.known, self.merged, self.clock):
                state.clear()
        else:
            for i in before.keys() - tracks.keys():
                self.near.removeKey((i,))
            for i, t in tracks.items():
                if before.get(i) != (text := json.dumps(t.__dict__)):
                    self.near.updateValue((i,), (text,))
            self.clock.update((int(frame), mapper.next_id, int(last_ts), json.dumps(sorted(mapper.given))))
        yield pd.DataFrame([(sequence, *r) for r in out], columns=NAMES)


def live_stream(tracks: DataFrame, config: LedgerConfig = LedgerConfig(), delay: str = "10 seconds", idle_seconds: int = 60) -> DataFrame:
    """Rows with settled ids of a stream (sequence, frame, id, x, y, w, h, class_id, ts): raw_id is their own, id the canonical one.

    ``ts`` is the time of the frame; rows later than ``delay`` are dropped. Needs the RocksDB state store.
    """
    rows = tracks.select("sequence", "frame", "id", "x", "y", "w", "h", "class_id", "ts").withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts"))
    return rows.groupBy("sequence").transformWithStateInPandas(LiveProcessor(config, idle_seconds * 1000), ROWS, "append", "eventTime")


def mapping(rows: DataFrame) -> DataFrame:
    """One row per id of a finished stream: its canonical id, first and last frame, and the frame that decided it."""
    return rows.groupBy("sequence", "raw_id").agg(F.min("id").alias("canonical_id"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by("decision_frame", "frame").alias("decision_frame"))
