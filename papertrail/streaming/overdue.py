"""Keyed state with event-time timers: which PENDING events saw no terminal event in time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

_MINUTE = 60_000_000


def thinned(times: np.ndarray, reach: int) -> np.ndarray:
    """Sorted times without those that add nothing to "is there one within ``reach`` after a given moment": where the ones
    before and after are no more than ``reach`` apart, the one between them is not needed."""
    kept: list[int] = []
    for t in times.tolist():
        if kept and t == kept[-1]:
            continue
        while len(kept) > 1 and t - kept[-2] <= reach:
            kept.pop()
        kept.append(t)
    return np.array(kept, np.int64)


def ended(since: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """Whether each moment has one of the sorted ``ends`` after it, within ``reach``."""
    if not len(ends):
        return np.zeros(len(since), bool)
    at = np.searchsorted(ends, since, side="right")
    return (at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] <= since + reach)


def thinned_by_key(keys: np.ndarray, times: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """``thinned`` for the times of each key (codes); sorted by key."""
    order = np.lexsort((times, keys))
    keys, times = keys[order], times[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (times[1:] != times[:-1])
    keys, times = keys[fresh], times[fresh]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    kept = [thinned(times[a:z], reach) if z - a > 2 else times[a:z] for a, z in zip(first, np.r_[first[1:], len(keys)])]
    return (np.repeat(keys[first], [len(k) for k in kept]), np.concatenate(kept)) if kept else (keys, times)


def ended_by_key(keys: np.ndarray, since: np.ndarray, end_keys: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """Whether each (key, moment) has an end of the same key after it, within ``reach``.  Keys are codes, in any order; a key
    of -1 has no ends."""
    if not len(ends) or not len(since):
        return np.zeros(len(since), bool)
    key, at = np.concatenate([keys, end_keys]), np.concatenate([since, ends])
    opens = np.arange(len(at)) < len(since)
    order = np.lexsort((opens, at, key))  # an end at the same moment comes first: it is not after it
    place = np.where(opens[order], len(at), np.arange(len(at)))
    following = np.minimum.accumulate(place[::-1])[::-1]
    found = following < len(at)
    end = order[np.minimum(following, len(at) - 1)]
    out = np.empty(len(at), bool)
    out[order] = found & (key[end] == key[order]) & (at[end] <= at[order] + reach) & (key[order] >= 0)
    return out[:len(since)]


class Overdue(StatefulProcessor):
    """State of a bucket of keys: their open PENDING events, in chunks of at most ``chunk`` that lie together in time, and as many
    terminal times as later arrivals may need.  A terminal event looks into the chunks it can end and no others.  A bucket has a
    timer at its earliest deadline.  Terminal times go with the watermark, and between two of a key lies more than half of the
    bound, so their number is bounded by the watermark's delay, however many events a key has.

    The stream's key is a bucket, as calls and round trips of state for each key and minute cost far more than the comparison.
    Input rows: ``name`` (the event's key), ``moment`` (microseconds), ``event_id`` as text, ``opens`` (PENDING or terminal).
    """

    def __init__(self, key: str, reach_minutes: float, chunk: int = 4096):
        self.key, self.reach, self.chunk = key, int(reach_minutes * _MINUTE), chunk

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "chunk long", "name array<string>, since array<long>, event_id array<string>")
        self.chunks = handle.getValueState("chunks", "chunk array<long>, first array<long>, last array<long>, next long, timer long")
        self.ends = handle.getValueState("ends", "name array<string>, times array<long>, timer long")

    def _timer(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def _known(self) -> tuple[dict[int, tuple[int, int]], int, int | None]:
        """First and last moment of each chunk, the next chunk's number, the timer."""
        if not self.chunks.exists():
            return {}, 0, None
        chunk, first, last, following, timer = self.chunks.get()
        return dict(zip(chunk, zip(first, last))), following, timer

    def _put(self, known: dict, chunk: int, names: np.ndarray, since: np.ndarray, ids: np.ndarray) -> None:
        if len(since):
            self.open.updateValue((chunk,), (names.tolist(), since.tolist(), ids.tolist()))
            known[chunk] = int(since.min()), int(since.max())
        elif known.pop(chunk, None):
            self.open.removeKey((chunk,))

    def _chunk(self, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, since, ids = self.open.getValue((chunk,))
        return _texts(names), np.array(since, np.int64), _texts(ids)

    def _mark(self, known: dict, following: int, timer: int | None) -> None:
        if known:
            earliest = min(first for first, _ in known.values()) + self.reach
            if earliest != timer:
                self._timer(earliest)
            self.chunks.update((list(known), [f for f, _ in known.values()], [z for _, z in known.values()], following, earliest))
        elif self.chunks.exists():
            self.chunks.clear()

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([r[["name", "moment", "event_id", "opens"]] for r in rows])
        opens = new["opens"].to_numpy(bool)
        moment, ids, names = new["moment"].to_numpy(np.int64), new["event_id"].to_numpy(object), new["name"].to_numpy(object)
        before, times, timer = self.ends.get() if self.ends.exists() else ([], [], None)
        # An event without a key ends nothing, and nothing ends it.
        codes, uniques = pd.factorize(np.concatenate([_texts(before), names]))
        code = codes[len(before):]
        fresh = ~opens & (code >= 0)
        end_code, end = thinned_by_key(np.concatenate([codes[:len(before)], code[fresh]]),
                                       np.concatenate([np.array(times, np.int64), moment[fresh]]), self.reach)
        known, following, due = self._known()
        self._end(known, np.sort(moment[fresh]), code[fresh], moment[fresh], uniques)
        open_code, since = code[opens], moment[opens]
        left = ~ended_by_key(open_code, since, end_code, end, self.reach)
        names, since, ids = names[opens][left], since[left], ids[opens][left]
        order = np.argsort(since, kind="stable")
        for at in range(0, len(order), self.chunk):
            mine = order[at:at + self.chunk]
            self._put(known, following, names[mine], since[mine], ids[mine])
            following += 1
        self._mark(known, following, due)
        self._keep(uniques[end_code], end, timer, timerValues)
        yield self._rows([], [], [])

    def _end(self, known: dict, moments: np.ndarray, code: np.ndarray, ends: np.ndarray, uniques: np.ndarray) -> None:
        """Takes out of the stored events what new terminal events end."""
        for chunk, (first, last) in list(known.items()):
            at = np.searchsorted(moments, first, side="right")
            if at == len(moments) or moments[at] > last + self.reach:
                continue
            names, since, ids = self._chunk(chunk)
            left = ~ended_by_key(pd.Index(uniques).get_indexer(names), since, code, ends, self.reach)
            if not left.all():
                self._put(known, chunk, names[left], since[left], ids[left])

    def _keep(self, names: np.ndarray, ends: np.ndarray, timer: int | None, timerValues) -> None:
        """Terminal times that a PENDING event may still arrive before."""
        open_ = ends > timerValues.getCurrentWatermarkInMs() * 1000
        if open_.any():
            last = int(ends[open_].max())
            if last != timer:
                self._timer(last)
            self.ends.update((names[open_].tolist(), ends[open_].tolist(), last))
        elif self.ends.exists():
            self.ends.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        late: list[list] = [[], [], []]
        known, following, due = self._known()
        reached = [chunk for chunk, (first, _) in known.items() if first + self.reach <= passed]
        for chunk in reached:
            names, since, ids = self._chunk(chunk)
            over = since + self.reach <= passed
            for out, values in zip(late, (names, ids, since)):
                out += values[over].tolist()
            self._put(known, chunk, names[~over], since[~over], ids[~over])
        if reached:
            self._mark(known, following, due)
        if self.ends.exists():
            names, times, timer = self.ends.get()
            self._keep(_texts(names), np.array(times, np.int64), timer, timerValues)
        yield self._rows(*late)

    def _rows(self, names: list, ids: list, since: list) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series(names, dtype=object), "event_id": pd.Series(ids, dtype=object),
                             "pending_since": pd.Series(since, dtype="int64")})

    def close(self) -> None:
        pass


def _texts(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out
