"""Keyed state: how many requests of a client's window have been admitted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

_NOTHING = pd.DataFrame({"row": pd.Series([], dtype=object), "admitted": pd.Series([], dtype=bool)})


class Admission(StatefulProcessor):
    """Each request of a (client, window) with its answer, at once: the first ``limit`` of a window are admitted.

    The stream's key is a bucket of (client, window)s, as a call and a round trip of state for each of them costs far more than
    the answer.  State of a bucket is one number per open window, and goes when the watermark passes the window's end.
    Requests of one micro-batch are taken in order of (moment, id); a request that comes in a later batch than its window's
    ``limit``-th is not admitted, whatever its time.

    Input rows: ``client``, ``until`` (end of the window, milliseconds), ``moment`` (microseconds), ``place``, ``row``.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "client array<string>, until array<long>, n array<long>, timer long")

    def _known(self) -> tuple[dict, int | None]:
        if not self.used.exists():
            return {}, None
        clients, until, n, timer = self.used.get()
        return dict(zip(zip(clients, until), n)), timer

    def _keep(self, used: dict, timer: int | None, passed: int) -> None:
        """Open windows and a timer at the first of their ends."""
        used = {k: n for k, n in used.items() if k[1] > passed}
        if used:
            first = min(until for _, until in used)
            if first != timer:
                self.handle.registerTimer(first)
            self.used.update(([c for c, _ in used], [u for _, u in used], list(used.values()), first))
        elif self.used.exists():
            self.used.clear()

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        used, timer = self._known()
        client, clients = pd.factorize(new["client"], use_na_sentinel=False)
        until = new["until"].to_numpy(np.int64)
        order = np.lexsort((new["place"].to_numpy(np.int64), new["moment"].to_numpy(np.int64), until, client))
        client, until = client[order], until[order]
        first = np.flatnonzero(np.r_[True, (client[1:] != client[:-1]) | (until[1:] != until[:-1])])
        counts = np.diff(np.r_[first, len(order)])
        windows = [(None if pd.isna(c) else c, u) for c, u in zip(clients[client[first]], until[first].tolist())]
        before = np.array([used.get(w, 0) for w in windows], np.int64)
        admitted = np.zeros(len(new), bool)
        admitted[order] = np.arange(len(order)) - np.repeat(first - before, counts) < self.limit
        used.update(zip(windows, np.minimum(before + counts, self.limit).tolist()))
        self._keep(used, timer, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"row": new["row"].to_numpy(object), "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._keep(*self._known(), timerValues.getCurrentWatermarkInMs())
        yield _NOTHING

    def close(self) -> None:
        pass
