"""Sliding-window replay of one key's ascending requests, shared by the batch and the stream.

Small per-key helpers on numpy arrays; Spark partitions, sorts and shuffles what they are fed.
"""

from __future__ import annotations

from collections import deque

import numpy as np


def admitted_counts(times: np.ndarray, counts: np.ndarray, limits: np.ndarray, window_ms: int, live: deque) -> list[tuple[int, int]]:
    """Replay ascending runs of one key: (place, admitted) of every run that gets some.

    ``live`` holds the admitted (time, number) entries of the window, oldest first, and is brought
    up to date.  While the window is full for every limit that comes, the next eviction is
    searched instead of stepping run by run."""
    out = []
    held = sum(n for _, n in live)
    most = int(limits.max()) if len(limits) else 0
    i = 0
    while i < len(times):
        now = int(times[i])
        while live and live[0][0] <= now - window_ms:
            held -= live.popleft()[1]
        m = min(int(counts[i]), int(limits[i]) - held)
        if m > 0:
            live.append((now, m))
            held += m
            out.append((i, m))
        i += 1
        if held >= most:
            if not live:  # a limit of zero or less
                break
            i = max(i, int(np.searchsorted(times, live[0][0] + window_ms)))
    return out


def decide(t: np.ndarray, limits: np.ndarray, window_ms: int, live: deque) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Admitted, current and retry-after of ascending requests, one by one; ``live`` holds the entries
    (time, number) before them and is brought up to date."""
    before = [(a, n) for a, n in live]
    ok = np.zeros(len(t), dtype=bool)
    for i, _ in admitted_counts(t, np.ones(len(t), dtype=np.int64), limits, window_ms, live):
        ok[i] = True
    # every entry that any of these requests may see, each request counted once
    at = np.concatenate([np.repeat([a for a, _ in before], [n for _, n in before]).astype(np.int64), t[ok]])
    known = len(at) - int(ok.sum())
    upto = known + np.cumsum(ok)              # entries made until and with each request
    gone = np.searchsorted(at, t - window_ms, side="right")
    current = np.maximum(upto - gone, 0)
    oldest = at[np.minimum(gone, len(at) - 1)] if len(at) else np.zeros(len(t), dtype=np.int64)
    return ok, current, np.where(ok | (current == 0), 0, window_ms - (t - oldest))
