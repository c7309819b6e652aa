"""Best segments of many quality arrays at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _coded(arrays: list[np.ndarray]) -> tuple[np.ndarray, list[float]]:
    """A number for each quality, of one or two bytes where they are small whole ones, and the quality of each number."""
    if not arrays:
        return np.zeros(0, np.uint8), []
    if all(np.issubdtype(a.dtype, np.integer) for a in arrays):
        low, high = min(int(a.min()) for a in arrays), max(int(a.max()) for a in arrays)
        if 0 <= low and high < 1 << 16:
            out = np.empty(sum(map(len, arrays)), np.uint8 if high < 1 << 8 else np.uint16)
            np.concatenate(arrays, out=out, casting="unsafe")
            return out, [float(k) for k in range(high + 1)]
    kinds, at = np.unique(np.concatenate([np.asarray(a, np.float64) for a in arrays]), return_inverse=True)
    return at, kinds.tolist()


def best_segments(arrays: Sequence[np.ndarray], cutoff: float, minimum: int) -> np.ndarray:
    """(start, end) of each array's segment of greatest sum of (limit - error), (0, 0) if it is shorter than ``minimum``.

    All arrays take a step together, from the longest to the shortest, and each
    adds up in the order of its own values, so that a sum does not depend on the
    others. Errors are looked up by quality.
    """
    sizes = np.array([0 if a is None else len(a) for a in arrays], np.int64)
    order = np.argsort(-sizes, kind="stable")
    codes, kinds = _coded([a for a in arrays if a is not None and len(a)])
    worth = np.array([10.0 ** (-cutoff / 10) - 10.0 ** (-k / 10.0) for k in kinds])
    begins = (np.cumsum(sizes) - sizes)[order]
    live_at = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")  # arrays that are longer than each step
    total, best = np.zeros(len(sizes)), np.zeros(len(sizes))
    start, first, last = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for step, n in enumerate(live_at.tolist()):
        now = total[:n]
        now += worth[codes[begins[:n] + step]]
        better = np.flatnonzero(now > best[:n])
        best[better], first[better], last[better] = now[better], start[better], step + 1
        low = np.flatnonzero(now < 0)
        now[low], start[low] = 0.0, step + 1
    out = np.zeros((len(sizes), 2), np.int64)
    long = last - first >= minimum
    out[order[long], 0], out[order[long], 1] = first[long], last[long]
    return out
