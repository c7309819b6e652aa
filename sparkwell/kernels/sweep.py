"""Whole affine tables of many sequences against one reference, an antidiagonal at a time.

Cells of an antidiagonal do not depend on each other, so that a step over all of them, and over all
sequences of a batch, is a few operations on whole arrays. Numbers are those of a table to which each letter
of either side adds one: then a gap costs nothing once it is open. Only every so many steps are the
states kept. On the way back an alignment can leave its place by one residue a step at most: just that
window of each sequence is made again from what was kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

#: Cells of a step over a batch, sequences of which the way back is looked for together, bytes of kept states.
CELLS, TOGETHER, KEPT = 88_000, 512, 1 << 27
#: Letters of each sequence, beyond those of the reference, of which scores are looked up at a time.
STRETCH = 4096
#: Steps between kept states: the least, and the most, in which a number rises by 3400 or falls by 600 at most.
LEAST_STEPS, MOST_STEPS = 64, 512
#: The least numbers of two and of four bytes. Of two cells of a step, one so far below the other that the letters behind it
#: cannot win it back is on no best alignment, whatever is written there; so a number is never less than the least that fits.
LOW, LONG_LOW = -32_000, -(1 << 28)


class Scoring(NamedTuple):
    """Scores by code of reference and sequence letter, the most of each letter, and the penalty of a gap's first residue beyond that of each further one, which is one."""

    table: np.ndarray
    most: np.ndarray
    gap: int


class _Run(NamedTuple):
    """What a batch leaves: for each block the lane of the first row, and states by array, lane and sequence; what was taken from the numbers of a block; (lane, state) of each end."""

    kept: list[tuple[int, np.ndarray]]
    taken: list[np.ndarray]
    ends: list[tuple[int, int]]


def _rising(scoring: Scoring, codes: np.ndarray) -> int:
    return int((scoring.most[codes].astype(np.int64) + 2).sum())


class _Group:
    """Sequences, the longest first, whose way back is looked for together."""

    def __init__(self, scoring: Scoring, ref: np.ndarray, seqs: Sequence[np.ndarray], free_start: bool, free_end: bool, steps: int) -> None:
        self.scoring, self.ref, self.seqs, self.steps = scoring, ref, seqs, steps
        self.free_start, self.free_end = free_start, free_end
        self.m = np.array([len(s) for s in seqs])
        won_back = min(_rising(scoring, ref), max(_rising(scoring, s) for s in seqs) + len(ref))
        self.low, self.type = (LOW, np.int16) if won_back + 8 * steps + 100 <= -LOW else (LONG_LOW, np.int32)
        self.none = scoring.table.shape[1]  # stands after the end of a sequence, where numbers must not rise
        self.scores = np.pad((scoring.table + 2).astype(self.type), ((0, 0), (0, 1)))

    def run(self, first: int, last: int) -> _Run:
        """All steps over sequences ``first`` to ``last``, exclusive."""
        n, low, gap, kind = len(self.ref), self.low, self.type(self.scoring.gap), self.type
        ms, pairs = self.m[first:last], last - first
        m, least = int(ms[0]), int(ms[-1])
        codes = np.full((m, pairs), self.none, np.uint8)
        for k in range(pairs):
            codes[: ms[k], k] = self.seqs[first + k]
        used, letter = np.unique(self.ref, return_inverse=True)
        rows = n + 2  # lane i is row i + 1; the first row is out of reach
        on, skip, other, insert, before, best, worth = (np.full(rows * pairs, low, kind) for _ in range(7))
        on[pairs : 2 * pairs] = best[pairs : 2 * pairs] = 0
        kept, taken, offset = [], [], np.zeros(pairs, np.int64)
        last_on = np.empty((n + m - least + 1, pairs), kind)  # at the end of each sequence, from step ``least``
        last_gaps = np.empty((2, m - least + 1, pairs), kind)
        ends = np.arange(pairs) - (ms - 1) * pairs
        until = begin = 0
        for d in range(1, n + m + 1):
            if (d - 1) % self.steps == 0:
                live = int(np.searchsorted(-ms, n - d, "right"))
                if fewer := 4 * live <= 3 * pairs:  # sequences that are over leave the arrays
                    on, skip, other, insert, before, best, worth = (np.ascontiguousarray(x.reshape(rows, pairs)[:, :live]).reshape(-1) for x in (on, skip, other, insert, before, best, worth))
                    pairs, offset, ends = live, offset[:live], np.arange(live) - (ms[:live] - 1) * live
                if fewer or d + self.steps > until + 1 and until < n + m:
                    # what each letter of the reference scores along a stretch of each sequence; lane i of step d reads letter d - i, so that a step is one further along all of it
                    begin = max(0, d - 1 - n)
                    end = min(m, begin + n + max(STRETCH, self.steps))
                    until = end if end < m else n + m
                    worths = np.empty((n + len(used) * (end - begin), pairs), kind)
                    for k, r in enumerate(used.tolist()):
                        self.scores[r].take(codes[begin:end, :pairs], out=worths[n + k * (end - begin) : n + (k + 1) * (end - begin)], mode="clip")
                    at = np.r_[n, letter.astype(np.intp) * (end - begin) + n - np.arange(1, n + 1)]
            a, y = max(0, d - m), min(n, d - 1)
            lo, hi = (a + 1) * pairs, (y + 2) * pairs
            back = max(pairs, lo - pairs)
            if (d - 1) % self.steps == 0:
                states = [x[back:hi].reshape(-1, pairs) for x in (on, skip, insert, before, best)]
                top = states[-1].max(0)
                floor = (top + kind(low)).astype(kind)
                for x in states:
                    np.maximum(x, floor, out=x)
                    np.subtract(x, top, out=x)
                offset = offset + top
                taken.append(offset)
                state = np.full((4, len(states[0]) + 2, pairs), low, kind)
                for k in range(4):
                    state[k, 1:-1] = states[k]
                kept.append((back // pairs - 2, state))
            np.subtract(on[back:hi], gap, out=on[back:hi])
            np.maximum(insert[lo:hi], on[lo:hi], out=insert[lo:hi])
            new = hi + pairs if d <= n else hi  # with the next residue of the reference, before the first letter
            np.maximum(skip[lo - pairs : new - pairs], on[lo - pairs : new - pairs], out=other[lo:new])
            if new > hi and self.free_start:
                other[hi:new] = np.maximum(d - offset, low)
            worths[d - 1 - begin :].take(at[a : y + 1], axis=0, out=worth[lo:hi].reshape(-1, pairs), mode="clip")
            np.add(worth[lo:hi], before[lo - pairs : hi - pairs], out=worth[lo:hi])
            np.maximum(worth[lo:hi], insert[lo:hi], out=before[lo:hi])
            np.maximum(before[lo:hi], other[lo:hi], out=before[lo:hi])
            before[hi:new] = other[hi:new]
            on, worth, skip, other, before, best = worth, on, other, skip, best, before
            if d >= least:
                on.take(d * pairs + ends, out=last_on[d - least, :pairs], mode="clip")
                if d >= n + least:
                    last_gaps[0, d - n - least, :pairs], last_gaps[1, d - n - least, :pairs] = skip[-pairs:], insert[-pairs:]
        return _Run(kept, taken, [self._end(k, int(ms[k]) - least, int(ms[k]), last_on, last_gaps, taken) for k in range(last - first)])

    def _end(self, k: int, late: int, m: int, last_on: np.ndarray, last_gaps: np.ndarray, taken: list[np.ndarray]) -> tuple[int, int]:
        """(lane, state) with which a best alignment uses up the sequence; of equal lanes the last, of equal states too."""
        n = len(self.ref)
        d = m + np.arange(n + 1)
        known = np.array([taken[x][k] for x in range((m - 1) // self.steps, (n + m - 1) // self.steps + 1)])
        on = last_on[late : late + n + 1, k] + known[(d - 1) // self.steps - (m - 1) // self.steps] - d
        skip, insert = (int(x) + int(known[-1]) - n - m for x in last_gaps[:, late, k])
        last = n - 1 - int(on[:n][::-1].argmax())
        state = max((int(on[n]), 0), (int(on[last]) if self.free_end else skip, 1), (insert, 2))[1]
        return (last, 0) if state == 1 and self.free_end else (n, state)

    def slots(self) -> list[np.ndarray]:
        n, steps = len(self.ref), self.steps
        bounds = _batches(n, self.m)
        runs = [self.run(a, b) for a, b in bounds]
        batch, lane = (np.concatenate(x) for x in ([np.full(b - a, k) for k, (a, b) in enumerate(bounds)], [np.arange(b - a) for a, b in bounds]))
        out = [[0] * int(m) for m in self.m]
        places = [list(e) for r in runs for e in r.ends]
        left = self.m.tolist()
        letters = np.full((int(self.m[0]), len(self.m)), self.none, np.uint8)
        for k, s in enumerate(self.seqs):
            letters[: len(s), k] = s
        for block in reversed(range(-(-(n + int(self.m[0])) // steps))):
            first = block * steps
            who = [k for k, (i, _) in enumerate(places) if left[k] and i + left[k] > first]
            if not who:
                continue
            chosen = np.array(who)
            lowest = np.array([places[k][0] - steps for k in who])
            on, skip, insert = self._again(block, chosen, lowest, letters, runs, batch[chosen], lane[chosen])
            views = [memoryview(x.reshape(-1)) for x in (on, skip, insert)]
            for x, k in enumerate(who):
                i, state = places[k]
                places[k][:], left[k] = self._back(views, first, len(who), x, int(lowest[x]), i, left[k], state, out[k])
        return [np.array(o, np.int64) for o in out]

    def _again(self, block: int, chosen: np.ndarray, lowest: np.ndarray, letters: np.ndarray, runs: list[_Run], batch: np.ndarray, lane: np.ndarray) -> list[np.ndarray]:
        """On, skip and insert by step, place in the window and sequence: the steps of a block in windows from residue ``lowest``, the first step that which was kept."""
        n, steps, low, gap, kind, many = len(self.ref), self.steps, self.low, self.type(self.scoring.gap), self.type, len(chosen)
        first, width = block * steps, steps + 1
        residues = lowest + np.arange(width)[:, None]  # residue i of the reference, from 1
        on, skip, insert = out = [np.full((steps + 1, width, many), low, kind) for _ in range(3)]
        before, taken = np.full((width, many), low, kind), np.zeros(many, np.int64)
        for b in np.unique(batch).tolist():
            own = np.flatnonzero(batch == b)
            lane_of, state = runs[b].kept[block]
            rows = np.clip(residues[:, own] - lane_of, 0, state.shape[1] - 1)
            on[0][:, own], skip[0][:, own], insert[0][:, own], before[:, own] = state[:, rows, lane[own]]
            taken[own] = runs[b].taken[block][lane[own]]
        best = np.maximum(np.maximum(on[0], skip[0]), insert[0])
        coded = self.scores.shape[1] * self.ref[np.clip(residues - 1, 0, n - 1)].astype(np.intp)
        # letters that the residues of the window meet, step by step one further
        places = first - lowest - 1 - (np.arange(steps + width)[:, None] - steps)
        met = letters[np.clip(places, 0, len(letters) - 1), chosen].astype(np.intp)
        flat, index = self.scores.ravel(), np.empty((width, many), np.intp)
        worth, opened = np.empty((width, many), kind), np.empty((width, many), kind)
        fresh = self.free_start and bool((lowest + steps > first).any())
        for s in range(1, min(steps, n + int(self.m[0]) - first) + 1):
            np.add(coded, met[steps - s : steps - s + width], out=index)
            flat.take(index, out=worth, mode="clip")
            np.subtract(on[s - 1], gap, out=opened)
            np.maximum(insert[s - 1], opened, out=insert[s])
            np.maximum(skip[s - 1, :-1], opened[:-1], out=skip[s, 1:])
            np.add(before[:-1], worth[1:], out=on[s, 1:])
            if fresh:
                w = first + s - lowest
                new = np.flatnonzero((w >= 0) & (w < width))
                on[s, w[new], new] = insert[s, w[new], new] = low
                skip[s, w[new], new] = np.maximum(first + s - taken[new], low)
            np.maximum(on[s], insert[s], out=before)
            np.maximum(before, skip[s], out=before)
            before, best = best, before
        return out

    def _back(self, views: list[memoryview], first: int, many: int, x: int, lowest: int, i: int, j: int, state: int, where: list[int]) -> tuple[tuple[int, int], int]:
        """The walk of a sequence down to step ``first``; state 3 is what is best where it arrives."""
        on, skip, insert = views
        gap, width = self.scoring.gap, self.steps + 1
        matched, skipped, inserted = (2 * width + 1) * many, (width + 1) * many, width * many
        at, end = ((i + j - first) * width + i - lowest) * many + x, width * many  # from there on steps come after the first
        while at >= end and j:
            if state == 3:
                a, b, c = on[at], skip[at], insert[at]
                state = 0 if a >= b and a >= c else 1 if b >= c else 2
            if state == 0:
                j -= 1
                where[j] = 2 * i - 1
                i -= 1
                at -= matched
                state = 3
            elif state == 1:
                i -= 1
                at -= skipped
                state = 1 if skip[at] > on[at] - gap else 0
            else:
                j -= 1
                where[j] = 2 * i
                at -= inserted
                state = 2 if insert[at] > on[at] - gap else 0
        return (i, state), j


def _batches(n: int, m: np.ndarray) -> list[tuple[int, int]]:
    """Sequences that are stepped through together, the longest first."""
    out, at = [], 0
    while at < len(m):
        most = max(1, CELLS // (min(n, int(m[at])) + 2))
        most -= most % 8 if most > 8 else 0
        out.append((at, min(len(m), at + most)))
        at = out[-1][1]
    return out


def slots(scoring: Scoring, ref: np.ndarray, seqs: Sequence[np.ndarray], free_start: bool = True, free_end: bool = True) -> list[np.ndarray]:
    """The slots of each sequence (see ``gotoh``) in its whole table; letters are codes, and neither side is empty."""
    order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
    at, n = 0, len(ref)
    each = [16 * (min(n, len(seqs[k])) + 4) * (n + len(seqs[k])) for k in order]  # bytes of states, if each step were kept
    while at < len(order):
        steps = LEAST_STEPS
        while steps < MOST_STEPS and each[at] > KEPT // 4 * steps:
            steps *= 2
        some = order[at : at + max(1, min(TOGETHER, int(np.searchsorted(np.cumsum(each[at : at + TOGETHER]), KEPT * steps, "right"))))]
        for k, where in zip(some, _Group(scoring, ref, [seqs[k] for k in some], free_start, free_end, steps).slots(), strict=True):
            out[k] = where
        at += len(some)
    return out


class Band(NamedTuple):
    """A pair whose best alignments keep to diagonals (reference minus sequence) ``low`` to ``high``, and whether residues of the reference before and after the sequence are free."""

    ref: np.ndarray
    seq: np.ndarray
    low: int
    high: int
    free_start: bool
    free_end: bool


def _banded(scoring: Scoring, bands: Sequence[Band]) -> list[np.ndarray]:
    """The slots of pairs that are stepped through together. Diagonals are lanes, every other one has a cell on an antidiagonal; all states are kept."""
    many, most = len(bands), max(len(b.seq) for b in bands)
    half = (max(b.high - b.low for b in bands) + 2) // 2  # lanes of a step, of which the first is diagonal low or the next
    low, kind = (LOW, np.int16) if 32 * half + 1000 <= -LOW else (LONG_LOW, np.int32)
    gap, last = kind(scoring.gap), 2 * most + 2 * half - 1
    lows, free = np.array([b.low for b in bands]), np.array([b.free_start for b in bands])
    scores = np.pad((scoring.table + 2).astype(kind), ((0, 1), (0, 1)))  # beside the letters numbers neither rise nor fall
    # at step s, lane k of parity p is residue (s + p) / 2 + k + low of the reference and letter (s - p) / 2 - k
    refs = np.full((last // 2 + half + 2, many), len(scores) - 1, np.intp)
    seqs = np.full((last // 2 + half + 1, many), scores.shape[1] - 1, np.intp)
    for x, b in enumerate(bands):
        own = b.ref[: max(0, len(refs) + b.low - 1)]
        refs[1 - b.low : 1 - b.low + len(own), x] = own
        seqs[last // 2 - len(b.seq) : last // 2, x] = b.seq[::-1]
    refs *= scores.shape[1]
    on, skip, insert = (np.empty((last + 1, half + 2, many), kind) for _ in range(3))
    for x in (on, skip, insert):
        x[:, 0] = x[:, -1] = low
    worth, index = np.empty((half, many), kind), np.empty((half, many), np.intp)
    on_, skip_, insert_, best, before = (np.full((half + 2, many), low, kind) for _ in range(5))
    taken, flat = [np.zeros(many, np.int64)], scores.ravel()
    for s in range(last + 1):
        odd, new = s % 2, (on[s], skip[s], insert[s])
        if s and s % LEAST_STEPS == 0:
            top = np.maximum(best, before).max(0)
            top[top < low // 2] = 0
            floor = (top + kind(low)).astype(kind)
            on_, skip_, insert_, best, before = (np.maximum(x, floor) - top for x in (on_, skip_, insert_, best, before))
            taken.append(taken[-1] + top)
        opened = on_ - gap
        a, b = (slice(2, None), slice(1, -1)) if odd else (slice(1, -1), slice(None, -2))
        np.maximum(insert_[a], opened[a], out=new[2][1:-1])
        np.maximum(skip_[b], opened[b], out=new[1][1:-1])
        x, y = (s + odd) // 2, last // 2 - (s - odd) // 2
        np.add(refs[x : x + half], seqs[y : y + half], out=index)
        flat.take(index, out=worth, mode="clip")
        np.add(before[1:-1], worth, out=new[0][1:-1])
        if s < 2 * half:  # the lane that is before the first letter
            k, i = s // 2 + 1, s + lows
            new[0][k] = np.where(i == 0, np.maximum(-taken[-1], low), low)
            new[1][k] = np.where((i > 0) & free, np.maximum(i - taken[-1], low), np.where(i > 0, new[1][k], low))
            new[2][k] = low
        np.maximum(new[0][1:-1], new[2][1:-1], out=before[1:-1])
        np.maximum(before[1:-1], new[1][1:-1], out=before[1:-1])
        best, before = before, best
        on_, skip_, insert_ = new
    return [_walked(scoring.gap, b, x, half, taken, (on, skip, insert)) for x, b in enumerate(bands)]


def _walked(gap: int, band: Band, x: int, half: int, taken: list[np.ndarray], states: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The way back of a pair from where it uses up the sequence."""
    n, m, many = len(band.ref), len(band.seq), states[0].shape[2]
    lanes = np.arange(max(0, -band.low - m), n - m - band.low + 1)  # of residues up to the last of the reference
    s = 2 * m + lanes
    ends, skips, inserts = (a[s, lanes // 2 + 1, x] + np.array([taken[t][x] for t in (s // LEAST_STEPS).tolist()]) for a in states)
    ends, skipped, inserted = ends - s - band.low, int(skips[-1]) - int(s[-1]) - band.low, int(inserts[-1]) - int(s[-1]) - band.low
    some = len(ends) > 1
    best = len(ends) - 2 - int(ends[:-1][::-1].argmax()) if some else 0
    if band.free_end:
        skipped = int(ends[best]) if some else LONG_LOW
    state = max((int(ends[-1]), 0), (skipped, 1), (inserted, 2))[1]
    lane = int(lanes[-1])
    if state == 1 and band.free_end:
        lane, state = int(lanes[best]), 0
    on, skip, insert = (memoryview(a.reshape(-1)) for a in states)
    row = (half + 2) * many
    i, j, step = m + lane + band.low, m, 2 * m + lane
    at, where = (step * (half + 2) + lane // 2 + 1) * many + x, [0] * m
    while j:
        if state == 3:
            a, b, c = on[at], skip[at], insert[at]
            state = 0 if a >= b and a >= c else 1 if b >= c else 2
        if state == 0:
            j -= 1
            where[j] = 2 * i - 1
            i -= 1
            step -= 2
            at -= 2 * row
            state = 3
        elif state == 1:
            i -= 1
            at -= row if step % 2 else row + many
            step -= 1
            state = 1 if skip[at] > on[at] - gap else 0
        else:
            j -= 1
            where[j] = 2 * i
            at -= row - many if step % 2 else row
            step -= 1
            state = 2 if insert[at] > on[at] - gap else 0
    return np.array(where, np.int64)


def banded(scoring: Scoring, bands: Sequence[Band]) -> list[np.ndarray]:
    """The slots of each pair, as its whole table gives them; neither side is empty."""
    order = sorted(range(len(bands)), key=lambda k: (-len(bands[k].seq), bands[k].low))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bands)
    at = 0
    while at < len(order):
        first, end = bands[order[at]], at + 1
        width = first.high - first.low + 2
        while end < len(order):
            more = bands[order[end]]
            wider = max(width, more.high - more.low + 2)
            # three states of two bytes a cell; no pair has more than some cells that it doesn't need
            if (end - at + 1) * wider * (len(first.seq) + wider) * 6 > KEPT // 2 or 2 * len(more.seq) < len(first.seq) or wider > 2 * (more.high - more.low + 2) + 32 or wider > 2 * width + 32:
                break
            width, end = wider, end + 1
        for k, where in zip(order[at:end], _banded(scoring, [bands[k] for k in order[at:end]]), strict=True):
            out[k] = where
        at = end
    return out
