"""Greedy selections over edit distance; each call handles one group."""

from __future__ import annotations

import hashlib

import numpy as np


def encode(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, padded with zeros, and lengths."""
    sizes = np.array([len(s) for s in seqs], np.int64)
    out = np.zeros((len(seqs), max(1, sizes.max(initial=0))), np.int32)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = [ord(c) for c in s]
    return out, sizes


def edit_distances(one: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edit distance of one sequence from all of an encoded group: a table row for each of its letters, all others at once."""
    width = codes.shape[1]
    steps = np.arange(width + 1)
    row = np.broadcast_to(steps, (len(codes), width + 1)).copy()
    for i, letter in enumerate(one, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (codes != letter))
        # insertions run along the row: a prefix minimum after taking off the slope
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[np.arange(len(codes)), sizes]


def identities(one: int, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    longest = np.maximum(sizes, sizes[one])
    distance = edit_distances(codes[one, : sizes[one]], codes, sizes)
    return np.where(longest == 0, 1.0, 1 - distance / np.maximum(longest, 1))


def farthest(seqs: list[str], n: int, seed: int) -> list[int]:
    """Places of n sequences (all, if fewer): the one of least digest with the seed, then always that whose nearest pick is farthest from it, the first of equals.

    The first one is the same however the sequences are dealt out and ordered.
    """
    if n <= 0 or not seqs:
        return []
    codes, sizes = encode(seqs)
    digests = [hashlib.sha256(f"{seed}:{s}".encode()).digest() for s in seqs]
    order, gap = [min(range(len(seqs)), key=digests.__getitem__)], np.full(len(seqs), np.inf)
    for _ in range(min(n, len(seqs)) - 1):
        gap = np.minimum(gap, 1 - identities(order[-1], codes, sizes))
        gap[order[-1]] = -np.inf
        order.append(int(gap.argmax()))
    return order


def seriate(seqs: list[str]) -> list[int]:
    """An order in which each follows its nearest, from the one that is farthest from all others on average."""
    if len(seqs) < 3:
        return list(range(len(seqs)))
    codes, sizes = encode(seqs)
    alike = np.stack([identities(i, codes, sizes) for i in range(len(seqs))])
    order = [int(alike.sum(1).argmin())]
    left = np.ones(len(seqs), bool)
    left[order[0]] = False
    while left.any():
        row = np.where(left, alike[order[-1]], -1)
        order.append(int(row.argmax()))
        left[order[-1]] = False
    return order
