"""Near duplicates by BagMinHash signatures of word shingles as multisets.

Signature: a shingle of weight w (its number of occurrences) runs Poisson
processes over slots and weight levels. The levels are discretised to the
integers and split into dyadic blocks 1, 2-3, 4-7, ...; each block has one
process for all its levels, whose points above w are thinned out, so a shingle
costs as many processes as w has binary digits. The earliest point of each slot
is its signature: two texts agree in a slot with probability
``sum(min(w)) / sum(max(w))``, without bias.
"""

from __future__ import annotations

import re

import numpy as np

from .shared import mix64

#: Words of a shingle and the least similarity of near duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS

_HASH_BITS = 44
_SPREAD = np.float64(5.0)  # expected empty slots per text before a retry: exp(-5)


def _word_table() -> np.ndarray:
    """Lower case of the bytes of words (ASCII letters, digits, underscore, anything above 127); 0 for all others.

    Right for texts whose characters above 127 are the letters of Latin-1; ``plain_words`` makes others such.
    """
    table = np.zeros(256, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[48:58], table[95] = np.arange(48, 58), 95
    table[128:] = np.arange(128, 256)
    return table


_WORD = _word_table()
_PLACES = mix64(np.arange(1, 1 << 12, dtype=np.uint64))
_UNICODE_WORD = re.compile(r"\w+")
_SHINGLE = mix64(np.arange(101, 101 + SHINGLE_WORDS, dtype=np.uint64)) | np.uint64(1)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, where those with characters above 127 other than Latin-1's letters are given as their words in lower case.

    Words are there the runs of what Unicode calls letters, numbers or underscores.
    """
    # lead bytes of other characters, and the signs of multiplication and division
    other = (data >= 0xC4) | (data == 0xC2)
    other[1:] |= ((data[1:] == 0x97) | (data[1:] == 0xB7)) & (data[:-1] == 0xC3)
    where = np.flatnonzero(other)
    if not len(where):
        return data, offsets
    sizes, parts, end = np.diff(offsets), [], 0
    for doc in np.unique(np.searchsorted(offsets, where, side="right") - 1):
        text = data[offsets[doc] : offsets[doc + 1]].tobytes().decode(errors="replace")
        words = np.frombuffer(" ".join(_UNICODE_WORD.findall(text)).lower().encode(), np.uint8)
        parts += [data[end : offsets[doc]], words]
        end, sizes[doc] = offsets[doc + 1], len(words)
    return np.concatenate([*parts, data[end:]]), np.r_[0, np.cumsum(sizes)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text and in all) of concatenated texts.

    A word is a run of Unicode's letters and numbers and of underscores, in lower case.
    """
    data, offsets = plain_words(data, offsets)
    docs = len(offsets) - 1
    starts = offsets[:-1] + np.arange(docs)
    z = np.zeros(len(data) + docs, np.uint8)
    where = np.ones(len(z), bool)
    where[offsets[1:] + np.arange(docs)] = False
    z[where] = _WORD[data]
    latin = np.flatnonzero((z[1:] >= 0x80) & (z[1:] <= 0x9E) & (z[1:] != 0x97) & (z[:-1] == 0xC3)) + 1
    z[latin] += 0x20
    solid = z > 0
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    first = np.flatnonzero(head[at])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    factor = _PLACES[place] if place.max() < len(_PLACES) else mix64(place.astype(np.uint64) + np.uint64(1))
    hashes = mix64(np.add.reduceat(z[at].astype(np.uint64) * factor, first))
    return hashes, np.r_[np.searchsorted(at[first], starts), len(first)]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each shingle, text of each) in the order of the texts.

    A text of fewer words than a shingle has one shingle of all its words; one without words has none.
    """
    words, bounds = word_hashes(data, offsets)
    n = np.diff(bounds)
    count = np.where(n >= SHINGLE_WORDS, n - SHINGLE_WORDS + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    before = np.cumsum(count) - count
    start = bounds[:-1][doc] + np.arange(len(doc)) - before[doc]
    last = bounds[1:][doc]
    total = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE_WORDS):
        inside = start + k < last
        total += np.where(inside, words[np.minimum(start + k, len(words) - 1)] if len(words) else 0, 0).astype(np.uint64) * _SHINGLE[k]
    return mix64(total), doc


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences), sorted, with shingles cut to 44 bits; at most 2**20 texts at once."""
    hashes, doc = shingle_hashes(data, offsets)
    keys = np.sort((doc.astype(np.uint64) << np.uint64(_HASH_BITS)) | (hashes >> np.uint64(64 - _HASH_BITS)))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    return (keys >> np.uint64(_HASH_BITS)).astype(np.int64), keys & np.uint64((1 << _HASH_BITS) - 1), weight


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """(docs, SLOTS) array of 16-bit signatures; all zeros for a text without shingles.

    Each text's processes run up to a time by which every slot has a point with
    high probability; texts with an empty slot run on to thrice that time.
    """
    out = np.zeros((docs, SLOTS), np.uint16)
    mass = np.bincount(doc, weight, minlength=docs)
    # one process for each dyadic block that the weight reaches
    blocks = np.frexp(weight.astype(np.float64))[1]
    element = np.repeat(np.arange(len(doc)), blocks)
    block = np.arange(len(element)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    seed = mix64(shingle[element] + (block.astype(np.uint64) << np.uint64(50)) + np.uint64(0x9E3779B97F4A7C15))
    todo = mass > 0
    horizon = (np.log(SLOTS) + _SPREAD) / np.maximum(mass, 1)
    while todo.any():
        active = np.flatnonzero(todo[doc[element]])
        best = np.full(docs * SLOTS, np.iinfo(np.uint64).max)
        of_doc, width = doc[element[active]], np.float64(2.0) ** block[active]
        _run(best, seed[active], of_doc, width, weight[element[active]], horizon[of_doc])
        best = best.reshape(docs, SLOTS)
        full = todo & (best != np.iinfo(np.uint64).max).all(1)
        out[full] = best[full].astype(np.uint16)  # the low bits are those of the point
        todo &= ~full
        horizon = horizon * 3
    return out


def _run(best: np.ndarray, seed: np.ndarray, doc: np.ndarray, width: np.ndarray, weight: np.ndarray, horizon: np.ndarray) -> None:
    """Points of all processes up to their horizon; ``best`` keeps the earliest of each slot as time bits and point bits."""
    rate = SLOTS * width
    now = np.zeros(len(seed))
    step = np.uint64(0)
    while len(seed):
        # few processes left: several points of each at once
        k = int(np.clip(100_000 // len(seed), 1, 64))
        bits = mix64(seed[:, None] + (step + np.arange(1, k + 1, dtype=np.uint64)) * np.uint64(0xD1342543DE82EF95))
        step += np.uint64(k)
        time = now[:, None] + np.cumsum(-np.log(_uniform(bits)), axis=1) / rate[:, None]
        point = mix64(bits ^ np.uint64(0xA5A5A5A55A5A5A5A))
        level = width[:, None] + np.floor(_uniform(point) * width[:, None])
        ok = (time < horizon[:, None]) & (level <= weight[:, None])
        slot = (point & np.uint64(SLOTS - 1)).astype(np.int64)
        where = (doc[:, None] * SLOTS + slot)[ok]
        early = time[ok].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        np.minimum.at(best, where, early | (mix64(point[ok]) >> np.uint64(32)))
        going = time[:, -1] < horizon
        seed, doc, width, weight, horizon, rate, now = (x[going] for x in (seed, doc, width, weight, horizon, rate, time[:, -1]))


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(docs, BANDS) 64-bit keys: the slots of a band, mixed with its number."""
    packed = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS)
    return mix64(packed + mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as (sorted shingles, occurrences); 0 if either is empty."""
    (x, n), (y, m) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    common = int(np.minimum(n[hit], m[at[hit]]).sum())
    return common / (int(n.sum()) + int(m.sum()) - common)
