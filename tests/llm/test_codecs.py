"""WARC, PNG, BPE and packing: round trips and definitions."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwell.llm import bpe, media, packing, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


# ---------------------------------------------------------------- WARC


def test_archives(spark):
    big = "<p>" + "x" * 300_000 + "é</p>"
    rows = [(1, "u\r\n1", big), (2, None, big), (3, "u3", None), (4, "u4", ""), (5, "u5", "s" * 999), (6, "u6", "s" * 999), (7, "u7", "t" * 1000), (8, "u8", "t" * 1000), (None, "u", "t" * 1000), (9, "u9", "WARC/1.1\r\n\r\n" * 200)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, n long, digest string").repartition(3)
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()}
    want = set()
    for key, _, html in rows:
        raw = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == raw and k is not None]
        again = len(raw) >= 1000 and key != max(same)
        want.add((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert got == want
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_chunks_are_incremental(spark):
    body = bytes(random.Random(1).randrange(256) for _ in range(200_000))
    record = b"".join(warc._record("response", 1, "u", body, hashlib.sha1(body).digest(), None, warc.DATE))
    for data in (record * 2, zlib.compress(record, wbits=31) * 2):
        chunks = list(warc.iterate_chunks(io.BytesIO(data), 1000))
        for number in (0, 1):
            own = [c for c in chunks if c[0] == number]
            assert b"".join(c[5] for c in own) == body and max(len(c[5]) for c in own) == 1000
            assert all(c[6] == hashlib.sha1(body[: c[4] + len(c[5])]).hexdigest() for c in own[::37]) and [c[7] for c in own].count(True) == 1
    for bad in (record[:-10], zlib.compress(record, wbits=31)[:-9]):
        with pytest.raises(ValueError, match="truncated|end mark|without"):
            list(warc.iterate_chunks(io.BytesIO(bad)))


# ---------------------------------------------------------------- PNG


def png(samples, kinds):
    """A PNG whose rows use the given filters, from the definitions."""
    height, width, step = samples.shape
    rows, raw = samples.reshape(height, width * step).astype(int), b""
    for y in range(height):
        line = []
        for x in range(width * step):
            a = rows[y, x - step] if x >= step else 0
            b = rows[y - 1, x] if y else 0
            c = rows[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((rows[y, x] - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
        raw += bytes([kinds[y], *line])
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    return media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + media._chunk(b"tEXt", b"a\0b") + b"".join(media._chunk(b"IDAT", part) for part in (zlib.compress(raw)[:7], zlib.compress(raw)[7:])) + media._chunk(b"IEND", b"")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.randoms(use_true_random=False))
def test_every_filter(height, width, step, rng):
    samples = np.array([rng.randrange(256) for _ in range(height * width * step)], np.uint8).reshape(height, width, step)
    want = samples[..., 0] if step == 1 else samples
    assert (media.decode_png(png(samples, [rng.randrange(5) for _ in range(height)])) == want).all()
    assert (media.decode_png(media.encode_png(samples)) == want).all()


def test_damage_is_found():
    good = media.encode_png(np.arange(192 * 4, dtype=np.uint8).reshape(4, 192))
    for at in (3, 20, 45, len(good) - 2):
        with pytest.raises(ValueError):
            media.decode_png(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(good[:-4])


def test_hash_of_like_images():
    """A picture of many low frequencies, with a little noise and in another size, against another picture."""
    rng = np.random.default_rng(1)
    grid = np.linspace(0, 3, 96)

    def picture(seed, step=1):
        weights = np.random.default_rng(seed).normal(size=(6, 6))
        waves = np.cos(np.outer(np.arange(6), grid[::step]))
        values = waves.T @ weights @ waves
        return ((values - values.min()) / np.ptp(values) * 240).astype(np.uint8)

    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    one, other = picture(1), picture(2)
    for like in (one + rng.integers(0, 4, one.shape).astype(np.uint8), picture(1, 2)):
        assert (bits(one) != bits(like)).sum() <= 12 < (bits(one) != bits(other)).sum()


def test_media(odd, empty):
    texts = {}
    for r in media.media_features(odd).collect():
        texts.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["n_bytes"], r["tail_crc32"]))
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] - r["n_bytes"] <= 192
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert hashlib.sha256(padded).hexdigest() in texts
    assert media.media_features(empty).count() == 0


# ---------------------------------------------------------------- BPE

PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "é", "ß", "漢字", "1", "23", "!", "...", " ", "\x1c", "\x85", "<|endoftext|>", "😀", "é", "Σ", " x", "\0", "\r\n", "hello", "ing", "٣", "The", "İ", "²"]
mixed = st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.SpeculativeBPE(BYTES)


@settings(max_examples=150, deadline=None)
@given(mixed)
def test_bpe_is_the_librarys(vocabulary, text):
    text = text.encode("utf-8", "ignore").decode()
    library = Tokenizer.from_file(BYTES)
    ids = vocabulary.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_parts(vocabulary, monkeypatch):
    text = " ".join(f"word{i}" for i in range(400)) + "\n\n   tail  "
    whole = vocabulary.encode(text)
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 50)
    assert vocabulary.encode(text) == whole and vocabulary.decode(whole) == text
    assert vocabulary.failed < vocabulary.verified


def test_round_trip(odd, empty):
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(odd, BYTES).collect())) == want
    assert bpe.round_trip(empty, BYTES).count() == 0
    encoded = bpe.encode_documents(odd.where("doc_id IS NOT NULL"), BYTES)
    assert {(r["doc_id"], r["text"]) for r in bpe.decode_documents(encoded, BYTES).collect()} == {(r["doc_id"], r["text"] or "") for r in odd.collect() if r["doc_id"] is not None}


# ---------------------------------------------------------------- packing


@settings(max_examples=100, deadline=None)
@given(mixed)
def test_chunk_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing._encoder(WORDS).encode(text), "<u4").tolist() == want


@pytest.mark.parametrize(("seed", "n", "scale", "top"), [(1, 30, 1, 2048), (2, 600, 1, 2048), (3, 400, 50, 2048), (4, 300, 3, 700), (5, 200, 1, 60), (6, 0, 1, 10)])
def test_plan_is_near_the_bound(seed, n, scale, top):
    rng = random.Random(seed)
    histogram = Counter(min(top, int(rng.lognormvariate(5, 1.2)) + 1) for _ in range(n))
    histogram = {k: v * scale for k, v in histogram.items()}
    plan = packing.plan_packing(histogram)
    held = Counter()
    for config, copies in plan.configs:
        assert sum(a * b for a, b in config) <= 2048
        for length, k in config:
            held[length] += k * copies
    assert held == Counter(histogram)
    assert plan.lower_bound <= plan.sequences <= plan.lower_bound * 1.01 + 1


def test_plan_of_halves():
    """Pieces over half a sequence stand alone; the area bound is not reached."""
    plan = packing.plan_packing({1100: 50, 900: 50, 30: 3})
    assert plan.sequences == 50


@pytest.mark.parametrize(("mean", "spread", "within"), [(5.5, 1.0, 1.0005), (6.5, 0.7, 1.005), (3.0, 1.5, 1.0005)])
def test_plan_of_smooth_histograms(mean, spread, within):
    """What is left to best fit depends on the configurations, not on the number of pieces; it is less than one copy of each."""
    drawn = np.bincount(np.exp(np.random.default_rng(0).normal(mean, spread, 500_000)).astype(int).clip(1, 2048), minlength=2049)
    for scale in (0.2, 200):
        histogram = {k: round(n * scale) for k, n in enumerate(drawn.tolist()) if round(n * scale)}
        plan = packing.plan_packing(histogram)
        held = Counter()
        for config, copies in plan.configs:
            for length, k in config:
                held[length] += k * copies
        assert held == Counter(histogram)
        assert plan.sequences <= plan.lower_bound * within + 1
        assert plan.fitted <= plan.priced * max(1, 2048 // (4 * np.exp(mean)))


def test_pack(spark, odd, empty):
    library = Tokenizer.from_file(WORDS)
    out = packing.pack(odd, WORDS).collect()
    want = Counter()
    for r in odd.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, i in enumerate(range(0, len(ids), 2048)):
            part = ids[i : i + 2048]
            want[r["doc_id"], k, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in out) // 2048) + 2
    assert packing.pack(empty, WORDS).count() == 0
