"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks; a bidirectional LSTM reads their sequence (the
hashed path of elements around each, its hashed words, its shape and place) and
labels every block with all of the page in view. Blocks labelled as the article
are joined. The network is learned from texts of a bounded sample of pages, set
into invented layouts whose labels are known.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import PATH, TAGS, Block, blocks
from .html_layouts import labelled_pages
from .shared import clean_text, mix64, pieces, release_memory

#: Pages whose texts are learned from, at most, taken in the order of a hash of their key; longer ones are not learned from.
SAMPLE_PAGES, SAMPLE_CHARS = 200, 50_000
#: Invented pages, and passes over them.
LAYOUTS, EPOCHS = 2400, 8
WORDS, SHAPE, HIDDEN = 48, 10, 24
FEATURES = PATH + TAGS + WORDS + SHAPE
#: Cells (blocks by pages) that are looked at together; a longer page is read in windows of so many blocks.
CELLS = 16_384
_SPACE = 32


def _word_bins(texts: list[str]) -> np.ndarray:
    """How often words fall into each of ``WORDS`` bins, a line for each text, dampened."""
    data = np.frombuffer("\n".join(texts).lower().encode(), np.uint8)
    solid = data > _SPACE
    starts = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    out = np.zeros((len(texts), WORDS), np.float32)
    if not len(starts):
        return out
    ends = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
    size = ends - starts
    byte = np.concatenate([[0], np.cumsum(size)])
    inside = np.repeat(starts - byte[:-1], size) + np.arange(byte[-1])
    place = (inside - np.repeat(starts, size)).astype(np.uint64)
    hashes = mix64(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * mix64(place + np.uint64(1)), byte[:-1]))
    lines = np.concatenate([[0], np.cumsum(data == 10)])[starts]
    counts = np.bincount(lines * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=len(texts) * WORDS)
    return (0.5 * np.log1p(counts)).reshape(len(texts), WORDS).astype(np.float32)


def block_features(part: Sequence[Block], first: int, total: int) -> np.ndarray:
    """A line for each block; ``first`` is the place of the first one among the page's ``total``."""
    n = len(part)
    out = np.zeros((n, FEATURES), np.float32)
    if not n:
        return out
    bits = np.frombuffer(b"".join(b.path.to_bytes(PATH // 8, "little") for b in part), np.uint8).reshape(n, -1)
    out[:, :PATH] = np.unpackbits(bits, axis=1, bitorder="little")
    out[np.arange(n), PATH + np.array([b.tag for b in part])] = 1
    texts = [b.text for b in part]  # blocks hold no line ends
    out[:, PATH + TAGS : PATH + TAGS + WORDS] = _word_bins(texts)
    at = np.arange(first, first + n)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts])
    chars, words = np.array([len(t) for t in texts]), np.array([t.count(" ") + 1 for t in texts])
    shape = [np.log1p(chars) / 6, np.log1p(words) / 4, np.array([b.linked for b in part]), np.minimum(stops / words, 1), words >= 20, words <= 3]
    shape += [np.array([t[-1] in ".!?:;\"”»。" for t in texts]), np.array(["©" in t for t in texts]), np.log1p(at) / 4, np.log1p(total - 1 - at) / 4]
    out[:, PATH + TAGS + WORDS :] = np.stack(shape, 1)
    return out


# ---------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _cell(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gates (input, forget, output, candidate), new state and its hyperbolic tangent."""
    gates = _sigmoid(z[:, : 3 * HIDDEN])
    new = np.tanh(z[:, 3 * HIDDEN :])
    c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * new
    return gates, new, c, np.tanh(c)


@dataclass
class BlockLabeller:
    """Parameters: for each direction d, input weights wd, recurrent weights ud, offsets bd and output weights od; offset ``o`` of the output."""

    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, seed: int) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        p = {"o": np.zeros(1, np.float32)}
        for d in "fb":
            p["w" + d] = rng.normal(0, FEATURES**-0.5, (FEATURES, 4 * HIDDEN)).astype(np.float32)
            p["u" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            p["b" + d] = np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)  # remember, at first
            p["o" + d] = rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)
        return cls(p)

    # -- all blocks of some pages, in windows

    def _read(self, pages: Sequence[Sequence[Block]], d: str, window: int) -> list[np.ndarray]:
        """What one direction adds to each block's score. ``pages`` stand from the longest to the shortest."""
        sizes = np.array([len(x) for x in pages])
        out = [np.zeros(n, np.float32) for n in sizes]
        h = c = np.zeros((len(pages), HIDDEN), np.float32)
        for t0 in range(0, int(sizes.max(initial=0)), window):
            open_ = int((sizes > t0).sum())
            spans = [(t0, min(t0 + window, n)) for n in sizes[:open_]]
            if d == "f":
                xs = [block_features(pages[k][a:b], a, sizes[k]) for k, (a, b) in enumerate(spans)]
            else:
                xs = [block_features(pages[k][sizes[k] - b : sizes[k] - a], sizes[k] - b, sizes[k])[::-1] for k, (a, b) in enumerate(spans)]
            z = np.concatenate(xs) @ self.p["w" + d] + self.p["b" + d]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in xs])])[:-1]
            for t in range(t0, t0 + max(len(x) for x in xs)):
                live = int((sizes > t).sum())
                gates, _, c, tc = _cell(z[starts[:live] + t - t0] + h[:live] @ self.p["u" + d], c[:live])
                h = gates[:, 2 * HIDDEN :] * tc
                for k, s in enumerate((h @ self.p["o" + d]).tolist()):
                    out[k][t if d == "f" else sizes[k] - 1 - t] = s
        return out

    def scores(self, pages: Sequence[Sequence[Block]]) -> list[np.ndarray]:
        """Probability that each block belongs to the article."""
        order = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        i = 0
        while i < len(order):
            longest = max(1, len(pages[order[i]]))
            some = order[i : i + max(1, CELLS // longest)]
            own = [pages[k] for k in some]
            window = max(1, min(longest, CELLS // len(some)))
            for k, f, b in zip(some, self._read(own, "f", window), self._read(own, "b", window), strict=True):
                out[k] = _sigmoid(f + b + self.p["o"][0])
            i += len(some)
        return out

    # -- learning

    def _forward(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list[tuple]]:
        h = c = np.zeros((x.shape[1], HIDDEN), x.dtype)
        z, kept, hs = x @ self.p["w" + d] + self.p["b" + d], [], []
        for t in range(len(x)):
            before = h, c
            gates, new, c, tc = _cell(z[t] + h @ self.p["u" + d], c)
            h = gates[:, 2 * HIDDEN :] * tc
            kept.append((*before, gates, new, tc))
            hs.append(h)
        return np.stack(hs), kept

    def _backward(self, x: np.ndarray, kept: list[tuple], to_h: np.ndarray, d: str) -> dict[str, np.ndarray]:
        dh = dc = np.zeros_like(kept[0][0])
        dz = np.zeros((*x.shape[:2], 4 * HIDDEN), x.dtype)
        for t in reversed(range(len(x))):
            _, before, gates, new, tc = kept[t]
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            dh = dh + to_h[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], 1)
            dh, dc = dz[t] @ self.p["u" + d].T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        hs = np.stack([k[0] for k in kept]).reshape(-1, HIDDEN)
        return {"w" + d: x.reshape(-1, FEATURES).T @ flat, "u" + d: hs.T @ flat, "b" + d: flat.sum(0)}

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks of some pages and its gradient. ``x`` is (block, page, feature), ``y`` (block, page); pages end after ``sizes`` blocks."""
        at = np.arange(len(x))[:, None]
        inside = at < sizes[None, :]
        back = np.where(inside, sizes[None, :] - 1 - at, at)  # each page from its end; what follows it stays
        pages = np.arange(x.shape[1])[None, :]
        xb = x[back, pages]
        (hf, kf), (hb, kb) = self._forward(x, "f"), self._forward(xb, "b")
        logit = hf @ self.p["of"] + (hb @ self.p["ob"])[back, pages] + self.p["o"][0]
        n = inside.sum()
        loss = float((np.logaddexp(0, logit) - y * logit)[inside].sum() / n)
        g = np.where(inside, _sigmoid(logit) - y, 0).astype(x.dtype) / x.dtype.type(n)
        gb = g[back, pages]
        grads = {"o": np.array([g.sum()], x.dtype), "of": np.einsum("tp,tph->h", g, hf), "ob": np.einsum("tp,tph->h", gb, hb)}
        grads |= self._backward(x, kf, g[:, :, None] * self.p["of"], "f") | self._backward(xb, kb, gb[:, :, None] * self.p["ob"], "b")
        return loss, grads

    @classmethod
    def fit(cls, pages: Sequence[tuple[list[Block], list[int]]], epochs: int = EPOCHS, batch: int = 32, rate: float = 8e-3, seed: int = 5) -> BlockLabeller:
        """By Adam, on pages of like lengths together. Names of elements are hidden at random, so that context must do."""
        rng = np.random.default_rng(seed)
        model = cls.start(seed)
        pages = [(block_features(b, 0, len(b)), np.array(y, np.float32)) for b, y in pages if b]
        m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
        batches = -(-len(pages) // batch)
        step, last = 0, epochs * batches
        for _ in range(epochs):
            mixed = sorted(range(len(pages)), key=lambda k: len(pages[k][1]) + rng.random() * 8)
            for number in rng.permutation(batches):
                chosen = [pages[k] for k in mixed[number * batch : (number + 1) * batch]]
                sizes = np.array([len(y) for _, y in chosen])
                x = np.zeros((sizes.max(), len(chosen), FEATURES), np.float32)
                y = np.zeros(x.shape[:2], np.float32)
                for k, (xs, ys) in enumerate(chosen):
                    x[: len(ys), k], y[: len(ys), k] = xs, ys
                hidden = rng.random((len(chosen), PATH + TAGS)) < 0.1 * rng.integers(0, 3, (len(chosen), 1))
                x[:, :, : PATH + TAGS] *= ~hidden
                _, grads = model.gradient(x, sizes, y)
                step += 1
                now = rate * (1 - (step - 1) / last)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    model.p[k] = (model.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return model


# ---------------------------------------------------------------- pages


def _fitted(layouts: int, epochs: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled = [b for batch in batches for html in batch.column(0).to_pylist() for b in blocks(html)]
        model = BlockLabeller.fit(labelled_pages(sampled, layouts, seed), epochs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.p)], pa.binary())], names=["model"])
        release_memory()

    return run


def fit_labeller(pages: DataFrame, key: str = "page_id", html: str = "html", layouts: int = LAYOUTS, epochs: int = EPOCHS, seed: int = 42) -> BlockLabeller:
    """Learn from texts of at most ``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters, in one task; without any, from invented texts alone."""
    sample = pages.select(F.col(key).cast("string").alias("k"), clean_text(html).alias("html")).where((F.length("html") <= SAMPLE_CHARS) & (F.length("html") > 0))
    chosen = sample.orderBy(F.xxhash64("k"), "k", "html").limit(SAMPLE_PAGES).select("html").coalesce(1)
    fitted = chosen.mapInArrow(_fitted(layouts, epochs, seed), "model binary").first()
    if fitted is None:  # no page to learn from
        fitted = pages.sparkSession.range(1).select(F.lit("").alias("html")).mapInArrow(_fitted(layouts, epochs, seed), "model binary").first()
    return BlockLabeller(pickle.loads(fitted["model"]))


def _extracted(model: BlockLabeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in (part for whole in batches for part in pieces(whole, 2)):
            found = [blocks(h, cache) for h in batch.column(2).to_pylist()]
            texts = ["\n\n".join(b.text for b, s in zip(page, scores.tolist(), strict=True) if s >= 0.5) for page, scores in zip(found, model.scores(found), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        release_memory()

    return run


def label_blocks(html: str, model: BlockLabeller) -> list[tuple[str, float]]:
    """Each block of a page and the probability that it belongs to the article."""
    found = blocks(html)
    return [(b.text, float(s)) for b, s in zip(found, model.scores([found])[0], strict=True)]


def extract_text(pages: DataFrame, model: BlockLabeller | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, ``text`` of the article (empty if none) and ``n_chars``, its code points.

    Blocks keep the page's order, white space inside one is one space, and two line
    ends part them; a null or empty page has none. A page's result depends on its
    own markup and the network alone, so repeated rows get equal results, null keys
    and addresses included; nothing is shuffled. An empty table gives no row. Long
    pages are read whole, in windows. Other columns, also of these names, are ignored.
    """
    model = model or fit_labeller(pages, key, html)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), clean_text(html).alias("html"))
    out = rows.mapInArrow(_extracted(model), rows.drop("html").schema.add("text", "string").add("n_chars", "long"))
    return out.withColumnsRenamed({"page_id": key, "url": url})
