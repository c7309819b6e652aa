"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages, of which only the whole has a label. Every
passage is encoded; gated attention weights the encodings; the weighted mean is
scored. Weights of encoder, attention and score are learned together from the
document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import Scratch, clean_text, column_name, mix64, pieces, release_memory, slices, utf8

#: Words of a passage.
PASSAGE_WORDS = 64
#: Labelled documents of each class that are learned from, at most, taken in the order of a hash of their key.
TRAIN_DOCUMENTS = 4000
#: Longer documents are scored like any other but not learned from.
TRAIN_CHARS = 200_000
#: Bytes of the texts of each class that are learned from, at most: whole documents, in the order of that hash, while they
#: fit. All their passages are encoded; what is gathered takes some 200 MB at most, whatever the corpus.
TRAIN_BYTES = 24 << 20
THRESHOLD = 0.3
_PAIR_BINS = 64
_HIDDEN, _ATTENTION = 24, 12
_PUNCTUATION = "!|*$%&#.,;:?@/=-_<>()[]{}\"'`~+\\^"


def _classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, spaces, line ends, each punctuation mark, control, non-ASCII."""
    table = np.zeros(256, np.int64)
    table[97:123], table[65:91], table[48:58], table[32], table[10] = 1, 2, 3, 4, 5
    for i, c in enumerate(_PUNCTUATION):
        table[ord(c)] = 6 + i
    table[128:] = 6 + len(_PUNCTUATION)
    return table


_CLASS = _classes()
_CLASSES = int(_CLASS.max()) + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
FEATURES = _CLASSES + _PAIR_BINS + 4


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each document) of concatenated texts.

    A word is a run of bytes that are no ASCII white space; a passage is the next
    ``PASSAGE_WORDS`` words of a document, or fewer at its end. A document without
    a word has one passage of zeros.
    """
    docs = len(offsets) - 1
    starts = np.zeros(len(data), bool)
    if len(data):
        solid = ~_SPACE[data]
        starts[1:] = solid[1:] & ~solid[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[heads] = solid[heads]
    words = np.flatnonzero(starts)
    doc_word = np.searchsorted(words, offsets)
    n_words = np.diff(doc_word)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.r_[0, np.cumsum(n_passages)]
    out = np.zeros((int(first[-1]), FEATURES), np.float32)
    if not len(words):
        return out, first[:-1]
    doc_of_word = np.repeat(np.arange(docs), n_words)
    passage = first[doc_of_word] + (np.arange(len(words)) - doc_word[doc_of_word]) // PASSAGE_WORDS
    # a word with the white space after it, up to the next word of its document
    end = np.minimum(np.r_[words[1:], len(data)], offsets[1:][doc_of_word])
    size = end - words
    byte = np.concatenate([[0], np.cumsum(size)])
    covered = np.repeat(words - byte[:-1], size) + np.arange(byte[-1])
    of_byte = np.repeat(passage, size)
    body = data[covered]
    total = np.bincount(of_byte, minlength=len(out)).astype(np.float32)
    scale = 1 / np.maximum(total, 1)[:, None]
    out[:, :_CLASSES] = np.bincount(of_byte * _CLASSES + _CLASS[body], minlength=len(out) * _CLASSES).reshape(len(out), -1) * scale
    pair = body[:-1].astype(np.uint32) * np.uint32(256) + body[1:]
    bins = (pair * np.uint32(2654435761)) >> np.uint32(26)
    doc_of_byte = np.repeat(doc_of_word, size)
    inside = doc_of_byte[1:] == doc_of_byte[:-1]  # no pair reaches from one document into the next
    out[:, _CLASSES : _CLASSES + _PAIR_BINS] = np.bincount((of_byte[1:] * _PAIR_BINS + bins)[inside], minlength=len(out) * _PAIR_BINS).reshape(len(out), -1) * scale
    # repetition: of the word before, and of any word of the passage
    place = np.arange(byte[-1]) - np.repeat(byte[:-1], size)
    letters = np.where(_SPACE[body], 0, body).astype(np.uint64)
    word_hash = mix64(np.add.reduceat(letters * mix64(place.astype(np.uint64) + np.uint64(1)), byte[:-1]))
    count = np.bincount(passage, minlength=len(out)).astype(np.float32)
    same = np.r_[False, (word_hash[1:] == word_hash[:-1]) & (passage[1:] == passage[:-1])]
    keys = np.sort((passage.astype(np.uint64) << np.uint64(32)) | (word_hash & np.uint64(0xFFFFFFFF)))
    distinct = keys[np.r_[True, keys[1:] != keys[:-1]]] >> np.uint64(32)
    tail = _CLASSES + _PAIR_BINS
    out[:, tail] = np.bincount(passage, same, minlength=len(out)) / np.maximum(count, 1)
    out[:, tail + 1] = np.bincount(distinct.astype(np.int64), minlength=len(out)) / np.maximum(count, 1)
    out[:, tail + 2] = np.log1p(total / np.maximum(count, 1))
    out[:, tail + 3] = np.log1p(count)
    return out, first[:-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Parameters of encoder (w, b), gated attention (v, u, a) and score (c, d), and the scaling of features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def constant(cls, probability: float) -> AttentionModel:
        """Scores every document alike; for training data of less than two classes."""
        p = {"w": np.zeros((FEATURES, 1)), "b": np.zeros(1), "v": np.zeros((1, 1)), "u": np.zeros((1, 1)), "a": np.zeros(1), "c": np.zeros(1)}
        odds = min(max(probability, 1e-3), 1 - 1e-3)
        return cls(np.zeros(FEATURES), np.ones(FEATURES), p | {"d": np.array([np.log(odds / (1 - odds))])})

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, n = self.p, np.diff(np.r_[first, len(x)])
        bag = np.repeat(np.arange(len(first)), n)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return bag, h, t, s, a, z, z @ p["c"] + p["d"][0]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each bag."""
        return _sigmoid(self.forward(self.scaled(x), first)[-1]) if len(first) else np.zeros(0)

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Weight of each passage in its document."""
        return self.forward(self.scaled(x), first)[4]

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy."""
        p = self.p
        bag, h, t, s, a, z, logit = self.forward(x, first)
        g = weight * (_sigmoid(logit) - y) / len(y)
        to_z = (g[:, None] * p["c"])[bag]
        to_a = (to_z * h).sum(1)
        to_e = a * (to_a - np.add.reduceat(a * to_a, first)[bag])
        to_t = to_e[:, None] * p["a"] * s * (1 - t * t)
        to_s = to_e[:, None] * p["a"] * t * s * (1 - s)
        to_h = a[:, None] * to_z + to_t @ p["v"].T + to_s @ p["u"].T
        pre = to_h * (1 - h * h)
        return {"w": x.T @ pre, "b": pre.sum(0), "v": h.T @ to_t, "u": h.T @ to_s, "a": (t * s).T @ to_e, "c": z.T @ g, "d": np.array([g.sum()])}

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> AttentionModel:
        """By about ``steps`` steps of Adam on batches of bags, in 60 epochs at most. ``weights`` give the classes their shares of the corpus."""
        if len(set(labels.tolist())) < 2:
            return cls.constant(float(labels.mean()) if len(labels) else 0.5)
        rng = np.random.default_rng(seed)
        whole = np.concatenate(bags)
        mean, scale = whole.mean(0), 1 / (whole.std(0) + 1e-3)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        p = {"w": normal(FEATURES, _HIDDEN), "b": np.zeros(_HIDDEN), "v": normal(_HIDDEN, _ATTENTION), "u": normal(_HIDDEN, _ATTENTION), "a": normal(_ATTENTION), "c": normal(_HIDDEN), "d": np.zeros(1)}
        model = cls(mean, scale, p)
        bags = [model.scaled(x) for x in bags]
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        step, batches = 0, -(-len(bags) // batch)
        epochs = min(60, -(-steps // batches))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                chosen = order[i : i + batch]
                x = np.concatenate([bags[k] for k in chosen])
                first = np.r_[0, np.cumsum([len(bags[k]) for k in chosen])[:-1]]
                grads = model.gradient(x, first, labels[chosen], weights[chosen])
                step += 1
                now = rate * (1 - step / (epochs * batches + 1))
                for k, g in grads.items():
                    g = g + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                model.p = p
        return model


def fold_of(key: F.Column, folds: int) -> F.Column:
    """crc32 of the key's decimal text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        blobs = []
        for i, j in slices(offsets):
            x, first = passage_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            blobs += [part.tobytes() for part in np.split(x, first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), batch.column(2), pa.array(blobs, pa.binary())], names=["_id", "y", "weight", "bag"])


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fold: int = 0, folds: int = 5, most: int = TRAIN_DOCUMENTS) -> AttentionModel:
    """Learn from the labelled documents outside a fold of the keys, at most ``most`` and ``TRAIN_BYTES`` of each class.

    Rows without a label or key are not learned from; of several labels of one key
    the largest holds, and of several documents of one key the first in the order
    of their digests. The sample's keys, at most ``2 * most``, are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & (fold_of(F.col(key), folds) != fold)).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("double").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y in sorted(totals) if y in (0.0, 1.0)]
    if not parts:
        return AttentionModel.constant(0.5)
    scratch = Scratch(docs.sparkSession, "quality")
    sample = scratch.store(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], "sample", rows=2 * most)
    texts = docs.select(F.col(key).alias("_id"), clean_text(text).alias("text")).where(F.length("text") <= TRAIN_CHARS)
    sizes = texts.select("_id", F.octet_length("text").alias("bytes")).join(F.broadcast(sample), "_id").groupBy("_id", "y").agg(F.max("bytes").alias("bytes"))
    so_far = F.sum("bytes").over(W.Window.partitionBy("y").orderBy(F.xxhash64("_id"), "_id"))  # over at most ``most`` rows
    chosen = scratch.store(sizes.withColumn("so_far", so_far).where(F.col("so_far") <= TRAIN_BYTES).select("_id", "y"), "chosen", rows=2 * most)
    used = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not used:
        return AttentionModel.constant(0.5)
    share = F.element_at(F.create_map(*[F.lit(x) for y, n in used.items() for x in (y, totals[y] / n)]), F.col("y"))
    rows = texts.join(F.broadcast(chosen.withColumn("weight", share)), "_id")
    rows = rows.select("_id", "y", "weight", "text").mapInArrow(_bags, "_id string, y double, weight double, bag binary")
    got = rows.groupBy("_id", "y", "weight").agg(F.min("bag").alias("bag")).orderBy("_id").toArrow()  # the order of rows must not matter
    bags = [np.frombuffer(b.as_buffer(), np.float32).reshape(-1, FEATURES) for b in got["bag"]]
    weights = got["weight"].to_numpy()
    scratch.close()
    model = AttentionModel.fit(bags, got["y"].to_numpy(), weights / max(weights.mean(), 1e-9) if len(weights) else weights)
    del bags, got
    release_memory()
    return model


def _scored(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            scores = [np.zeros(0)]
            for i, j in slices(offsets):
                scores.append(model.score(*passage_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores), pa.float64())], names=[*batch.schema.names[:-1], "score"])
        release_memory()

    return run


def score_quality(docs: DataFrame, model: AttentionModel, keep: list[F.Column], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``score``, the probability of label 1, from the whole text; a null or empty text is one passage of zeros."""
    rows = docs.select(*keep, clean_text(text).alias("_text"))
    return rows.mapInArrow(_scored(model), rows.drop("_text").schema.add("score", "double"))


def classify_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted (1 from a score of ``THRESHOLD``).

    Only the text decides: equal texts and repeated rows score alike, a null text
    as an empty one. A null key is not held out and not learned from. An empty
    table gives no row; without labels of both classes every score is that of the
    one class, or 0.5. Columns of other names, also of these, are ignored.
    """
    model = fit_quality(docs, labels, key, text)
    held_out = F.coalesce(fold_of(F.col(key), 5) == 0, F.lit(False)).alias("held_out")
    return score_quality(docs, model, [F.col(key), held_out], text).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _accepted(model: AttentionModel, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, whole.schema.get_field_index(text))):
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            scores = [model.score(*passage_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) >= THRESHOLD))
        release_memory()

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, that are predicted to be good; ``text`` is a string column, of any case that the session resolves.

    A null text is scored as an empty one, equal texts and repeated rows stay or go
    together, a null key is not learned from. An empty table gives no row.
    """
    return docs.mapInArrow(_accepted(fit_quality(docs, labels, key, text), column_name(docs, text)), docs.schema)
