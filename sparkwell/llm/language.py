"""Language identification by mixture inference.

A text is taken as words, each drawn from one language of a mixture. A word's
likelihood under a language is the product of those of its byte n-grams.
Expectation-maximisation estimates the proportions of the languages in each
document; of the sets of its most frequent languages, the one with the best
penalised likelihood is selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_text, mix64, schema_of, slices, utf8

ORDER = 4
BINS = 1 << 16
SMOOTHING = 0.1
STEPS = 6
UNKNOWN = "und"

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def word_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each n-gram, first n-gram of each word, first word of each document) of concatenated texts.

    A word is a run of ASCII letters and bytes above 127, in lower case for ASCII
    and Latin-1. An n-gram ends at each letter of a word and after its last one,
    and does not reach over the word's start.
    """
    docs = len(offsets) - 1
    # a separator after each text keeps words from running on
    starts = offsets[:-1] + np.arange(docs)
    z = np.zeros(len(data) + docs, np.uint8)
    where = np.ones(len(z), bool)
    where[offsets[1:] + np.arange(docs)] = False
    z[where] = _LETTER[data]
    # capital letters of Latin-1 (after byte C3) differ in one bit
    latin = np.flatnonzero((z[1:] >= 0x80) & (z[1:] <= 0x9E) & (z[1:] != 0x97) & (z[:-1] == 0xC3)) + 1
    z[latin] += 0x20
    before = np.r_[np.uint8(0), z[:-1]]
    at = np.flatnonzero(z | before)
    code = z[at].astype(np.uint64)
    inside = np.ones(len(at), bool)
    for k in range(1, ORDER):
        previous = np.where(at >= k, z[np.maximum(at - k, 0)], 0)
        inside &= previous > 0
        code |= np.where(inside, previous, 0).astype(np.uint64) << np.uint64(8 * k)
    words = np.flatnonzero(before[at] == 0)
    return (mix64(code) & np.uint64(BINS - 1)).astype(np.int64), words, np.searchsorted(at[words], starts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language, once a task; the batches have (lang, text)."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            grams, words, first = word_grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            bounds = np.r_[np.r_[words, len(grams)][first], len(grams)]
            of_doc = np.repeat(np.arange(j - i), np.diff(bounds))
            names, index = np.unique(langs[i:j].astype(str), return_inverse=True)
            for k, name in enumerate(names):
                counts = np.bincount(grams[index[of_doc] == k], minlength=BINS)
                totals[name] = totals.get(name, 0) + counts
    for name, counts in totals.items():
        bins = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins)), pa.array(bins, pa.int32()), pa.array(counts[bins], pa.int64())], names=["lang", "bin", "n"])


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # (bins, languages), float32

    @classmethod
    def from_counts(cls, rows) -> LanguageModel:
        """From (lang, bin, n) rows, at most ``BINS`` for each language."""
        languages = sorted({r[0] for r in rows})
        index = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((BINS, len(languages)))
        for lang, b, n in rows:
            counts[b, index[lang]] += n
        prob = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BINS)
        return cls(languages, np.log(prob).astype(np.float32))

    def proportions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text: proportions of the languages in the selected set, and how many words it has (none: zeros)."""
        docs, k = len(offsets) - 1, len(self.languages)
        grams, words, first = word_grams(data, offsets)
        n = np.diff(np.r_[first, len(words)])
        out = np.zeros((docs, k))
        if not len(words) or not k:
            return out, n
        likely = np.add.reduceat(self.log_prob[grams], words, axis=0).astype(np.float64)
        peak = likely.max(1, keepdims=True)
        likely = np.exp(likely - peak)  # of the best language 1; a word's constant factor changes no comparison
        has = np.flatnonzero(n)
        doc = np.repeat(np.arange(len(has)), n[has])

        def fit(share: np.ndarray, steps: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of some of the documents with words: ``share`` has their rows."""
            chosen = np.zeros(len(has), bool)
            chosen[docs] = True
            part, size = likely[chosen[doc]] if len(docs) < len(has) else likely, n[has][docs]
            of, cuts = np.repeat(np.arange(len(docs)), size), np.cumsum(size) - size
            for step in range(steps + 1):
                joint = part * share[of]
                total = joint.sum(1) + 1e-300
                if step == steps:
                    return share, np.add.reduceat(np.log(total), cuts)
                share = np.add.reduceat(joint / total[:, None], cuts, axis=0) / size[:, None]

        share, _ = fit(np.full((len(has), k), 1 / k), STEPS, np.arange(len(has)))
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
        # each language but the first costs half the logarithm of the number of words, and a word's evidence
        cost = 0.5 * np.log(n[has]) + 3.0
        best, chosen = np.full(len(has), -np.inf), np.zeros((len(has), k))
        for size in range(1, k + 1):
            # no word is likelier in a mixture than 1, so a set scores at most minus its cost: where that is no gain, no larger set is one
            open_ = np.flatnonzero(-(size - 1) * cost > best)
            if not len(open_):
                break
            subset = np.where(rank[open_] < size, share[open_], 0)
            subset /= np.maximum(subset.sum(1, keepdims=True), 1e-300)
            subset, fitted = fit(subset, 0 if size == 1 else 2, open_)
            score = fitted - (size - 1) * cost[open_]
            better = score > best[open_]
            best[open_[better]], chosen[open_[better]] = score[better], subset[better]
        out[has] = chosen
        return out, n


def fit_languages(docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """n-gram likelihoods from all rows with a language; the driver gets at most ``BINS`` counts for each language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), clean_text(text).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    return LanguageModel.from_counts([(r["lang"], r["bin"], r["n"]) for r in counts.collect()])


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep``, ``lang_pred``, ``score`` (its proportion) and ``languages`` (the selected set, most frequent first).

    ``und``, with score 0 and no languages, where the text is null or has no letter
    or nothing was learned. Equal proportions go to the name that sorts first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            data, offsets = utf8(column)
            names, scores, sets = [], [], []
            for i, j in slices(offsets):
                share, words = model.proportions(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for row in range(j - i):
                    known = words[row] > 0 and len(model.languages) > 0
                    if known:
                        span = data[offsets[i + row] : offsets[i + row + 1]]
                        known = bool((_LETTER[span[:256]] > 0).any() and (span[:256] < 128)[_LETTER[span[:256]] > 0].any()) or any(map(str.isalpha, span.tobytes().decode()))
                    order = np.argsort(-share[row], kind="stable")
                    names.append(model.languages[order[0]] if known else UNKNOWN)
                    scores.append(float(share[row][order[0]]) if known else 0.0)
                    sets.append([model.languages[x] for x in order if share[row][x] > 0] if known else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "lang_pred", "score", "languages"])

    rows = docs.select(*keep, clean_text(text).alias("_text"))
    schema = rows.drop("_text").schema
    for field in schema_of("lang_pred string, score double, languages array<string>"):
        schema = schema.add(field)
    return rows.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", fold: int = 2, folds: int = 4) -> DataFrame:
    """Learn from the documents outside a fold of the keys and predict all of them: key, held_out, lang_pred, score, languages.

    The fold of a key is crc32 of its decimal text modulo ``folds``; a null key is
    in no fold and learned from. All such documents are counted, not a sample.
    Repeated rows are predicted alike; an empty table gives no row; columns of
    other names, also of these, are ignored. What is learned has ``BINS`` counts
    for each language that the table names.
    """
    held_out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
    model = fit_languages(docs.where(~held_out), lang, text)
    rows = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    out = predict_languages(rows, model, ["doc_id", "held_out"])
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)
