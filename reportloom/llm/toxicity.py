"""Toxicity by multiple-instance learning: sentences get scores, documents get labels.

A sentence's logistic probability p follows from the summed weights z of its words. What it counts, q, is how far p
exceeds that of a sentence without any weighted word (z = 0): 1 - q = (1 - p(z)) / (1 - p(0)) if z > 0, else q = 0.
So a document does not become toxic by its length alone. A document's probability is the noisy-or of its sentences
with a leak, 1 - (1 - LEAK) * prod(1 - q). The weights are trained on document labels alone, by gradient ascent on
the likelihood of that same noisy-or, over a bounded sample of labelled rows (``common.SAMPLE_ROWS`` of each class).
The same q then locate the offending sentences.

A word counts by itself and by its first 4 to 8 letters, so inflected forms that no labelled row holds still
count. Features of fewer than ``LEAST_DOCS`` sampled documents are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_ROWS, SLICE_ROWS, held_out, labelled_sample, map_texts

#: RIDGE is the weight of the absolute weights (soft thresholding), which leaves most features out.
LEAST_DOCS, EPOCHS, RIDGE = 4, 100, 2e-4
#: Probability of label 1 without any telling sentence. It lets the fit start; chosen on rows that are not held out.
LEAK = 0.001
#: Weights nearer to 0 than this are left out of the model, which bounds what is sent to executors.
LEAST_WEIGHT = 0.05
MEMO_WORDS = 150_000
SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    constant: float
    weights: dict[str, float]


def sentences(text: str) -> list[str]:
    """The sentences of a text that hold more than white space."""
    return [s for s in SENTENCE_END.split(text) if not s.isspace() and s]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in range(4, 9) if len(word) >= n)]


def instances(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The sample as arrays: feature names, and for each (sentence, feature) the sentence's row and the feature's
    column, and each sentence's document. Words are numbered first, so that each word's features are made once."""
    words: dict[str, int] = {}
    said, owner = [], []
    for d, text in enumerate(texts):
        for s in sentences(text.lower()):
            said.append(np.fromiter((words.setdefault(w, len(words)) for w in set(WORD.findall(s))), np.int32))
            owner.append(d)
    owner = np.array(owner, np.int32)
    index: dict[str, int] = {}
    of_word = [np.fromiter((index.setdefault(f, len(index)) for f in features(w)), np.int32) for w in words]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in of_word])]).astype(np.int64)
    flat = np.concatenate(of_word) if of_word else np.zeros(0, np.int32)

    def features_of(ids: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([flat[starts[i] : starts[i + 1]] for i in ids])) if len(ids) else np.zeros(0, np.int32)

    parts = [features_of(ids) for ids in said]
    docs = np.zeros(len(index), np.int32)
    for d in range(len(texts)):
        first, last = np.searchsorted(owner, [d, d + 1])
        if last > first:
            docs[np.unique(np.concatenate(parts[first:last]))] += 1
    kept = docs >= LEAST_DOCS
    column = np.cumsum(kept, dtype=np.int32) - 1
    parts = [column[p[kept[p]]] for p in parts]
    rows = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]) if parts else np.zeros(0, np.int32)
    cols = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return [f for f, k in zip(index, kept, strict=True) if k], rows, cols, owner


def fit_noisy_or(texts: list[str], y: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Weights of features and the constant from texts, their labels and weights."""
    names, rows, cols, owner = instances(texts)
    n, total = len(owner), weight.sum() or 1.0

    def ascend(w: np.ndarray, b: float, rows: np.ndarray, cols: np.ndarray, ridge: float, epochs: int) -> tuple[np.ndarray, float]:
        speed, speed_b = np.full(len(w), 1e-8), 1e-8
        for _ in range(epochs if n else 0):
            z = np.bincount(rows, w[cols], n)
            p, base = 1 / (1 + np.exp(-np.clip(b + z, -30, 30))), 1 / (1 + math.exp(-b))
            counts = z >= 0  # with 0, so that the first step has a direction
            spared = np.where(counts, np.log1p(-np.minimum(p, 1 - 1e-12)) - math.log1p(-base), 0.0)
            none = (1 - LEAK) * np.exp(np.bincount(owner, spared, len(texts)))
            g = (np.where(y == 1, none / (1 - none), -1.0) * weight)[owner] * counts
            gw, gb = np.bincount(cols, (g * p)[rows], len(w)) / total, (g * (p - base)).sum() / total
            speed, speed_b = speed + gw * gw, speed_b + gb * gb
            pace = 0.5 / np.sqrt(speed)
            w = w + pace * gw
            w = np.sign(w) * np.maximum(np.abs(w) - pace * ridge, 0)
            b += 0.2 * gb / math.sqrt(speed_b)
        return w, b

    w, b = ascend(np.zeros(len(names)), -6.0, rows, cols, RIDGE, EPOCHS)
    # the penalty has chosen the features and shrunk them: a second pass over those left frees their weights
    kept = np.abs(w) >= LEAST_WEIGHT
    column = np.cumsum(kept) - 1
    inside = kept[cols]
    names = [f for f, k in zip(names, kept, strict=True) if k]
    w, b = ascend(w[kept], b, rows[inside], column[cols[inside]], RIDGE / 4, EPOCHS)
    return ToxicityModel(float(b), {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) >= LEAST_WEIGHT})


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_ROWS) -> ToxicityModel:
    """The model from labelled rows outside the held-out third; without any label 1, no sentence scores much."""
    clean, toxic, share = labelled_sample(docs, labels, label_col, id_col, text_col, per_class)
    y = np.array([0] * len(clean) + [1] * len(toxic))
    weight = np.array([(1 - share) / max(1, len(clean))] * len(clean) + [share / max(1, len(toxic))] * len(toxic)) * max(1, len(y))
    return fit_noisy_or(clean + toxic, y, weight)


def make_scorer(model: ToxicityModel):
    """A function from a text to what its sentences count (q), and one to the document's probability."""
    weights, memo, constant = model.weights, {}, model.constant
    base = 1 / (1 + math.exp(-constant))

    def weight_of(word: str) -> float:
        if (w := memo.get(word)) is None:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            w = memo[word] = sum(weights.get(f, 0.0) for f in features(word))
        return w

    def excess(sentence: str) -> float:
        z = sum(map(weight_of, set(WORD.findall(sentence))))
        return max(0.0, (1 / (1 + math.exp(-min(max(constant + z, -30), 30))) - base) / (1 - base)) if z > 0 else 0.0

    def each(text: str) -> list[float]:
        return [excess(s) for s in sentences(text.lower())]

    def whole(text: str) -> float:
        return -math.expm1(sum((math.log1p(-min(q, 1 - 1e-12)) for q in map(excess, sentences(text.lower())) if q), math.log1p(-LEAK)))

    return each, whole


def score_column(model: ToxicityModel):
    """An Arrow function from a text column to document scores, with one scorer a task; rows become Python objects a
    slice at a time. Null counts as empty, and empty scores LEAK."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, whole = make_scorer(model)
        for texts in batches:
            scores = []
            for i in range(0, len(texts), SLICE_ROWS):
                scores += [whole(t.as_py() or "") for t in texts.slice(i, SLICE_ROWS)]
            yield pa.array(scores, pa.float64())

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Columns id_col, held_out, score (0 to 1), predicted (1 if score >= threshold), a row for each row of ``docs``.

    Null and empty texts have no sentence and score ``LEAK``. Only the text is an input of the score. Extra columns are
    ignored; rows with null or repeated ids keep a row each; an empty table gives an empty result.
    """

    def make():
        _, whole = make_scorer(model)
        return lambda texts: [[whole(t) for t in texts]]

    scored = map_texts(docs, text_col, "score double", make, [id_col])
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def locate(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Columns id_col, sentence_no (from 0), sentence, score: each sentence that scores ``threshold`` or more."""

    def make():
        each, _ = make_scorer(model)

        def call(texts):
            found = [[{"no": i, "sentence": s.strip(), "score": p} for i, (s, p) in enumerate(zip(sentences(t), each(t), strict=False)) if p >= threshold] for t in texts]
            return [found]

        return call

    found = map_texts(docs, text_col, "hits array<struct<no:int,sentence:string,score:double>>", make, [id_col])
    return found.select(id_col, F.explode("hits").alias("hit")).select(id_col, F.col("hit.no").alias("sentence_no"), "hit.sentence", "hit.score")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``threshold``.

    Each row is judged by its own text, whatever its id; null and empty texts score ``LEAK`` and stay. An empty table gives
    an empty result.
    """
    return docs.where(score_column(model)(F.col(text_col).cast("string")) < threshold)
