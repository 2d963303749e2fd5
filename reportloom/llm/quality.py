"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in blocks with either dictionary. The difference of the two sizes, divided by the text's
size, says which text it resembles; a logistic curve fitted on labelled rows that neither dictionary saw turns it
into a probability of label 1. Labels are the only supervision and come from a bounded sample of rows
(``common.SAMPLE_ROWS`` of each class); every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample, map_texts

BLOCK, DICTIONARY, LEVEL = 1024, 32_768, 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    constant: float

    def score(self, difference):
        """Probability of label 1 for normalised size differences."""
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(difference) + self.constant, -30, 30)))


def blocks(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def difference_of(good: bytes, bad: bytes):
    """A function from texts to (size with bad - size with good) / size, 0 for empty texts."""
    for_good, for_bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False) if d else zstandard.ZstdCompressor(level=LEVEL) for d in (good, bad))

    def call(texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            parts = blocks(t)
            gap = sum(len(for_bad.compress(b)) - len(for_good.compress(b)) for b in parts)
            out.append(gap / sum(map(len, parts)) if parts else 0.0)
        return out

    return call


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_ROWS) -> QualityModel:
    """Two thirds of the sample make the dictionaries, the last third calibrates. Without rows of both labels the
    score is the share of label 1 for every text."""
    bad, good, share = labelled_sample(docs, labels, label_col, id_col, text_col, per_class)
    parts = {}
    for label, texts in ((0, bad), (1, good)):
        parts[label] = ([t for i, t in enumerate(texts) if i % 3 != 2], [t for i, t in enumerate(texts) if i % 3 == 2])
    if not all(seen and rest for seen, rest in parts.values()):
        share = min(max(share, 0.01), 0.99)
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    of_bad, of_good = (dictionary([b for t in parts[k][0] for b in blocks(t)]) for k in (0, 1))
    measure = difference_of(of_good, of_bad)
    low, high = measure(parts[0][1]), measure(parts[1][1])
    weight = np.concatenate([np.full(len(low), (1 - share) / len(low)), np.full(len(high), share / len(high))]) * (len(low) + len(high))
    slope, constant = fit_logistic(np.array([low + high]).T * 100, np.array([0] * len(low) + [1] * len(high)), weight)
    return QualityModel(of_good, of_bad, float(slope) * 100, float(constant))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Columns id_col, held_out, score (0 to 1), predicted (1 if score >= threshold), a row for each row of ``docs``.

    Null text counts as empty; an empty text has difference 0 and the score the curve gives there. Only the text
    is an input of the score. Extra columns are ignored; an empty table gives an empty result.
    """

    def make():
        measure = difference_of(model.good, model.bad)
        return lambda texts: [model.score(measure(texts)).tolist()]

    scored = map_texts(docs, text_col, "score double", make, [id_col])
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
