"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of BLOCK bytes. Each block is compressed with a dictionary
built from good text and with one built from bad text; small blocks make the dictionary
count throughout a long text. The difference of the two sums over their sum, also
saturated (a large difference says little more than a moderate one), goes through a
logistic calibration fitted on other labelled documents than the dictionaries were built
from. The calibration also knows the compressed size for each byte: the difference of a
very repetitive text is small under any pair of dictionaries and has to be read by it.
Labels, language, source and id are no inputs of a score.

Bounds of the fit, whatever the corpus's size: SAMPLE_DOCS labelled documents of each
class, whole texts, half of them for the dictionaries and half for the calibration; of
all blocks of the former the TRAIN_BLOCKS of each class with the lowest hashes, which is
all of them unless they exceed that. Classes are weighted back to their shares among the
training labels.

Results for special inputs: a null text counts as empty; an empty text has no blocks,
both measures are zero, and it gets the score calibrated for that. Without labels of
both classes every score is the share of good labels, or 0.5. Repeated rows each give a
row, an empty table an empty one. Extra columns are ignored by score(), and kept by
keep_good(). Texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, id_and_text, labelled_sample

SAMPLE_DOCS, TRAIN_BLOCKS = 2500, 20_000
BLOCK, DICTIONARY, LEVEL = 1024, 112 << 10, 3
MEASURES = 5
SMOOTH = 40  # bytes added to sizes, so that very short texts differ little
GOOD = 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' end where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if len(content) >= 8 else zstandard.DICT_TYPE_RAWCONTENT  # fewer bytes hold no header
    plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind), **plain) if content else zstandard.ZstdCompressor(**plain)


def measures(text: str, bad: bytes, good: bytes) -> list[float]:
    """Normalised difference of compressed sizes, compressed size for each byte (logarithm) and its square, and the difference saturated at two scales."""
    raw = text.encode()
    squeeze_bad, squeeze_good = _compressor(bad).compress, _compressor(good).compress
    a = b = 0
    for x in blocks(raw):
        a += len(squeeze_bad(x))
        b += len(squeeze_good(x))
    ratio = float(np.log((a + b + SMOOTH) / (2 * len(raw) + SMOOTH)))
    difference = 10.0 * (a - b) / (a + b) if raw else 0.0
    return [difference, ratio, ratio * ratio, float(np.tanh(difference)), float(np.tanh(4 * difference))]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 60) -> list[float]:
    """Weighted logistic regression by Newton steps; weights of the raw columns, intercept first."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    weight = weight / weight.sum()
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return [float(w[0] - (w[1:] * mean / scale).sum()), *map(float, w[1:] / scale)]


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries of at most DICTIONARY bytes and a calibration."""

    bad: bytes = field(repr=False)
    good: bytes = field(repr=False)
    weights: tuple[float, ...]

    def score(self, text: str) -> float:
        if not any(self.weights[1:]):
            z = self.weights[0]
        else:
            z = self.weights[0] + sum(w * m for w, m in zip(self.weights[1:], measures(text, self.bad, self.good), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learn from the labels that may be learnt from; see the module's text for the bounds."""
    bounded_batches(docs.sparkSession)
    sample, sizes = labelled_sample(id_and_text(docs, id_col, text_col), labels, "quality", SAMPLE_DOCS)
    share = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    constant = QualityModel(b"", b"", (float(np.log((share + 1e-3) / (1 - share + 1e-3))), *[0.0] * MEASURES))

    def cut(batches):
        for b in batches:
            for label, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                every = blocks(text.encode())
                for i in range(0, len(every), 1000):
                    part = every[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(part), pa.int32()), pa.array(part, pa.binary())], ["label", "block"])

    built = sample.filter("half = 0").select("text", "label").mapInArrow(cut, "label int, block binary")
    # At most TRAIN_BLOCKS blocks of BLOCK bytes of each class reach the driver.
    parts = [[bytes(r["block"]) for r in built.filter(F.col("label") == k).orderBy(F.xxhash64("block"), "block").limit(TRAIN_BLOCKS).select("block").collect()] for k in (0, 1)]
    if not all(parts):
        return constant
    bad, good = map(dictionary, parts)

    def measure(batches):
        for b in batches:
            rows = np.array([measures(t, bad, good) for t in b.column(0).to_pylist()]).reshape(-1, MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(rows[:, i]) for i in range(MEASURES))], ["label", *names])

    names = [f"m{i}" for i in range(MEASURES)]
    got = sample.filter("half = 1").select("text", "label").mapInArrow(measure, ", ".join(["label int", *(f"{n} double" for n in names)])).collect()
    table = np.array(sorted(map(tuple, got)), dtype=float).reshape(-1, 1 + MEASURES)
    y = table[:, 0]
    if not 0 < y.sum() < len(y):
        return constant
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    return QualityModel(bad, good, tuple(fit_logistic(table[:, 1:], y, weight)))


def scorer(model: QualityModel):
    """The score of a text column, by Arrow batches."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype="float64")

    return score


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better) of every whole text."""
    bounded_batches(df.sparkSession)
    return id_and_text(df, id_col, text_col).select("doc_id", scorer(model)("text").alias("score"))


def is_good(text: Column, model: QualityModel, least: float = GOOD) -> Column:
    return scorer(model)(F.coalesce(text, F.lit(""))) >= least


def keep_good(df: DataFrame, model: QualityModel, least: float = GOOD, text_col: str = "text") -> DataFrame:
    """df's rows, all columns, whose score is at least `least`."""
    bounded_batches(df.sparkSession)
    return df.filter(is_good(df[text_col], model, least))
