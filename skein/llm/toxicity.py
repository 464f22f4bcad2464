"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's evidence is the sum of its distinct words' weights; a word's weight is that
of the word and of its first few letters (PREFIXES). Its probability is
sigmoid(BIAS + evidence) - sigmoid(BIAS), at least 0, so sentences without evidence add
nothing however long a document is. A document is toxic unless every sentence is not
(noisy-or): 1 - product of (1 - p). Weights are trained from document labels alone, by
Adam on the noisy-or's log loss with soft-thresholding; sentence scores then locate the
offending sentences. Labels, language, source and id are no inputs of a score.

Features are those whose documents are toxic more often than chance among so many
features explains: documents times the divergence of their toxic share from the share
of all exceeds the logarithm of the number of features.

Bounds of the fit, whatever the corpus's size: SAMPLE_DOCS labelled documents of each
class, whole texts, and FEATURES features. Documents are counted and coded where they
lie; the driver gets the chosen features and, for each document of the sample, the
distinct sets of these that its sentences have.

Results for special inputs: a null text counts as empty, and a text without words has
score 0. Without labels of both classes every score is 0. Repeated rows each give a
row, an empty table an empty one. Extra columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, checkpointed, id_and_text, labelled_sample

SAMPLE_DOCS, FEATURES = 3000, 1500
LEAST_DOCS = 3  # documents of the sample that have a feature
PREFIXES = (4, 5, 6, 7)
BIAS, OFFENDING = -6.0, 0.5
MISS = 3  # what a missed toxic document costs, in false alarms
CACHE_WORDS = 300_000
SENTENCE = re.compile(r"[^.!?\n|]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of every sentence that has words."""
    out = []
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m.group().lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def document_features(bag: list[set[str]]) -> set[str]:
    return {f for w in set().union(*bag) for f in features(w)}


def evidence(have: int, toxic: int, share: float) -> float:
    """Documents with a feature, times the divergence of their toxic share from the share of all; 0 if it isn't larger."""
    p = toxic / have
    if p <= share:
        return 0.0
    return have * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def coded(bag: list[set[str]], index: dict[str, int]) -> Counter[tuple[int, ...]]:
    """How many sentences have each set of chosen features, as their numbers with repeats."""
    out: Counter[tuple[int, ...]] = Counter()
    for words in bag:
        found = [index[f] for w in words for f in features(w) if f in index]
        if found:
            out[tuple(sorted(found))] += 1
    return out


def train(bags: list[list[set[str]]], y: np.ndarray) -> dict[str, float]:
    """Weights of features from documents as lists of sentences' words, and their labels, all in memory."""
    have, toxic = Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        found = document_features(bag)
        have.update(found)
        if label:
            toxic.update(found)
    share = y.sum() / len(y)
    often = [f for f, c in have.items() if c >= LEAST_DOCS]
    if not 0 < share < 1 or not often:
        return {}
    worth = {f: x for f in often if (x := evidence(have[f], toxic[f], share)) >= np.log(max(2, len(often)))}
    chosen = sorted(sorted(worth), key=lambda f: -worth[f])[:FEATURES]
    index = {f: i for i, f in enumerate(chosen)}
    return weigh([(f, have[f], toxic[f]) for f in chosen], [coded(bag, index) for bag in bags], y)


def weigh(chosen: list[tuple[str, int, int]], bags: list[Counter[tuple[int, ...]]], y: np.ndarray, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-5, lasso: float = 1e-4) -> dict[str, float]:
    """Weights of the chosen features (name, documents, toxic ones) from coded documents and their labels."""
    n, good = len(bags), len(bags) - y.sum()
    doc, sentence, feature, times = [], [], [], []
    for d, bag in enumerate(bags):
        for found, k in sorted(bag.items()):
            feature += found
            sentence += [len(doc)] * len(found)
            doc.append(d)
            times.append(k)
    if not doc:
        return {}
    doc, sentence, feature, times = (np.array(x, dtype=np.int64) for x in (doc, sentence, feature, times))
    odds = np.array([np.log((t + 0.5) / (y.sum() + 1) * (good + 1) / (c - t + 0.5)) for _, c, t in chosen])
    w = np.clip(odds, 0, 3)
    base = sigmoid(BIAS)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        s = sigmoid(BIAS + np.bincount(sentence, w[feature], len(doc)))
        p = np.maximum(0.0, s - base)
        whole = np.clip(-np.expm1(np.bincount(doc, times * np.log1p(-p), n)), 1e-3, 1 - 1e-9)
        slope = np.where(y == 1, -MISS * (1 - whole) / whole, 1.0)[doc] * times / (1 - p) * s * (1 - s)
        g = np.bincount(feature, slope[sentence], len(w)) / n + ridge * w
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w = np.sign(w) * np.maximum(0.0, np.abs(w) - rate * lasso)
    return {f: float(x) for (f, _, _), x in zip(chosen, w, strict=True) if x}


@dataclass(frozen=True)
class ToxicityModel:
    """At most FEATURES weights."""

    weights: dict[str, float] = field(repr=False)

    def scored(self, text: str, cache: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score, and the start, end and probability of every sentence with evidence."""
        get = self.weights.get
        hits, none = [], 0.0
        for start, end, words in sentences(text):
            evidence = 0.0
            for w in words:
                x = cache.get(w)
                if x is None:
                    x = cache[w] = sum(get(f, 0.0) for f in features(w))
                evidence += x
            if evidence > 0:
                p = float(sigmoid(BIAS + evidence) - sigmoid(BIAS))
                hits.append((start, end, p))
                none += np.log1p(-p)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return 0.0 - float(np.expm1(none)), hits


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from the labels that may be learnt from; see the module's text for the bounds. The same weights as train() over the sample."""
    bounded_batches(docs.sparkSession)
    sample, _ = labelled_sample(id_and_text(docs, id_col, text_col), labels, "toxic", SAMPLE_DOCS)
    sample = sample.select("doc_id", "text", "label")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n, n_toxic = sum(sizes.values()), sizes.get(1, 0)
    if not 0 < n_toxic < n:
        return ToxicityModel({})

    def bag(text: str) -> list[set[str]]:
        return [words for _, _, words in sentences(text)]

    def run_counts(batches):
        for b in batches:
            have, toxic = Counter(), Counter()
            for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = document_features(bag(text))
                have.update(found)
                if label:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(have.keys(), pa.string()), pa.array(have.values(), pa.int64()), pa.array([toxic[f] for f in have], pa.int64())], ["feature", "have", "toxic"])

    counts = sample.mapInArrow(run_counts, "feature string, have long, toxic long")
    counts = checkpointed(counts.groupBy("feature").agg(F.sum("have").alias("have"), F.sum("toxic").alias("toxic")).filter(F.col("have") >= LEAST_DOCS))
    share, least = n_toxic / n, float(np.log(max(2, counts.count())))
    p = F.col("toxic") / F.col("have")
    rest = F.when(p < 1, (1 - p) * F.ln((1 - p) / (1 - share))).otherwise(0.0)
    worth = F.when(p > share, F.col("have") * (p * F.ln(p / share) + rest)).otherwise(0.0)
    chosen = [tuple(r) for r in counts.withColumn("worth", worth).filter(F.col("worth") >= least).orderBy(F.desc("worth"), "feature").limit(FEATURES).select("feature", "have", "toxic").collect()]
    index = {f: i for i, (f, _, _) in enumerate(chosen)}

    def run_coded(batches):
        kind = pa.list_(pa.struct([("found", pa.list_(pa.int32())), ("times", pa.int64())]))
        for b in batches:
            rows = [[{"found": list(found), "times": k} for found, k in sorted(coded(bag(t), index).items())] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, kind)], ["doc_id", "label", "coded"])

    got = sample.mapInArrow(run_coded, "doc_id long, label int, coded array<struct<found:array<int>,times:long>>").collect()
    rows = sorted((r["doc_id"], r["label"], [(tuple(x["found"]), x["times"]) for x in r["coded"]]) for r in got)
    return ToxicityModel(weigh(chosen, [Counter(dict(x)) for _, _, x in rows], np.array([label for _, label, _ in rows], dtype=float)))


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, offending: the places of the sentences with probability OFFENDING or more."""
    bounded_batches(df.sparkSession)
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        cache: dict[str, float] = {}
        for b in batches:
            got = [model.scored(t.as_py(), cache) for t in b.column(1)]
            offending = [[{"start": s, "end": e, "score": p} for s, e, p in hits if p >= OFFENDING] for _, hits in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.float64()), pa.array(offending, place)], ["doc_id", "score", "offending"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")
