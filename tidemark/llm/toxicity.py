"""Severity of toxic texts by cumulative-link ordinal regression on sparse word features.

P(grade <= k | x) is the logistic function of (cut k - w.x): one set of weights for all grades, cuts in ascending
order. x has log(1 + n) for each of a document's features, the words and word heads of 4 to 6 letters that were found
to go with toxic or with other texts. The severity is the expected grade.

Grades are labels, never derived from the text: a column `grade` with whole numbers from 0 (not toxic), as many and as
far apart as raters gave, or, where there is only a mark, `toxic` as grades 0 and 1; the severity then is between these.
A grade that no label has is no threshold of the model.

The model is fitted on a bounded sample of labelled rows (SAMPLE, by the hash of the key); scoring is one pass over
whole texts without a shuffle.

Defined results: a null or empty text has no features and the severity of the cuts alone. Null labels are left out, of
repeated ones the highest counts. Without labels of two grades nothing is rejected and severities are 0. Repeated
documents are rows of their own; other columns pass through filter_documents unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, bounded_texts, slices, release

#: Labelled documents that the model is fitted on, at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 6_000, 96_000_000
HEADS = (4, 5, 6)
#: Documents of the sample that have a feature, at least, and its chi-square with the label, at least.
LEAST_DOCS, LEAST_CHI2 = 5, 20.0
#: Probability of grade 1 or more from which a document is rejected.
REJECT = 0.5


def _features(texts: pa.Array) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """For whole words and each length of head: strings by distinct word (null: shorter); each word's index and document."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    cut = pc.split_pattern_regex(lower, r"[^\pL]+")
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(cut.offsets)))
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary
    size = pc.utf8_length(words)
    none = pa.scalar(None, pa.large_string())
    kinds = [pc.if_else(pc.greater(size, 0), pc.binary_join_element_wise(words, pa.scalar("=", pa.large_string()), pa.scalar("", pa.large_string())), none)]
    kinds += [pc.if_else(pc.greater_equal(size, n), pc.utf8_slice_codeunits(words, 0, n), none) for n in HEADS]
    return kinds, np.asarray(coded.indices), doc


def _counts(texts: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, occurrences), sparse."""
    kinds, at, doc = _features(texts)
    keys = []
    for kind in kinds:
        index = np.asarray(pc.fill_null(pc.index_in(kind, value_set=names), -1)).astype(np.int64)
        feature = index[at]
        hit = np.flatnonzero(feature >= 0)
        keys.append(doc[hit] * len(names) + feature[hit])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // max(1, len(names)), key % max(1, len(names)), n


class Model:
    """Weights of named features, the levels (grades that occur, from 0) and a cut between each two of them."""

    def __init__(self, names: list[str], weights: np.ndarray, cuts: np.ndarray, levels: np.ndarray):
        self.names, self.weights, self.cuts, self.levels = names, weights, cuts, levels

    def above(self, texts: pa.Array) -> np.ndarray:
        """For each text, P(grade above level k) of each level but the last."""
        score = np.zeros(len(texts))
        if self.names:
            doc, feature, n = _counts(texts, pa.array(self.names, pa.large_string()))
            score = np.bincount(doc, np.log1p(n) * self.weights[feature], len(texts))
        return 1 / (1 + np.exp(np.clip(self.cuts - score[:, None], -50, 50)))

    def severity(self, above: np.ndarray) -> np.ndarray:
        """The expected grade."""
        return above @ np.diff(self.levels)


def _select(texts: pa.Array, toxic: np.ndarray) -> list[str]:
    """Features that go with toxic (1) or with other texts (0)."""
    kinds, at, doc = _features(texts)
    names = []
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    for kind in kinds:
        coded = kind.dictionary_encode()
        index = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64)[at]
        hit = index >= 0
        pair = np.unique(index[hit] * len(texts) + doc[hit])
        feature, of = pair // len(texts), pair % len(texts)
        both = np.bincount(feature, minlength=len(coded.dictionary))
        a = np.bincount(feature, toxic[of], len(both))
        b = both - a
        chi2 = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n0 + n1) / np.maximum(1, both * (n0 + n1 - both) * n0 * n1)
        keep = np.flatnonzero((both >= LEAST_DOCS) & (chi2 >= LEAST_CHI2))
        names += coded.dictionary.take(pa.array(keep)).to_pylist()
    return names


def cuts_of(free: np.ndarray) -> np.ndarray:
    """Ascending cuts: the first one, and the logarithms of the steps between them."""
    return free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:]))))


def likelihood(w: np.ndarray, free: np.ndarray, doc: np.ndarray, feature: np.ndarray, x: np.ndarray, grade: np.ndarray, penalty: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of the grades (0, 1, ...) less the L2 penalty, and its gradients by w and by free."""
    n, rows, cuts = len(grade), np.arange(len(grade)), cuts_of(free)
    score = np.bincount(doc, x * w[feature], n)
    below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -50, 50)))
    edge = np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1)
    slope = edge * (1 - edge)
    p = np.maximum(edge[rows, grade + 1] - edge[rows, grade], 1e-12)
    up, low = slope[rows, grade + 1] / p, slope[rows, grade] / p
    by_score = (low - up) / n
    by_cut = np.array([(up * (grade == k)).sum() - (low * (grade == k + 1)).sum() for k in range(len(cuts))]) / n
    by_w = np.bincount(feature, x * by_score[doc], len(w)) - penalty * w
    tail = np.cumsum(by_cut[::-1])[::-1]  # a step moves its cut and all after it
    return float(np.log(p).mean() - penalty / 2 * (w * w).sum()), by_w, np.concatenate((tail[:1], tail[1:] * np.exp(free[1:])))


def train(texts: pa.Array, grades: np.ndarray, steps: int = 400) -> Model:
    """Fits the model by full-batch Adam on the penalised likelihood."""
    levels, grade = np.unique(np.asarray(grades, np.int64), return_inverse=True)
    if len(levels) < 2:
        return Model([], np.zeros(0), np.full(1, 50.0), np.arange(2))
    names = _select(texts, (grade > 0).astype(np.int64))
    if not names:
        return Model([], np.zeros(0), np.full(len(levels) - 1, 50.0), levels)
    doc, feature, n = _counts(texts, pa.array(names, pa.large_string()))
    x, m = np.log1p(n), len(names)
    free = np.zeros(m + len(levels) - 1)
    free[m] = 2.0
    first, second = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        _, by_w, by_free = likelihood(free[:m], free[m:], doc, feature, x, grade)
        g = np.concatenate((by_w, by_free))
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        free += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    return Model(names, free[:m], cuts_of(free[m:]), levels)


def grade_of(labels: DataFrame) -> F.Column:
    """The grade of a label: its column grade or, without one, its mark toxic."""
    return F.col("grade" if "grade" in labels.columns else "toxic").cast("long")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """labels: key and grade, or key and toxic (0 or 1)."""
    known = labels.select(F.col(key).alias("key"), grade_of(labels).alias("grade")).where("key is not null and grade is not null").groupBy("key").agg(F.max("grade").alias("grade"))
    chosen = bounded_sample(known, sample, "key")  # bounded, so it may be broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    rows = bounded_texts(rows, sample, SAMPLE_BYTES, "text", "key", "text").toArrow()  # a key may have several texts
    model = train(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), np.asarray(rows["grade"]))
    del rows
    release()  # the driver has more to do
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, p_toxic (a grade above 0), severity (expected grade), grade (most likely) and rejected."""
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # features of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            model = known.value
            above = model.above(batch["text"])
            edge = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1)
            grade = model.levels[(edge[:, :-1] - edge[:, 1:]).argmax(axis=1)]
            yield pa.record_batch([batch["key"], pa.array(above[:, 0].round(6)), pa.array(model.severity(above).round(6)), pa.array(grade, pa.int32()), pa.array(above[:, 0] >= REJECT)], names=["key", "p_toxic", "severity", "grade", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, p_toxic double, severity double, grade int, rejected boolean").withColumnRenamed("key", key)


def filter_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not rejected, all their columns unchanged."""
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(known.value.above(batch[text])[:, 0] < REJECT))

    return docs.mapInArrow(run, docs.schema)
