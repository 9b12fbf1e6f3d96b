"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its two neighbours. Fitting: all lines of a labelled
document bear its label, and the chain learns emission and transition weights by gradient ascent on
a bounded sample. Scoring: forward-backward gives each line's marginal of being good, their mean weighted by length
is the document's share of good text, and a logistic curve fitted on the same sample turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from anchorgrid.llm.common import coded, slices, words_of

OWN = 11  # features of a line itself; the neighbours' follow


def _per_line(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lengths of lines in characters + 1, first line of each text and the end)."""
    lines = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    first = lines.offsets.to_numpy().astype(np.int64)
    first = first - first[0]
    flat = lines.flatten()
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.float64)
    offsets, words = words_of(flat)
    code, distinct = coded(words)
    count = lambda p: pc.count_substring_regex(distinct, p).to_numpy(zero_copy_only=False).astype(np.float64)
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.float64) if len(distinct) else np.zeros(0)
    upper, lower, digit, symbol = (count(p) if len(distinct) else np.zeros(0) for p in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[^\p{L}\p{N}]"))
    tail = count(r"[^\p{L}\p{N}]{2,}$") if len(distinct) else np.zeros(0)
    n = np.diff(offsets).astype(np.float64)
    some, letters = np.maximum(n, 1), _per_line((upper + lower)[code], offsets)
    total = np.maximum(_per_line(chars[code], offsets), 1)
    line = np.repeat(np.arange(len(n)), np.diff(offsets))
    again = np.zeros(len(code))
    if len(code) > 1:
        again[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
    kinds = np.unique(line * np.int64(max(len(distinct), 1)) + code) // max(len(distinct), 1)
    different = np.bincount(kinds, minlength=len(n)) if len(kinds) else np.zeros(len(n))
    shouted = ((upper >= 2) & (lower == 0)).astype(np.float64)
    own = np.stack([
        _per_line(upper[code], offsets) / np.maximum(letters, 1),
        _per_line(shouted[code], offsets) / some,
        _per_line(again, offsets) / some,
        np.where(n >= 8, 1 - different / some, 0.0),
        _per_line((symbol == chars).astype(np.float64)[code], offsets) / some,
        _per_line(tail[code], offsets) / some,
        _per_line(symbol[code], offsets) / total,
        _per_line(digit[code], offsets) / total,
        np.minimum(total / some, 30) / 10,
        np.log1p(n) / 5,
        (n == 0).astype(np.float64),
    ], axis=1)
    edge = np.zeros(len(n), bool)
    edge[first[:-1][np.diff(first) > 0]] = True
    before = np.vstack([np.zeros((1, OWN)), own[:-1]])[: len(own)] * ~edge[:, None]
    last = np.append(edge[1:], True)[: len(own)]
    after = np.vstack([own[1:], np.zeros((1, OWN))])[: len(own)] * ~last[:, None]
    return np.hstack([own, before, after, np.ones((len(n), 1))]), length + 1, first


def forward_backward(gain: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log partition of each chain, marginal of state 1 for each line, expected transitions [2, 2]).

    ``gain`` is the emission of state 1 over state 0, ``start`` that of the first line's state. All chains step together, those that have ended drop out.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    alpha = np.zeros((len(gain), 2))
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # chains with more than t lines
    for t in range(steps):
        at = starts[: alive[t]] + t
        if t == 0:
            alpha[at, 1] = start + gain[at]
            continue
        a = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
        alpha[at, 1] = np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1]) + gain[at]
    ends = starts + sizes - 1
    log_z = np.zeros(len(sizes))
    full = sizes > 0
    log_z[order[full]] = np.logaddexp(alpha[ends[full], 0], alpha[ends[full], 1])
    beta = np.zeros((len(gain), 2))
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = starts[: alive[t]] + t
        b, z = beta[at], log_z[order[: alive[t]]]
        to = np.stack([b[:, 0], b[:, 1] + gain[at]], axis=1)
        for s in (0, 1):
            beta[at - 1, s] = np.logaddexp(trans[s, 0] + to[:, 0], trans[s, 1] + to[:, 1])
            for u in (0, 1):
                pairs[s, u] += np.exp(alpha[at - 1, s] + trans[s, u] + to[:, u] - z).sum()
    marginal = 1 / (1 + np.exp(np.clip(alpha[:, 0] + beta[:, 0] - alpha[:, 1] - beta[:, 1], -500, 500)))
    return log_z, marginal, pairs


def _share(marginal: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each document."""
    return _per_line(marginal * length, first) / np.maximum(_per_line(length, first), 1)


@dataclass
class LineField:
    """A fitted field: standardisation, emission weights, transitions, start and the curve from share to probability."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    start: float
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        x, length, first = line_features(texts)
        _, marginal, _ = forward_backward((x - self.mean) / self.deviation @ self.weights, first, self.trans, self.start)
        return 1 / (1 + np.exp(-(self.slope * _share(marginal, length, first) + self.shift)))


def fit(texts: pa.Array, labels: np.ndarray, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> LineField:
    """Fit by Adam on the penalised log likelihood of the label sequences. Without rows the field scores 0.5."""
    # in pieces, so that only the features of lines are held at once and not those of words
    pieces = [line_features(b.column(0)) for b in slices(iter([pa.record_batch([texts], names=["text"])]), "text")] or [line_features(texts)]
    x, length = np.vstack([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in pieces]))]).astype(np.int64)
    del pieces
    mean, deviation = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    mean[-1], deviation[-1] = 0.0, 1.0  # the constant
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    x = (x - mean) / deviation
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    y = labels[doc].astype(np.float64) if len(labels) else np.zeros(0)
    seen = np.zeros((2, 2))
    for s in (0, 1):
        seen[s, s] = (np.diff(first) - 1)[labels == s].sum()
    theta = np.zeros(x.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1 if len(labels) else 1):
        weights, trans, start = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
        _, marginal, pairs = forward_backward(x @ weights, first, trans, start)
        slope = np.concatenate([x.T @ (y - marginal), (seen - pairs).ravel(), [(y - marginal)[first[:-1]].sum()]]) / len(y) - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights, trans, start = theta[:-5], theta[-5:-1].reshape(2, 2), float(theta[-1])
    a = b = 0.0
    if len(labels):
        share = _share(forward_backward(x @ weights, first, trans, start)[1], length, first)
        for _ in range(50):  # Newton steps of a logistic curve with a small penalty on its slope
            p = 1 / (1 + np.exp(-(a * share + b)))
            g = np.array([(share * (labels - p)).sum() - 0.05 * a, (labels - p).sum() - 1e-3 * b])
            w = p * (1 - p)
            h = np.array([[(w * share**2).sum() + 0.05, (w * share).sum()], [(w * share).sum(), w.sum() + 1e-3]])
            move = np.linalg.solve(h, g)
            a, b = a + float(np.clip(move[0], -5, 5)), b + float(np.clip(move[1], -5, 5))
    return LineField(mean, deviation, weights, trans, start, a, b)


def training_rows(documents: DataFrame, labels: DataFrame, most: int, most_chars: int) -> DataFrame:
    """(text, quality) of at most ``most`` labelled documents outside the held-out fifth, taken by the hash of the doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out("doc_id")).dropDuplicates(["doc_id"])
    known = known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(most)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= most_chars)
    return docs.join(F.broadcast(known), "doc_id").orderBy("doc_id").select("text", "quality")  # `most` rows of two numbers are broadcast


def held_out(doc_id: str):
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, most: int = 2000, most_chars: int = 100_000) -> LineField:
    """A field fitted on the driver: at most ``most`` texts of at most ``most_chars`` characters."""
    rows = training_rows(documents, labels, most, most_chars).toArrow()
    return fit(rows.column("text").combine_chunks(), rows.column("quality").to_numpy().astype(np.int64))


def _scorer(field: LineField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = batch.schema.names.index("score")
            yield batch.set_column(at, "score", pa.array(field.scores(batch.column("text"))))

    return run


def score_quality(documents: DataFrame, field: LineField, threshold: float = 0.3) -> DataFrame:
    """``documents`` with score (double, 0 to 1) and predicted (int, 1 where score >= ``threshold``).

    Only the text is read for the score. A null or empty text is one empty line and has a score like any other; rows alike
    get equal scores; other columns pass unchanged, those named score or predicted are replaced.
    """
    rows = documents.drop("score", "predicted").withColumn("score", F.lit(0.0).cast("double"))
    scored = rows.mapInArrow(_scorer(field), rows.schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
