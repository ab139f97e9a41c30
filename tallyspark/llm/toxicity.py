"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic texts are the positives; texts about which nothing is assumed are the
unlabelled ones. The risk of a classifier g is pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), with
the class prior pi: the unlabelled risk is corrected for the positives it hides, and the
correction is kept from going below zero. The classifier is linear over hashed words. Labelled
negatives take part in nothing but the class prior.

Fitting takes a bounded sample (`MAX_POSITIVES`, `MAX_UNLABELLED` rows, drawn by a hash of
doc_id, so that the draw does not depend on the order of rows). Spark reads its features and
counts them; what reaches the driver are the features that tell the classes apart, and of each
sampled text those it has. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_class, content_key, extended, materialize, slices, word_hashes, word_spans

#: Most rows that a model is fitted on.
MAX_POSITIVES, MAX_UNLABELLED = 4_000, 16_000
FEATURE_BITS = 20
#: Beginnings of words, in bytes, that are features beside the whole words: inflected languages vary the ends.
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is used if so many positives or more have it, and its likelihood ratio against the rate in the unlabelled texts is higher (chi-squared of one degree: one in 1 900 by chance).
LEAST_POSITIVES, LEAST_RATIO = 3, 12.0
#: Tasks among which the sample is dealt.
SAMPLE_PARTS = 16
#: Steps of the fit, their size, and weight decay.
STEPS, RATE, DECAY = 400, 0.05, 1e-5
#: Letters, digits and everything beyond ASCII.
_WORD = ~byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def features(data: np.ndarray, ends: np.ndarray, kept: np.ndarray | None = None, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the distinct hashed lower-case words of each text and their beginnings, one text after another. kept: flags of the features that are wanted."""
    data = LOWER[data]
    starts, stops, first = word_spans(data, ends, _WORD)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    found = []
    for n in (0, *PREFIXES):
        longer = slice(None) if not n else np.flatnonzero(stops - starts > n)
        ids = (word_hashes(data, starts[longer], stops[longer] if not n else starts[longer] + n) >> np.uint64(64 - bits)).astype(np.int64)
        own = owner[longer]
        if kept is not None:
            wanted = kept[ids]
            ids, own = ids[wanted], own[wanted]
        found.append((own << bits) | ids)
    pairs = np.unique(np.concatenate(found))
    return (pairs & ((1 << bits) - 1)).astype(np.int64), np.searchsorted(pairs >> bits, np.arange(len(ends)))


def _logit(weights: np.ndarray, bias: float, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(weights[ids])))
    return sums[bounds[1:]] - sums[bounds[:-1]] + bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], size: int, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the non-negative risk with the logistic loss, by Adam. Both sides are (ids, bounds) with ids below size, one text after another."""
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))

    def part(rows: tuple[np.ndarray, np.ndarray], sign: int, scale: float) -> tuple[np.ndarray, float, float]:
        """Gradient of scale * mean logistic loss of sign * g, by weights and bias; and the mean loss."""
        ids, bounds = rows
        z = sign * _logit(w, bias, ids, bounds)
        slope = -sign * sigmoid(-z) * scale / len(z)
        return np.bincount(ids, np.repeat(slope, np.diff(bounds)), size), float(slope.sum()), float(np.mean(np.logaddexp(0, -z)))

    # All rows in each step: in small batches the difference of the two negative risks is mostly noise, and below zero half the time.
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        gp, bp, _ = part(positive, 1, prior)
        gn, bn, hidden = part(positive, -1, prior)
        gu, bu, loss = part(unlabelled, -1, 1.0)
        if loss - prior * hidden >= 0:
            grad, grad_b = gp + gu - gn, bp + bu - bn
        else:  # the corrected risk fell below zero: climb back instead of fitting it further
            grad, grad_b = gn - gu, bn - bu
        grad = grad + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b**2
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w = w - rate * m / (np.sqrt(v) + 1e-8)
        bias = bias - rate * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled texts, from the logits of both: the ratio of the parts above a threshold, at that threshold where its upper confidence bound is least."""
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((u + slack) / p)
    return float(u[best] / p[best])


def _sample(texts: DataFrame, sides: list[DataFrame]) -> DataFrame:
    """(side, f): the features, as packed integers, of the distinct texts of each side's doc_ids. A doc_id of several texts gives its least one."""
    rows = None
    for side, ids in enumerate(sides):  # ids are bounded by limit()
        own = texts.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(side).alias("side"), "text")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.groupBy("side", content_key(F.col("text")).alias("key")).agg(F.first("text").alias("text")).repartition(SAMPLE_PARTS, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in slices(batches):
            ids, bounds = features(data, ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["side", "f"])

    return materialize(rows.select("side", "text").mapInArrow(run, "side int, f binary"), "sample")


def _telling(sample: DataFrame, n_positive: int, n_unlabelled: int) -> list[int]:
    """Features that are more frequent in the positives than in the unlabelled texts; others would only be learnt by heart. Counted over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << FEATURE_BITS), np.int32)
        for batch in batches:
            for side, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[side][np.frombuffer(f, "<i4")] += 1  # a text's features are distinct
        for at in np.array_split(np.flatnonzero(counts.any(axis=0)), 16):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["id", "p", "u"])

    counts = sample.mapInArrow(run, "id bigint, p int, u int").groupBy("id").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    expected = (F.col("u") + 1) * F.lit(n_positive / n_unlabelled)
    ratio = 2 * (F.col("p") * F.log(F.col("p") / expected) - F.col("p") + expected)
    return sorted(r.id for r in counts.where((F.col("p") >= LEAST_POSITIVES) & (F.col("p") > expected)).where(ratio > LEAST_RATIO).select("id").collect())


def _packed(sample: DataFrame, kept: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, bounds) of both sides, with ids that count in kept."""
    place = np.full(1 << FEATURE_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    sent = sample.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sent.value[np.frombuffer(f, "<i4")] for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[x >= 0].astype("<i4").tobytes() for x in own], pa.binary())], names=["side", "f"])

    found: list[list[bytes]] = [[], []]
    for r in sample.mapInArrow(run, "side int, f binary").toLocalIterator():
        found[r.side].append(bytes(r.f))
    # In an order of their own: sums of floats must not depend on the order of tasks.
    found = [sorted(rows) for rows in found]
    return [(np.frombuffer(b"".join(rows), "<i4"), np.concatenate(([0], np.cumsum([len(f) // 4 for f in rows]))).astype(np.int64)) for rows in found]


def held_out(doc_id) -> "F.Column":
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic). The rows that held_out() picks are used neither as positives nor as unlabelled texts.

    A first fit takes the share of toxic rows among the usable labelled ones as the class prior;
    the second one the share that the first one's scores show in the unlabelled texts. Without
    positives or texts, the model says that nothing is toxic.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    prior = min(max(usable.agg(F.avg("toxic")).first()[0] or 0.0, 1e-4), 0.9)
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Which rows are drawn is settled on ids alone; only their texts are read for features.
    drawn = lambda ids, most: ids.select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)
    sample = _sample(texts, [drawn(usable.where("toxic = 1"), max_positives), drawn(texts, max_unlabelled)])
    n = {r.side: r.n for r in sample.groupBy("side").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    if len(n) < 2:
        return Model(weights, -6.0, 0.0)
    kept = _telling(sample, n[0], n[1])
    sides = _packed(sample, kept)
    w, bias = fit(*sides, len(kept), prior)
    # Labelled rows may be chosen for what they say: the prior of all texts is that which the first fit's scores show.
    prior = min(max(class_prior(*(_logit(w, bias, *side) for side in sides)), 1e-4), 0.9)
    weights[kept], bias = fit(*sides, len(kept), prior)
    return Model(weights, bias, prior)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score of every row of docs; only the text is read. Null and empty texts get the score of a text without words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = extended(rows.select("doc_id"), "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights = m.weights.astype(np.float64)
        kept = weights != 0
        for batch, data, ends in slices(batches):
            ids, bounds = features(data, ends, kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(_logit(weights, m.bias, ids, bounds)))], names=["doc_id", "score"])

    return rows.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold. Null texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights = m.weights.astype(np.float64)
        kept = weights != 0
        for batch, data, ends in slices(batches, "text"):
            ids, bounds = features(data, ends, kept)
            yield batch.filter(pa.array(sigmoid(_logit(weights, m.bias, ids, bounds)) < threshold))

    return docs.mapInArrow(run, schema)
