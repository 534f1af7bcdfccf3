"""Text quality by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprint.session import broadcast_if_small, spread

BINS = 1024
SHAPES = 17
FIT_ROWS = 8_000
STEPS = 600
DEFAULT_PRIOR = 0.5
_KIND = np.zeros(256, np.int64)  # letter, upper case, digit, white space, line end, byte of a longer character, other
for _low, _high, _k in ((0, 255, 6), (97, 122, 0), (65, 90, 1), (48, 57, 2), (9, 13, 3), (32, 32, 3), (10, 10, 4),
                        (128, 255, 5)):
    _KIND[_low:_high + 1] = _k


def features(text: str) -> np.ndarray:
    """Square roots of shares of hashed byte pairs, and measures of a text's shape: kinds of bytes, different words and
    lines, words that end in a sign, lengths, words and lines equal to one just before. An empty text has zeros only."""
    out = np.zeros(BINS + SHAPES, np.float32)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return out
    pairs = np.zeros(BINS, np.int64)
    kinds = np.zeros(7, np.int64)
    for at in range(0, len(data), 1 << 18):
        part = data[at:at + (1 << 18) + 1].astype(np.int64)
        pairs += np.bincount((part[:-1] * 37 + part[1:] * 101 + (part[:-1] * part[1:] >> 5)) % BINS, minlength=BINS)
        kinds += np.bincount(_KIND[part[:1 << 18]], minlength=7)
    out[:BINS] = np.sqrt(pairs / max(1, pairs.sum()))
    words, lines = text.split(), text.split("\n")
    different = len(set(words))
    signs = sum(not w[-1].isalnum() for w in words)
    n = max(1, len(words))
    again = [sum(map(operator.eq, words[k:], words)) / n for k in (1, 2)]
    again.append(sum(map(operator.eq, lines[1:], lines)) / len(lines))
    out[BINS:] = [*(kinds / len(data)), different / n, len(set(lines)) / len(lines), signs / n,
                  min(1.0, len(text) / n / 20), np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, 1.0,
                  *np.sqrt(again)]
    return out


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


def risk_gradient(weight: np.ndarray, bias: float, p: np.ndarray, u: np.ndarray, prior: float | None,
                  ) -> tuple[float, float, np.ndarray, float]:
    """Positive and negative part of the risk at a linear score f, and the gradient of the step (weight, bias).

    With a prior: prior * E_p[l(f)] and E_u[l(-f)] - prior * E_p[l(-f)], l logistic; where the second is below 0 the step
    goes up that part alone. Without one, positives are told apart from unlabelled rows: E_p[l(f)] and E_u[l(-f)].
    """
    fp, fu = p @ weight + bias, u @ weight + bias
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    part = 1.0 if prior is None else prior
    taken = 0.0 if prior is None else prior
    positive = part * np.logaddexp(0, -fp).mean()
    negative = np.logaddexp(0, fu).mean() - taken * np.logaddexp(0, fp).mean()
    # l'(f) = s - 1 for positives, s for the others.
    gp, gu = part * (sp - 1) / len(p) - taken * sp / len(p), su / len(u)
    if negative < 0:
        gp, gu = taken * sp / len(p), -su / len(u)
    return float(positive), float(negative), p.T @ gp + u.T @ gu, float(gp.sum() + gu.sum())


@dataclass
class Sample:
    """Rows of features, how often each occurs, and the half of all texts that it belongs to."""

    x: np.ndarray
    count: np.ndarray
    half: np.ndarray

    def part(self, half: int) -> Sample:
        at = self.half == half
        return Sample(self.x[at], self.count[at], self.half[at])

    def draw(self, source: np.random.Generator, rows: int) -> np.ndarray:
        ends = np.cumsum(self.count)
        at = np.searchsorted(ends, source.integers(0, ends[-1], min(rows, int(ends[-1]))), side="right")
        return self.x[at].astype(np.float64)


def learn(positive: Sample, unlabelled: Sample, prior: float | None, steps: int = STEPS, decay: float = 1e-4,
          rate: float = 0.05, batch: int = 2048, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]), l logistic.

    When the part for negatives falls below 0, the step goes up that part alone, which undoes the overfitting. The model
    is the mean of the second half of all steps, since single steps near that border go to and fro.
    """
    model = Model(np.zeros(BINS + SHAPES, np.float64), 0.0, DEFAULT_PRIOR if prior is None else prior)
    if not len(positive.x) or not len(unlabelled.x):
        return model
    draw = np.random.default_rng(seed)
    first, second, mean, b1, b2 = *np.zeros((3, BINS + SHAPES + 1)), 0.9, 0.999
    for step in range(1, steps + 1):
        p, u = positive.draw(draw, batch), unlabelled.draw(draw, batch)
        _, _, slope, lift = risk_gradient(model.weight, model.bias, p, u, prior)
        grad = np.append(slope + decay * model.weight, lift)
        first, second = b1 * first + (1 - b1) * grad, b2 * second + (1 - b2) * grad ** 2
        move = rate * (first / (1 - b1 ** step)) / (np.sqrt(second / (1 - b2 ** step)) + 1e-8)
        model.weight -= move[:-1]
        model.bias -= float(move[-1])
        if 2 * step > steps:
            mean += np.append(model.weight, model.bias)
    mean /= max(1, steps - steps // 2)
    return Model(mean[:-1], float(mean[-1]), model.prior)


def mixture_share(positive: np.ndarray, positive_count: np.ndarray, unlabelled: np.ndarray,
                  unlabelled_count: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows from scores alone: above every bound c the unlabelled rows hold at
    least share * P(positive score >= c), so U(c) / P(c) is an upper estimate. It is read where that ratio and its
    confidence width together are smallest. Rows weigh by their counts; the width goes by different rows."""
    bounds = np.unique(positive)

    def above(scores: np.ndarray, count: np.ndarray) -> np.ndarray:
        order = np.argsort(scores)
        ends = np.append(0, np.cumsum(count[order]))
        return 1 - ends[np.searchsorted(scores[order], bounds, side="left")] / ends[-1]

    p, u = above(positive, positive_count), above(unlabelled, unlabelled_count)
    width = sum(np.sqrt(np.log(4 / doubt) / 2 / len(s)) for s in (positive, unlabelled))
    return float((u / p)[np.argmin((u + width) / p)])


def class_prior(positive: Sample, unlabelled: Sample) -> float:
    """The share of quality 1 in unlabelled text, from trusted positives and unlabelled texts only: a classifier learns to
    tell them apart on each half of the texts, the share is read from its scores on the other half; the mean of both.
    Kept within 0.01 and 0.99; DEFAULT_PRIOR where a half has no rows."""
    found = []
    for half in (0, 1):
        p, u, p2, u2 = (s.part(h) for h in (half, 1 - half) for s in (positive, unlabelled))
        if min(len(s.x) for s in (p, u, p2, u2)):
            model = learn(p, u, None)
            found.append(mixture_share(model.score(p2.x), p2.count, model.score(u2.x), u2.count))
    return min(0.99, max(0.01, float(np.mean(found)))) if found else DEFAULT_PRIOR


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, prior: float | None = None) -> Model:
    """Learn from `docs` (doc_id, text) and the trusted rows `labels` (doc_id, quality).

    Trusted positives are the documents with quality 1; every document is unlabelled web text. Both are bounded samples
    of about `fit_rows` rows by a hash of id and text; equal texts come to the driver once, with their count. The class
    prior is estimated from the two samples (`class_prior`), unless given. Documents labelled 0 are used for nothing.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    good = good.select("doc_id")
    texts = docs.select("doc_id", "text").where("text is not null")
    total, ones = texts.count(), texts.join(good, "doc_id", "left_semi").count()
    # Either the draw leaves few texts for the look-up, or there are few positives to look up.
    good = broadcast_if_small(good, fit_rows)
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = [texts.where(draw < min(1.0, fit_rows / max(1, size))) for size in (ones, total)]
    marked = [d.select("text", F.lit(p).alias("p"), F.lit(1 - p).alias("u"))
              for d, p in ((drawn[0].join(good, "doc_id", "left_semi"), 1), (drawn[1], 0))]
    # Equal texts of a sample are one row; the texts themselves stay on the workers.
    counted = marked[0].unionByName(marked[1]).groupBy("text").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counted = counted.repartition(docs.sparkSession.sparkContext.defaultParallelism, "text").withColumn("key", F.xxhash64("text"))
    found = counted.mapInArrow(_features, "x binary, p bigint, u bigint, key bigint").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, BINS + SHAPES).astype(np.float32)
    p, u, key = (found.column(c).to_numpy().astype(np.int64) for c in ("p", "u", "key"))
    # Rows come back in no fixed order; draws go by position.
    order = np.argsort(key)
    kept = [order[n[order] > 0] for n in (p, u)]
    positives, unlabelled = (Sample(x[at], n[at], key[at] & 1) for at, n in zip(kept, (p, u)))
    return learn(positives, unlabelled, class_prior(positives, unlabelled) if prior is None else prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *batch.columns[1:]], names=["x", "p", "u", "key"])


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [np.empty(0)]
            for at in range(0, batch.num_rows, 256):
                x = np.array([features(t.as_py() or "") for t in batch.column(0).slice(at, 256)])
                score.append(model.score(x.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(score), pa.float64())],
                                             names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every document with `score`: the estimated probability that its quality is 1.

    Defined cases: a null text counts as empty, an empty one has the score of the bias alone; whole texts are read,
    whatever their length; without positives or texts to learn from every score is 0.5; repeated rows and nulls in
    other columns pass through.
    """
    place = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(p) for c, p in zip(keep, place, strict=True)])
    kinds = "".join(f"{p} {docs.schema[c].dataType.simpleString()}, " for c, p in zip(keep, place, strict=True))
    scored = spread(rows, *place[:1]).mapInArrow(_score(model), f"{kinds}score double")
    return scored.select(*[F.col(p).alias(c) for c, p in zip(keep, place, strict=True)], "score")
