"""A quality classifier from positives and unlabelled text only.

Trusted positives are the texts that a label calls good; all texts, labels ignored, are the unlabelled sample of the web.
With p as the share of good texts in it, what the positives cost as negatives is known, and the risk of a classifier is

    p * mean over P of l(z)  +  max(0,  mean over U of l(-z)  -  p * mean over P of l(-z))

with the logistic loss l(z) = log(1 + exp(-z)). The second term, the risk on bad texts, cannot be negative; the maximum keeps it
from being fitted below zero. For a score z that is linear in its weights l(z) - l(-z) = -z, so the whole is the larger of two convex
functions. The maximum is smoothed over ``SMOOTH``, and Newton steps, halved where they go too far, find the one minimum in a
few passes over all rows. Every pass is a sum over rows of the losses, gradients and curvatures: 2 * ``WIDTH`` ** 2 numbers a task, added up
by row of the matrices. Nothing is sampled.

The share p is estimated by best bin estimation: above any threshold of the score the share of U is at least p
times the share of P, and where no bad text scores as high the two are equal. The threshold with the least upper bound of
their ratio gives p. The score is fitted to half of the rows, by a hash of their features, and the shares are those of the other half, where
trusted positives score no higher than other good texts. Fitting and estimating take turns ``ROUNDS`` times; the last fit is to all rows.

A text is described by shares between 0 and 1 (``FEATURES``): of kinds of characters, words and lines, and of what repeats. Each
becomes ``KNOTS`` hat functions, so that a weight is learnt for every height of it. The score is 1 / (1 + exp(-z)), which estimates
the chance that the text is good.

Defined results: null texts are empty; an empty text has the features of no words and gets a score like any other. A row is a trusted
positive if its id has labels and all are 1; null ids have none. Repeated rows count as often as they stand there. Without any positive
every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.common import documents, word_blocks
from snapcat.llm.langid import held_out
from snapcat.session import settle

#: Predicted good from this score on.
GOOD = 0.7
KNOTS, ROUNDS, STEPS, RIDGE, SMOOTH = 7, 3, 25, 3e-3, 0.03
#: Thresholds of the score that are tried, and the confidence of the bound.
BINS, CONFIDENCE = 1000, 0.1

FEATURES = ("words", "word_length", "distinct", "most_frequent", "repeats_last", "pairs_repeated", "capital_letters", "capital_words", "digits", "ends", "marks", "symbols",
            "bare_words", "odd_ends", "other_bytes", "line_words", "lines_repeated", "lines_unended")
WIDTH = 1 + len(FEATURES) * KNOTS

#: Characters that end sentences or clauses, that join or quote, and all other marks of ASCII.
ENDS, MARKS = b".,;:", b"'\"()-?"
SYMBOLS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in ENDS + MARKS)
UPPER, LOWER, DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
KINDS = np.zeros((256, 7))
for column, kind in enumerate((UPPER, LOWER, DIGITS, ENDS, MARKS, SYMBOLS, range(0x80, 0xC0))):
    KINDS[list(kind), column] = 1
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def describe(text: str | None) -> list[float]:
    """The features of a whole text."""
    raw = (text or "").encode()
    upper, lower, digits, ends, marks, symbols, later = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ KINDS
    other = np.frombuffer(raw, np.uint8).size - upper - lower - digits - ends - marks - symbols
    words: Counter[bytes] = Counter()
    pairs: set[int] = set()
    n = size = adjacent = capital = bare = odd = 0
    for block, own in enumerate(word_blocks(raw, 1)):
        before, fresh = (own[:1], own[1:]) if block else ([], own)
        words.update(fresh)
        n += len(fresh)
        size += sum(map(len, fresh))
        line = before + fresh
        adjacent += sum(map(bytes.__eq__, line, line[1:]))
        pairs.update(map(hash, zip(line, line[1:], strict=False)))
    for word, times in words.items():
        capital += times * word.isupper()
        bare += times * (LETTER.search(word) is None)
        odd += times * (word[-1] in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    unended = sum(line.rstrip()[-1] not in b".!?:" for line in lines)
    some, letters, characters = max(n, 1), max(upper + lower, 1), max(len(raw) - later, 1)
    return [
        min(np.log2(1 + n) / 14, 1), min(size / some / 20, 1), len(words) / some, max(words.values(), default=0) / some, adjacent / max(n - 1, 1),
        1 - len(pairs) / max(n - 1, 1) if n > 1 else 0, upper / letters, capital / some, digits / characters, ends / characters, marks / characters, symbols / characters,
        bare / some, odd / some, other / max(len(raw), 1), min(np.log2(1 + n / max(len(lines), 1)) / 10, 1), 1 - len(set(lines)) / max(len(lines), 1), unended / max(len(lines), 1)]


def hats(x: np.ndarray) -> np.ndarray:
    """For each row a constant and the hat functions of the square root of each of its features: two are not zero."""
    place = np.sqrt(np.clip(x, 0, 1)) * (KNOTS - 1)
    heights = np.maximum(0, 1 - np.abs(place[:, :, None] - np.arange(KNOTS)))
    return np.concatenate([np.ones((len(x), 1)), heights.reshape(len(x), WIDTH - 1)], 1)


def described(docs: DataFrame, text_col: str = "text", to: str = "x") -> DataFrame:
    """Adds ``to``, the features."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([describe(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return docs.withColumn(to, of(F.col(text_col)))


def matrix(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = rows.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
    return hats(x), rows.column("positive").to_numpy(zero_copy_only=False)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


#: Rows of what a pass sums: numbers and losses, three gradients, the curvature of P, that of U.
LOSSES, OF_P, OF_U = 0, 4, 4 + WIDTH


def pass_over(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Sums over all rows: [0] numbers of P and U, loss of P as good, as bad, of U as bad; [1:4] their gradients; then the curvatures."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((OF_U + WIDTH, WIDTH))
        for batch in batches:
            x, p = matrix(batch)
            z = x @ weights
            s = sigmoid(z)
            total[LOSSES, :5] += [p.sum(), len(p), softplus(-z[p]).sum(), softplus(z[p]).sum(), softplus(z).sum()]
            total[1:4] += [(s[p] - 1) @ x[p], s[p] @ x[p], s @ x]
            curved = x * (s * (1 - s))[:, None]
            total[OF_P:OF_U] += curved[p].T @ x[p]
            total[OF_U:] += curved.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], ["k", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sums = batch.column("sums").flatten().to_numpy().reshape(-1, WIDTH)
            for k, row in zip(batch.column("k").to_pylist(), sums, strict=True):
                held[k] = held[k] + row if k in held else row.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["k", "sums"])

    kinds = "k int, sums array<double>"
    out = np.zeros((OF_U + WIDTH, WIDTH))
    for r in rows.mapInArrow(own, kinds).repartition("k").mapInArrow(added, kinds).collect():
        out[r.k] = r.sums
    return out


def fit(rows: DataFrame, prior: float, weights: np.ndarray) -> np.ndarray:
    """Weights of the least non-negative risk, from a written table with x and positive."""
    best, least, step = weights, np.inf, np.zeros(WIDTH)
    ridge = RIDGE * np.append(0, np.ones(WIDTH - 1))
    for _ in range(STEPS):
        sums = pass_over(rows, weights)
        n_p, n_u, good, as_bad, all_bad = sums[LOSSES, :5]
        if not n_p:
            return weights
        bad = all_bad / n_u - prior * as_bad / n_p
        risk = prior * good / n_p + SMOOTH * softplus(bad / SMOOTH) + 0.5 * (ridge * weights**2).sum()
        if risk >= least:
            step = step / 2
        else:
            gain, best, least = least - risk, weights, risk
            if gain < 1e-6 * least:
                break
            # How much of the second term counts: all where it is clearly above zero, none where it is clearly below.
            part, of_p = sigmoid(bad / SMOOTH), prior / n_p
            rise = sums[3] / n_u - of_p * sums[2]
            slope = of_p * sums[1] + part * rise + ridge * weights
            curve = (1 - part) * of_p * sums[OF_P:OF_U] + part * sums[OF_U:] / n_u + part * (1 - part) / SMOOTH * np.outer(rise, rise)
            step = -np.linalg.solve(curve + np.diag(ridge + 1e-6), slope)
        weights = best + step
    return best


def estimate_prior(rows: DataFrame, weights: np.ndarray) -> float:
    """The share of good texts among all, by best bin estimation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            x, positive = matrix(batch)
            place = np.minimum((sigmoid(x @ weights) * BINS).astype(int), BINS - 1)
            total += [np.bincount(place[positive], minlength=BINS), np.bincount(place, minlength=BINS)]
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])], ["bin", "p", "u"])

    total = np.zeros((2, BINS))
    for r in rows.mapInArrow(count, "bin int, p long, u long").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect():
        total[:, r.bin] = r.p, r.u
    n_p, n_u = total.sum(1)
    if not n_p:
        return 0.5
    # Shares at or above each threshold.
    p, u = (np.cumsum(t[::-1])[::-1] / n for t, n in zip(total, (n_p, n_u), strict=True))
    slack = np.sqrt(np.log(4 / CONFIDENCE) / 2 / n_u) + np.sqrt(np.log(4 / CONFIDENCE) / 2 / n_p)
    some = p > 0
    at = np.argmin((u[some] + slack) / p[some])
    return float(np.clip(u[some][at] / p[some][at], 0.01, 0.99))


class Model:
    def __init__(self, weights: np.ndarray, prior: float | None):
        self.weights, self.prior = weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(hats(x) @ self.weights) if self.prior is not None else np.zeros(len(x))


def learn(rows: DataFrame) -> Model:
    """From a written table with x (features) and positive; every row is one of the unlabelled."""
    weights, prior = np.zeros(WIDTH), None
    if rows.where("positive").isEmpty():
        return Model(weights, prior)
    first = F.pmod(F.xxhash64("x"), F.lit(2)) == 0
    prior = 0.5
    for _ in range(ROUNDS):
        weights = fit(rows.where(first), prior, weights)
        prior = estimate_prior(rows.where(~first), weights)
    return Model(fit(rows, prior, weights), prior)


def scored(rows: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """Adds ``to``, between 0 and 1, to rows with features."""

    @F.arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(model.scores(x.flatten().to_numpy().reshape(-1, len(FEATURES))))

    return rows.withColumn(to, of(F.col("x")))


def with_positives(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """id, x and positive of every row of ``docs``, as a written table."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(F.col(quality_col) == 1, F.lit(False))).alias("positive"))
    own = settle(described(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).drop("text"))
    return settle(own.join(good.where("positive"), "id", "left").select("id", "x", F.coalesce("positive", F.lit(False)).alias("positive")))


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; those held out take no part in the learning, labelled or not."""
    rows = with_positives(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = learn(rows.where(~held_out("id")))
    return scored(rows, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES = {"op11_pu_quality": op11_pu_quality}
ORACLES: dict[str, str] = {}
