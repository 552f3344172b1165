"""Quality rules: base statistics of a text, and robust outliers among the texts of a language and source.

Five transformed statistics (``FEATURES``) of each text that passes the base rules are held against the
minimum-covariance-determinant estimate of its pool: location and covariance of the three quarters of the
pool that lie closest together. Concentration steps find them: distances under the current estimate, the
nearest three quarters, their mean and covariance, again. They start from medians and quartiles; a last
step takes all texts within the 97.5 % ellipse. Texts beyond ``CUTOFF`` are rejected.

All rows of a pool count in every estimate, and no pool is gathered: rows are summed by (pool, step of
distance), where features are whole numbers of 1/1024 so that sums are exact in any order. A pool is one
language and source; sources with fewer than ``LEAST`` texts are pooled by language, and languages that
are still too small together. In a pool that remains too small nothing is rejected.

Defined results: a null or empty text has no words and fails the base rules. Null languages and sources
are values of their own. A feature that hardly varies is given ``FLOORS`` as its spread, so that a pool of
equal texts does not reject all others. Repeated rows count as often as they stand there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapcat.llm.common import documents, portions, row_key
from snapcat.llm.substring import Windows
from snapcat.session import settle

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The characters that count as symbols, and white space.
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Spread that each feature has at least: words, word length, symbols, repeated lines, repeated windows.
FLOORS = (0.25, 0.06, 0.05, 0.15, 0.25)
UNIT, HIGHEST = 1024, 32
SHARE, STEPS, LEAST = 0.75, 4, 100
#: Squared distance; a normal pool of five features has one in ten million beyond.
CUTOFF = 41.0
#: Pools whose estimates (300 bytes each) may be broadcast; more are joined by a shuffle, dealt over ``SALTS``.
MOST_BROADCAST, SALTS = 10_000, 32


def statistics(texts: list[str | None]) -> np.ndarray:
    """The counts of ``COUNTS`` for each text."""
    own = Windows(texts, WINDOW)
    rows = np.zeros((len(texts), 5), np.int64)
    rows[:, 0] = own.lengths
    at = np.flatnonzero(own.valid)
    if len(at):
        doc = np.searchsorted(own.starts, at, "right") - 1
        a, b = own.exact(at)
        key = a + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        key, b, doc = key[order], b[order], doc[order]
        same = (key[1:] == key[:-1]) & (b[1:] == b[:-1]) & (doc[1:] == doc[:-1])
        # Equal keys with different second hashes may stand between equal windows; such runs are sorted out one by one.
        repeated = np.zeros(len(at), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        mixed = np.flatnonzero((key[1:] == key[:-1]) & ~same)
        for k in np.unique(key[mixed]):
            span = np.flatnonzero(key == k)
            for i in span:
                repeated[i] = ((b[span] == b[i]) & (doc[span] == doc[i])).sum() > 1
        start = at[order][repeated]
        cover = np.zeros(len(own.words) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + WINDOW, -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
        rows[:, 4] = hit[own.starts + own.lengths] - hit[own.starts]
    for i, text in enumerate(texts):
        if text:
            rows[i, 1] = len(text) - sum(text.count(c) for c in SPACE)
            rows[i, 2] = sum(text.count(c) for c in SYMBOLS)
            lines = text.split("\n")
            if len(set(lines)) < len(lines):
                lines = [line for line in lines if line.strip(SPACE)]
                rows[i, 3] = len(lines) - len(set(lines))
    return rows


def measure(docs: DataFrame, text_col: str = "text", to: str = "counts") -> DataFrame:
    """Adds ``to``, the base statistics of the whole text."""
    kinds = pa.struct([(c, pa.int64()) for c in COUNTS])

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def counts(texts: pa.Array) -> pa.Array:
        found = [statistics(some) for some in portions(texts)]
        rows = np.concatenate([*found, np.zeros((0, 5), np.int64)])
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(5)], fields=list(kinds))

    return docs.withColumn(to, counts(F.col(text_col)))


def features() -> list[Column]:
    """The transformed statistics as whole numbers of 1/1024, from the columns of ``COUNTS``."""
    n = F.col("n_words")
    values = [F.log1p(n), F.log1p(F.col("word_chars") / n), *(F.sqrt(F.col(c) / n) for c in COUNTS[2:])]
    return [F.least(F.round(v * UNIT), F.lit(HIGHEST * UNIT - 1)).cast("long").alias(f"x{k}") for k, v in enumerate(values)]


def chi2(x: float, k: int) -> float:
    """Distribution function of chi-squared with k degrees of freedom, by its series."""
    term = total = 1 / math.gamma(k / 2 + 1)
    for i in range(1, 400):
        term *= x / 2 / (k / 2 + i)
        total += term
    return total * (x / 2) ** (k / 2) * math.exp(-x / 2)


def chi2_point(share: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2(middle, k) < share else (low, middle)
    return high


def widening(share: float) -> float:
    """By how much the covariance of the nearest ``share`` of a normal pool is too small."""
    return share / chi2(chi2_point(share, 5), 7)


PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
ESTIMATE = "pool string, n long, middle array<double>, inverse array<double>"


def estimates(share: float):
    """Location and inverse covariance from exact sums, a row a pool."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            m = np.maximum(column("m"), 1)
            mean = np.stack([column(f"s{i}") / m / UNIT for i in range(5)], 1)
            cov = np.zeros((len(m), 5, 5))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = column(f"s{i}{j}") / m / UNIT**2 - mean[:, i] * mean[:, j]
            inverse = np.linalg.inv(widening(share) * cov + np.diag(np.square(FLOORS)))
            yield pa.RecordBatch.from_arrays([batch.column("pool"), batch.column("n"), pa.array(list(mean)), pa.array(list(inverse.reshape(-1, 25)))], ["pool", "n", "middle", "inverse"])

    return solve


def attach(rows: DataFrame, table: DataFrame, on: list[str], n: int) -> DataFrame:
    """Joins a table with one row a key to rows that may have a third under one key."""
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.col("row_key_1"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def distance() -> Column:
    d = [F.col(f"x{k}") / UNIT - F.col("middle")[k] for k in range(5)]
    parts = [(1 if i == j else 2) * d[i] * d[j] * F.col("inverse")[5 * i + j] for i, j in PAIRS]
    return sum(parts[1:], parts[0])


def sums() -> list[Column]:
    return [F.count("*").alias("m"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(5)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS)]


SUMS = ["m", *(f"s{i}" for i in range(5)), *(f"s{i}{j}" for i, j in PAIRS)]


def pooled(rows: DataFrame) -> DataFrame:
    """Rows with their ``pool``, and a written table."""
    named = rows.withColumn("of", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))).withColumn("at", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    counts = settle(named.groupBy("of", "at").agg(F.count("*").alias("own")))
    small = counts.where(F.col("own") < LEAST).groupBy("of").agg(F.sum("own").alias("rest"))
    whole = F.concat_ws("\x01", "of", "at")
    pool = F.when(F.col("own") >= LEAST, whole).when(F.col("rest") >= LEAST, F.col("of")).otherwise(F.lit(""))
    names = settle(counts.join(small, "of", "left").select("of", "at", pool.alias("pool")))
    return settle(attach(named, names, ["of", "at"], names.count()).drop("of", "at"))


def start(rows: DataFrame) -> DataFrame:
    """Medians and quartile spreads as a first estimate. A feature has at most ``UNIT`` * ``HIGHEST`` values."""
    long = rows.select("pool", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x")) for k in range(5)))).alias("v"))
    counts = long.groupBy("pool", "v").agg(F.count("*").alias("m")).select("pool", "v.k", "v.x", "m")
    order = Window.partitionBy("pool", "k").orderBy("x")
    ranked = counts.select("*", F.sum("m").over(order).alias("upto"), F.sum("m").over(Window.partitionBy("pool", "k")).alias("n"))
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("n") * share, F.col("x"))) / UNIT
    points = ranked.groupBy("pool", "k", "n").agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"))
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("k") + 1)
    spread = F.greatest((F.col("high") - F.col("low")) / 1.349, floor)
    # Five rows a pool.
    lists = points.groupBy("pool", "n").agg(F.array_sort(F.collect_list(F.struct("k", "middle", spread.alias("spread")))).alias("v"))
    inverse = F.flatten(F.transform("v", lambda v, i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.when(i == j, 1 / v["spread"] / v["spread"]).otherwise(0.0))))
    return lists.select("pool", "n", F.transform("v", lambda v: v["middle"]).alias("middle"), inverse.alias("inverse"))


def concentrate(rows: DataFrame) -> DataFrame:
    """The estimate of every pool of at least ``LEAST`` rows, from a written table of rows."""
    estimate = settle(start(rows).where(F.col("n") >= LEAST))
    pools = estimate.count()
    for _ in range(STEPS):
        step = F.floor(8 * F.log2(distance() + 2**-20)).cast("int")
        by_step = attach(rows, estimate, ["pool"], pools).groupBy("pool", "n", step.alias("step")).agg(*sums())
        # A few hundred steps a pool; the nearest are taken until they hold the share.
        upto = F.sum("m").over(Window.partitionBy("pool").orderBy("step")) - F.col("m")
        near = by_step.withColumn("before", upto).where(F.col("before") < F.col("n") * SHARE)
        total = near.groupBy("pool", "n").agg(*(F.sum(c).alias(c) for c in SUMS))
        estimate = settle(total.mapInArrow(estimates(SHARE), ESTIMATE))
    inside = attach(rows, estimate, ["pool"], pools).where(distance() <= chi2_point(0.975, 5))
    return settle(inside.groupBy("pool", "n").agg(*sums()).mapInArrow(estimates(0.975), ESTIMATE))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``kept``, and the squared ``distance`` where one was taken, for each row."""
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), row_key(id_col, text_col)[0])
    rows = settle(measure(keyed).select("doc_id", "lang", "source", "row_key_1", "counts.*"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    passed = pooled(rows.where(~failed).select("*", *features()))
    estimate = concentrate(passed)
    out = ["doc_id", *COUNTS]
    n = estimate.count()
    known = attach(passed, estimate, ["pool"], n).select(*out, F.lit(False).alias("base_failed"), (distance() <= CUTOFF).alias("kept"), distance().alias("distance"))
    # Pools without an estimate are the one too small for it, if any.
    other = passed.join(F.broadcast(estimate.where("pool = ''").select("pool")), "pool", "left_anti").where("pool = ''")
    other = other.select(*out, F.lit(False).alias("base_failed"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("distance"))
    rest = rows.where(failed).select(*out, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return known.unionByName(other).unionByName(rest)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document."""
    return judge(documents(spark, sf_dir))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
