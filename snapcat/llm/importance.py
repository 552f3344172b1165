"""Resampling towards a target distribution, by importance weights over hashed n-grams.

Features of a text are all its runs of 1 to ``WORDS`` words, joined by one space; the bucket of a feature is its
CRC-32 modulo ``BUCKETS``. A text is normalised to words joined by single spaces and scanned once; the CRC of every
prefix that ends with a word is kept. The CRC of a run is the CRC of the prefix that ends with it less that of the
prefix before it, shifted by the bytes of the run: shifting is linear over GF(2), so the earlier prefix cancels
out. No run is ever cut out or hashed by itself. Shifts by fewer than 256 bytes are tables made from the polynomial,
longer ones are composed of powers of two.

The counts of a bucket in the corpus and in the target give its gain; the weight of a document is the mean gain of
its features. Gumbel noise that depends on the id alone makes the documents with the highest scores a sample drawn
in proportion to the weights, without replacement.

Bounds: the two tables of counts have ``BUCKETS`` rows. Scores are whole numbers between about -100,000 and 100,000, so
the driver may read how many documents have each of them to find the least score drawn. Ranks come from a sort into
ranges with the id and a hash of the text as further keys, and the counts of the ranges.

Defined results: null texts and texts without words have no feature and weight 0. A null id is the empty string under
the noise, and comes after all others among ties. Equal rows get equal scores and consecutive ranks. An empty target or corpus
counts 0 everywhere. Texts of many words are scanned in blocks; memory does not grow with a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapcat.llm.common import documents, word_blocks
from snapcat.llm.decontaminate import PLAIN
from snapcat.session import settle

WORDS, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Words that a worker holds at a time.
HELD = 1 << 17

POLYNOMIAL = 0xEDB88320
#: The remainder of each byte, and the shift by 0 to 255 bytes of each byte of a CRC.
BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    BYTE = BYTE >> np.uint32(1) ^ (BYTE & np.uint32(1)) * np.uint32(POLYNOMIAL)
PLACES = np.arange(4, dtype=np.uint32) * np.uint32(8)


def past_zero(crc: np.ndarray) -> np.ndarray:
    """The register after a byte of zeros."""
    return crc >> np.uint32(8) ^ BYTE[crc & np.uint32(255)]


def shift_tables(n: int = 256) -> np.ndarray:
    """tables[bytes, place, byte]: what a byte of a CRC at a place becomes when so many bytes follow."""
    tables = [np.arange(256, dtype=np.uint32)[None, :] << PLACES[:, None]]
    for _ in range(n):
        tables.append(past_zero(tables[-1]))
    return np.stack(tables)


SHIFTS = shift_tables()


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC shifted by its number of bytes."""
    low = by & 255
    parts = [SHIFTS[low, k, crc >> PLACES[k] & np.uint32(255)] for k in range(4)]
    out = parts[0] ^ parts[1] ^ parts[2] ^ parts[3]
    power, rest = SHIFTS[256], by >> 8
    while rest.any():
        at = np.flatnonzero(rest & 1)
        out[at] = applied(power, out[at])
        power, rest = applied(power, power), rest >> 1
    return out


def applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    parts = [table[k][crc >> PLACES[k] & np.uint32(255)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def past_space(crc: np.ndarray) -> np.ndarray:
    """The CRC of a prefix and one space more."""
    return ~past_zero(~crc ^ np.uint32(0x20))


def next_crc(crc: int, piece: bytes) -> int:
    return zlib.crc32(piece, crc)


#: (which text, how many of its first words the block before had too, words)
Block = tuple[int, int, list[bytes]]


def run_crcs(blocks: list[Block], words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``words`` words: (the text of each run, its CRC)."""
    blocks = [b for b in blocks if b[2]]
    if not blocks:
        return
    sizes = np.array([len(own) for _, _, own in blocks])
    of, firsts = (np.repeat(x, sizes) for x in (np.array([k for k, _, _ in blocks]), np.cumsum(sizes) - sizes))
    fresh = firsts + np.repeat([skip for _, skip, _ in blocks], sizes)
    lengths = np.fromiter((len(w) for _, _, own in blocks for w in own), np.int64, len(of))
    # The CRC after each word of a block: one scan over its words, each but the first with the space before it.
    scans = (accumulate((own[0], *map(b" ".__add__, own[1:])), next_crc, initial=0) for _, _, own in blocks)
    ends = np.fromiter((crc for scan in scans for crc in islice(scan, 1, None)), np.uint32, len(of))
    upto = np.cumsum(lengths + 1)
    before = np.where(np.arange(len(of)) > firsts, past_space(np.roll(ends, 1)), np.uint32(0))
    for n in range(1, words + 1):
        last = np.arange(n - 1, len(of))
        last = last[(last - n + 1 >= firsts[last]) & (last >= fresh[last])]
        first = last - n + 1
        yield of[last], ends[last] ^ shifted(before[first], upto[last] - upto[first] + lengths[first])


def text_blocks(texts: pa.Array, words: int) -> Iterator[list[Block]]:
    """Blocks of the words of texts, about ``HELD`` words at a time; runs of ``words`` words are whole in one block."""
    held, n = [], 0
    for k, text in enumerate(texts):
        raw = (text.as_py() or "").encode().translate(PLAIN)
        for i, own in enumerate(word_blocks(raw, words - 1, HELD)):
            held.append((k, words - 1 if i else 0, own))
            n += len(own)
            if n >= HELD:
                yield held
                held, n = [], 0
    yield held


def bucket_counts(docs: DataFrame, text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in text_blocks(batch.column(0), words):
                for _, crcs in run_crcs(held, words):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in whole thousandths."""
    b = float(len(corpus))
    ratio = ((target + 1.0) * (corpus.sum() + b)) / ((corpus + 1.0) * (target.sum() + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", words: int = WORDS, to: str = "weighed") -> DataFrame:
    """Adds ``to``: n_words, n_features and weight."""
    kinds = [pa.field(c, pa.int64()) for c in ("n_words", "n_features", "weight")]

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weighed(texts: pa.Array) -> pa.Array:
        n_words, n_features, total = np.zeros((3, len(texts)), np.int64)
        for held in text_blocks(texts, words):
            for n, (text, crcs) in enumerate(run_crcs(held, words)):
                counts = np.bincount(text, minlength=len(texts))
                n_features += counts
                n_words += 0 if n else counts
                # Sums of whole numbers stay exact in doubles.
                total += np.bincount(text, gain[crcs % np.uint32(len(gain))], len(texts)).astype(np.int64)
        weight = total // np.maximum(n_features, 1)
        return pa.StructArray.from_arrays([pa.array(x) for x in (n_words, n_features, weight)], fields=kinds)

    return docs.withColumn(to, weighed.asNondeterministic()(F.col(text_col)))


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, a hash of the text, n_words, n_features, weight and score of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text_col, words, buckets), bucket_counts(target, target_text_col, words, buckets))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    found = weigh(own, gain, "text", words).select("doc_id", "text_hash", "weighed.*")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return found.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` to the rows of the highest scores: ``percent`` of the rows with ``least_words`` words; null for others.
    ``scored`` is read several times."""
    enough = F.col("n_words") >= least_words
    # Whole scores in a narrow range: a bounded table.
    counts = {r.score: r.n for r in scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).collect()}
    wanted = percent * sum(counts.values()) // 100
    least, above = None, 0
    for s in sorted(counts, reverse=True):
        if above >= wanted:
            break
        least, above = s, above + counts[s]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_hash")]
    chosen = enough & (F.col("score") >= least)
    ranged = settle(scored.where(chosen).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("own"))
    # One row a partition.
    before = sizes.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = ranged.withColumn("place", place).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("place"))
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    return ranked.select(*scored.columns, rank).unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rows with a rank are the sample."""
    scored = settle(score(docs, target, id_col, text_col, target_text_col, words, buckets, seed))
    return draw(scored, percent, least_words).drop("text_hash")


def op13_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark."""
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The same with the CRC-32 of every distinct word by itself, half a byte at a time.
OP13 = r"""
WITH step AS MATERIALIZED (
    SELECT list(list_reduce(range(4), lambda crc, i: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, CAST(n AS BIGINT)) ORDER BY n) AS s
    FROM range(16) AS x(n)
), doc AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), item AS MATERIALIZED (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), corpus AS MATERIALIZED (
    SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM doc) GROUP BY ALL
), target AS MATERIALIZED (
    SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM item) GROUP BY ALL
), hashed AS MATERIALIZED (
    SELECT word, xor(list_reduce(regexp_extract_all(hex(encode(word)), '..'), lambda crc, byte:
            xor(xor(xor(crc, CAST(('0x' || byte) AS BIGINT)) >> 4, s[(xor(crc, CAST(('0x' || byte) AS BIGINT)) & 15) + 1]) >> 4,
                s[(xor(xor(crc, CAST(('0x' || byte) AS BIGINT)) >> 4, s[(xor(crc, CAST(('0x' || byte) AS BIGINT)) & 15) + 1]) & 15) + 1]),
            CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM (SELECT word FROM corpus UNION ALL SELECT word FROM target)), step
), bucket AS MATERIALIZED (
    SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
        SELECT word, n AS s, 0 AS t FROM corpus UNION ALL SELECT word, 0 AS s, n AS t FROM target) JOIN hashed USING (word) GROUP BY bucket
), gain AS MATERIALIZED (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM bucket, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM bucket)
), weight AS MATERIALIZED (
    SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST((sum(n * gain) - ((sum(n * gain) % sum(n)) + sum(n)) % sum(n)) // sum(n) AS BIGINT) AS weight
    FROM corpus JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r
), score AS MATERIALIZED (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM doc LEFT JOIN weight USING (r)
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, 10 * count(*) OVER () // 100 AS wanted FROM score WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM score WHERE n_features < 20
"""

QUERIES = {"op13_importance_sample": op13_importance_sample}
ORACLES = {"op13_importance_sample": OP13}
