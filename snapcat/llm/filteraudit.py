"""Which filters of a chain do what: survivors of every subset of the filters, and of every order.

A document is reduced to the set of filters that it fails, and that to a word of 32 bits: bit s is set if the
document survives the subset s of the five filters (bit 0 of s is A, bit 4 is E). The words of a part are summed
by position with carry-save adders: three words of one weight become a word of sums and a word of carries of
twice the weight, until two or fewer are left of each weight. That gives the survivors of all 32 subsets at once,
for all documents of the part, those labelled good and those labelled toxic. A task sums its own words, 32 rows
a part; the rest are sums of those rows, and every figure of every order is a difference of two or four of them.

The filters remove a text that has

* A: fewer than 50 words,
* B: fewer distinct words than 65 in 100,
* C: more than 5 in 100 characters A-Z,
* D: any of ``SYMBOLS``,
* E: an equal text with a smaller id anywhere in the table, removed or not.

Defined results: a null text is empty, and so is a null part. A null id is neither smaller nor larger than another:
such rows never fail E and make no other row fail it; repeated rows of the smallest id all pass it. A document is good
or toxic if any label of its id says so; null ids have no labels. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.common import documents, word_blocks
from snapcat.session import settle

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Fixed value: the characters of filter D.
SYMBOLS = "#$%&*|"
CAPITALS, OTHERS = np.zeros(256, bool), np.zeros(256, bool)
CAPITALS[ord("A") : ord("Z") + 1] = True
#: Bytes that follow the first of a character.
OTHERS[0x80:0xC0] = True
#: Parts that a task sums at a time.
HELD_PARTS = 4096

#: The survival word of every set of failed filters.
WORDS = np.array([sum(1 << s for s in range(ALL + 1) if not s & failed) for failed in range(ALL + 1)], np.uint32)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COUNTED = ("n", "good", "toxic")


def failed_alone(text: str | None) -> int:
    """The filters A to D that a text fails, as bits."""
    raw, words, distinct = (text or "").encode(), 0, set()
    for own in word_blocks(raw, 0):
        words += len(own)
        distinct.update(own)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (
        (words < LEAST_WORDS)
        | (100 * len(distinct) < LEAST_DISTINCT * words) << 1
        | bool(100 * kinds[CAPITALS].sum() > MOST_CAPITALS * (len(raw) - kinds[OTHERS].sum())) << 2
        | bool(kinds[[ord(c) for c in SYMBOLS]].any()) << 3
    )


def bits_of(word: np.uint32) -> np.ndarray:
    return (word >> np.arange(32, dtype=np.uint32)) & np.uint32(1)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits set."""
    counts, weight, level = np.zeros(32, np.int64), 1, np.asarray(words, np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = (level[k * third : (k + 1) * third] for k in range(3))
            odd = a ^ b
            carries.append(a & b | c & odd)
            level = np.concatenate([odd ^ c, level[3 * third :]])
        if len(level) == 2:
            carries.append(level[:1] & level[1:])
        total = np.bitwise_xor.reduce(level)
        counts += weight * bits_of(total).astype(np.int64)
        weight *= 2
        level = np.concatenate(carries) if carries else level[:0]
    return counts


def marked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, the filters failed by the text alone, and the digest of the text, of every row."""

    @F.arrow_udf("int")
    def alone(texts: pa.Array) -> pa.Array:
        return pa.array([failed_alone(t.as_py()) for t in texts], pa.int32())

    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), alone(text).alias("alone"), digest.alias("digest"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, ``failed`` (bits of all filters that a row fails), good and toxic of every row."""
    rows = settle(marked(docs, id_col, text_col, part_col))
    # One row a text that stands there more than once; a text of a third of all rows is split by adaptive execution.
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality"), flag("toxic"))
    copy = F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)
    own = rows.join(first, "digest", "left").select("id", "part", F.col("alone").bitwiseOR(copy).alias("failed"))
    named = lambda c: F.coalesce(c, F.lit(False))
    return own.join(known, "id", "left").select("id", "part", "failed", named("quality").alias("good"), named("toxic").alias("toxic"))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset among the rows of a task, by part."""
    held: dict[str, np.ndarray] = {}

    def batch() -> pa.RecordBatch:
        parts = list(held)
        counts = np.concatenate([held[p] for p in parts] or [np.zeros((0, 3), np.int64)])
        subsets = np.tile(np.arange(ALL + 1, dtype=np.int32), len(parts))
        columns = [pa.array(parts, pa.string()).take(np.repeat(np.arange(len(parts)), ALL + 1)), pa.array(subsets), *(pa.array(counts[:, k]) for k in range(3))]
        return pa.RecordBatch.from_arrays(columns, ["part", "subset", *COUNTED])

    for rows in batches:
        coded = rows.column("part").dictionary_encode()
        at = coded.indices.to_numpy()
        words = WORDS[rows.column("failed").to_numpy()]
        marks = [np.ones(len(at), bool), *(rows.column(c).to_numpy(zero_copy_only=False) for c in COUNTED[1:])]
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(coded.dictionary) + 1))
        for k, part in enumerate(coded.dictionary.to_pylist()):
            span = order[ends[k] : ends[k + 1]]
            counts = np.stack([positional_popcount(words[span[m[span]]]) for m in marks], 1)
            held[part] = held[part] + counts if part in held else counts
            if len(held) >= HELD_PARTS:
                yield batch()
                held.clear()
    yield batch()


def survivors(rows: DataFrame) -> DataFrame:
    """part, subset (bits of filters), and how many documents, good ones and toxic ones survive it."""
    parts = rows.select("part", "failed", "good", "toxic").mapInArrow(summed, "part string, subset int, " + ", ".join(f"{c} long" for c in COUNTED))
    return parts.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in COUNTED))


def audit(found: DataFrame) -> DataFrame:
    """The figures of every part, order and step, from the survivors of all subsets."""
    # 32 rows a part, by subset.
    lists = found.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *COUNTED))).alias("of"))

    def of(subset: Column, what: str = "n") -> Column:
        return F.get("of", subset)[what]

    def shapley(k: int) -> Column:
        """Removed by a filter in all orders: with j filters before it, j! orders of those and (4 - j)! of the others."""
        weights = [(s, math.factorial(j := s.bit_count()) * math.factorial(len(FILTERS) - 1 - j)) for s in range(ALL + 1) if not s >> k & 1]
        terms = [w * (of(F.lit(s)) - of(F.lit(s | 1 << k))) for s, w in weights]
        return sum(terms[1:], terms[0])

    lists = lists.select("part", "of", F.array(*map(shapley, range(len(FILTERS)))).alias("shares"))
    ordered = lists.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = ordered.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = F.ascii(F.substr("filter_order", F.col("step"), F.lit(1))) - ord("A")
    # The filters that stand before the step's own.
    bits = [F.when(F.instr("filter_order", c) < F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)]
    steps = steps.select("part", "filter_order", "step", "of", "shares", place.alias("place"), sum(bits[1:], bits[0]).alias("before"))
    own = F.get(F.array(*(F.lit(1 << k) for k in range(len(FILTERS)))), F.col("place"))
    steps = steps.withColumns({"own": own, "after": F.col("before").bitwiseOR(own)})
    lost = lambda what: of(F.col("before"), what) - of(F.col("after"), what)
    return steps.select(
        "part", "filter_order", "step", of(F.col("after")).alias("kept"), lost("n").alias("removed"),
        (of(F.lit(0)) - of(F.col("own")) - lost("n")).alias("redundant"), (of(ALL - F.col("own")) - of(F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("place")).alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source, in all 120 orders."""
    return audit(survivors(judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))))


#: The same by following each kind of document through each order.
OP12 = r"""
WITH doc AS MATERIALIZED (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), first AS MATERIALIZED (
    SELECT sha256(t) AS digest, min(doc_id) AS first FROM doc GROUP BY ALL
), label AS MATERIALIZED (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), kind AS MATERIALIZED (
    SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
        100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
    FROM doc JOIN first ON sha256(t) = digest LEFT JOIN label USING (doc_id) GROUP BY ALL
), letter AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS MATERIALIZED (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letter p, letter q, letter r, letter s, letter t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), step AS MATERIALIZED (
    SELECT filter_order, step, substr(filter_order, step, 1) AS own, left(filter_order, step - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
), fails AS MATERIALIZED (
    SELECT part, good, toxic, n, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
        || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed FROM kind
), followed AS MATERIALIZED (
    SELECT part, filter_order, step, own, good, toxic, n, failed, contains(failed, own) AS fail,
        len(translate(failed, earlier, '')) < len(failed) AS gone FROM fails, step
), figure AS MATERIALIZED (
    SELECT part, filter_order, step, own,
        CAST(sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN NOT gone AND fail AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN NOT gone AND fail AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM followed GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM figure
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": OP12}
