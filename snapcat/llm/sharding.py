"""Shards of nearly equal size over ordered groups that stay whole.

Equal texts are one group; groups are ordered by the SHA-256 of their text. Cutting the order into n runs
so that the largest is as small as possible is a search for the smallest capacity that a greedy filling
meets. The greedy check needs, again and again, the last group boundary before some size, and only near
the places where cuts can fall. So the driver works on a bounded summary: for windows of sizes the last
boundary in each of at most ``SUMMARY`` cells. Cutting only at those costs less than a cell, which bounds
the capacity and the windows from both sides; each round looks into the windows more closely, until it
has every boundary in them. With the capacity known, each cut is put where what is left would be shared
evenly, as far as the capacity allows, so that the last shards do not end up empty.

Everything else is DataFrame work: groups and their running sizes by hash prefix, shards by comparing
digests with the cuts, slots by counting within prefixes of a hash of the id.

Defined results: a null text has no bytes and is in the group of the empty text. Repeated rows are in one
group, in different slots. A group larger than a fair share sets the capacity. With fewer groups than
shards some shards stay empty; an empty table has no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapcat.llm.common import documents
from snapcat.session import settle

SHARDS = 40
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Boundaries that the driver holds of one round; hash prefixes (of three hex digits) that are numbered apart.
SUMMARY, PREFIXES = 1 << 16, 4096
#: Rows (shard, prefix, offset) that may be broadcast: 40 bytes each.
MOST_BROADCAST = 1 << 20


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def running(groups: DataFrame) -> DataFrame:
    """Groups (digest, bytes) with ``upto``, the bytes of all groups in order up to and with this one."""
    prefix = groups.withColumn("prefix", F.substring(F.hex("digest"), 1, 3))
    # One row a prefix: 4,096 at most.
    before = prefix.groupBy("prefix").agg(F.sum("bytes").alias("own"))
    before = before.select("prefix", (F.sum("own").over(Window.orderBy("prefix")) - F.col("own")).alias("before"))
    inside = F.sum("bytes").over(Window.partitionBy("prefix").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    return prefix.withColumn("inside", inside).join(F.broadcast(before), "prefix").select("digest", "bytes", (F.col("before") + F.col("inside")).alias("upto"))


class Cuts:
    """Greedy fillings over a sorted list of boundaries, the last of which is the total."""

    def __init__(self, bounds: list[int], shards: int):
        self.bounds, self.shards, self.total = bounds, shards, bounds[-1]

    def forward(self, capacity: int) -> list[int]:
        """Latest places of the cuts if every shard from the first on takes what fits."""
        at, out = 0, []
        for _ in range(self.shards):
            i = bisect_right(self.bounds, at + capacity) - 1
            at = max(at, self.bounds[i] if i >= 0 else 0)
            out.append(at)
        return out

    def backward(self, capacity: int) -> list[int]:
        """Earliest places of the cuts if every shard from the last on takes what fits."""
        at, out = self.total, [self.total]
        for _ in range(self.shards - 1):
            if at > capacity:
                i = bisect_left(self.bounds, at - capacity)
                at = min(at, self.bounds[i])
            else:
                at = 0
            out.append(at)
        return out[::-1]

    def smallest(self, low: int, high: int) -> int:
        """Smallest capacity from low to high that the greedy filling meets; high must do."""
        while low < high:
            middle = (low + high) // 2
            if self.forward(middle)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def even(self, capacity: int) -> list[int]:
        """Cuts within the capacity, each as near as can be to an equal share of what is left."""
        earliest, latest, at, out = self.backward(capacity), self.forward(capacity), 0, []
        for j in range(self.shards - 1):
            low, high = earliest[j], min(latest[j], at + capacity)
            goal = at + (self.total - at) / (self.shards - j)
            i = bisect_left(self.bounds, goal)
            last = bisect_right(self.bounds, high) - 1
            near = [b for b in (at, low, *self.bounds[max(0, i - 1) : i + 1], *self.bounds[last : last + 1]) if max(low, at) <= b <= high]
            at = min(near, key=lambda b: (abs(b - goal), b))
            out.append(at)
        return out


def boundaries(groups: DataFrame, windows: list[tuple[int, int]], cell: int) -> list[tuple[int, int]]:
    """The last boundary and the number of boundaries in each cell of the windows."""
    inside = reduce(or_, [F.col("upto").between(a, b) for a, b in windows])
    found = groups.where(inside).groupBy(F.floor(F.col("upto") / F.lit(cell))).agg(F.max("upto").alias("last"), F.count("*").alias("n"))
    return sorted((r["last"], r["n"]) for r in found.collect())


def joined(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_places(groups: DataFrame, shards: int, summary: int = SUMMARY) -> list[int]:
    """The shards - 1 boundaries at which to cut; ``groups`` is a written table of (digest, bytes, upto)."""
    total, largest, n = groups.agg(F.max("upto"), F.max("bytes"), F.count("*")).first()
    if not n:
        return []
    # Windows are some shards^2 cells wide together; a few times as many cells make them shrink.
    summary = max(summary, 40 * shards**2)
    low = max(largest, -(-total // shards))
    high = low + largest
    windows, known, expected = [(1, total)], {total}, n
    while True:
        wide = sum(b - a + 1 for a, b in windows)
        cell = 1 if expected <= summary else -(-wide // summary)
        found = boundaries(groups, windows, cell)
        known.update(last for last, _ in found)
        cuts = Cuts(sorted(known), shards)
        best = cuts.smallest(low, high + cell - 1)
        if all(count == 1 for _, count in found):
            return cuts.even(best)
        # The best capacity over all boundaries is less than a cell below the best over the last ones of cells.
        low, high = max(low, best - cell + 1), min(high, best)
        reach = high + cell
        ends = zip(cuts.forward(low), cuts.forward(reach), cuts.backward(reach), cuts.backward(low), strict=True)
        windows = joined([w for a, b, c, d in ends for w in ((max(1, a), min(total, b)), (max(1, c - cell), min(total, d))) if w[0] <= w[1]])
        expected = sum(count for last, count in found if any(a - cell <= last <= b + cell for a, b in windows))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", summary: int = SUMMARY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    rows = settle(measured(docs, id_col, text_col))
    groups = settle(running(rows.groupBy("digest").agg(F.sum("size").alias("bytes"))))
    places = cut_places(groups, shards, summary)
    last = {r.upto: r.digest for r in groups.where(F.col("upto").isin(places)).select("upto", "digest").collect()} if places else {}
    # A cut at 0 leaves the shards before it empty.
    before: list[Column] = [F.col("digest") > F.lit(bytes(last[p])) if p else F.lit(True) for p in places]
    number = reduce(add, [b.cast("int") for b in before], F.lit(0))
    prefix = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 3)
    placed = rows.select("*", number.alias("shard"), prefix.alias("prefix"))
    offsets = placed.groupBy("shard", "prefix").agg(F.count("*").alias("own"))
    offsets = offsets.select("shard", "prefix", (F.sum("own").over(Window.partitionBy("shard").orderBy("prefix")) - F.col("own")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "prefix").orderBy("doc_id", "digest"))
    numbered = placed.withColumn("own", own).join(F.broadcast(offsets) if shards * PREFIXES <= MOST_BROADCAST else offsets, ["shard", "prefix"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("own") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, equal texts together."""
    return shard(documents(spark, sf_dir))


#: The same over one list of all boundaries: search steps, the earliest and latest cuts, the cuts, CRC-32 by nibbles.
OP1 = """
WITH RECURSIVE doc AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
        sha256(coalesce(text, '')) AS digest FROM documents
), bound AS MATERIALIZED (
    SELECT digest, bytes, CAST(sum(bytes) OVER (ORDER BY digest) AS BIGINT) AS upto FROM (SELECT digest, CAST(sum(size) AS BIGINT) AS bytes FROM doc GROUP BY digest)
), b AS MATERIALIZED (
    SELECT list(upto ORDER BY upto) AS bounds, max(upto) AS total, max(bytes) AS largest FROM bound
), search(low, high, reach, j) AS (
    SELECT greatest(largest, -(-total // 40)), greatest(largest, -(-total // 40)) + largest, CAST(0 AS BIGINT), 0 FROM b WHERE total IS NOT NULL
    UNION ALL
    SELECT CASE WHEN upto < total AND j = 39 THEN mid + 1 ELSE low END, CASE WHEN upto = total THEN mid ELSE high END,
        CASE WHEN upto = total OR j = 39 THEN 0 ELSE upto END, CASE WHEN upto = total OR j = 39 THEN 0 ELSE j + 1 END
    FROM (SELECT low, high, j, total, (low + high) // 2 AS mid,
            greatest(reach, coalesce(list_max(list_filter(bounds, lambda x: x <= reach + (low + high) // 2)), 0)) AS upto
        FROM search, b WHERE low < high)
), capacity AS MATERIALIZED (
    SELECT min(high) AS c FROM search WHERE low = high
), latest(j, place) AS (
    SELECT 0, CAST(0 AS BIGINT)
    UNION ALL
    SELECT j + 1, greatest(place, coalesce(list_max(list_filter(bounds, lambda x: x <= place + c)), 0)) FROM latest, b, capacity WHERE j < 40
), earliest(j, place) AS (
    SELECT 40, total FROM b
    UNION ALL
    SELECT j - 1, CASE WHEN place > c THEN least(place, list_min(list_filter(bounds, lambda x: x >= place - c))) ELSE 0 END FROM earliest, b, capacity WHERE j > 1
), frame AS MATERIALIZED (
    SELECT j, e.place AS low, l.place AS high FROM earliest AS e JOIN latest AS l USING (j)
), cut(j, place) AS (
    SELECT 0, CAST(0 AS BIGINT)
    UNION ALL
    SELECT cut.j + 1, list_min(list_transform(
            list_filter(list_concat([place, low], bounds), lambda x: x >= greatest(low, place) AND x <= least(high, place + c)),
            lambda x: {'d': abs(x - (place + (total - place) / (40 - cut.j))), 'x': x})).x
    FROM cut JOIN frame ON frame.j = cut.j + 1, b, capacity WHERE cut.j < 39
), step AS MATERIALIZED (
    SELECT list(list_reduce(range(4), lambda crc, i: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, CAST(n AS BIGINT)) ORDER BY n) AS s
    FROM range(16) AS x(n)
), sum32 AS (
    SELECT r, xor(list_reduce(regexp_extract_all(hex(encode(t)), '..'), lambda crc, byte:
            xor(xor(xor(crc, CAST(('0x' || byte) AS BIGINT)) >> 4, s[(xor(crc, CAST(('0x' || byte) AS BIGINT)) & 15) + 1]) >> 4,
                s[(xor(xor(crc, CAST(('0x' || byte) AS BIGINT)) >> 4, s[(xor(crc, CAST(('0x' || byte) AS BIGINT)) & 15) + 1]) & 15) + 1]),
            CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM doc, step
), placed AS (
    SELECT doc.*, (SELECT count(*) FROM cut WHERE cut.j > 0 AND cut.place < bound.upto) AS shard FROM doc JOIN bound USING (digest)
)
SELECT doc_id, size, coalesce(crc, 0) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3), doc_id NULLS FIRST, digest) - 1 AS slot,
    CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN sum32 USING (r)
"""

QUERIES = {"op1_minimax_shards": op1_minimax_shards}
ORACLES = {"op1_minimax_shards": OP1}
