"""Near duplicates by SimHash fingerprints and anchor points.

Two fingerprints of 64 bits that differ in at most t bits differ in at most t // 2 bits in one of their
halves. Over the 32 bits of a half stands a covering code, the perfect Golay code on 23 bits (every word
is within 3 bits of exactly one code word) times all words of the other 9 bits; its words are the anchors.
A fingerprint is at home at the one anchor that covers it, and is replicated to every anchor within the
covering radius plus t // 2. Whatever links to it in this half is at home at one of these, so homes and
replicas are compared anchor by anchor. With t = 3 a fingerprint has about 29 replicas and an anchor
2^-21 of all homes of a half.

Equal fingerprints are one point before anything is compared. Anchors with many homes are dealt out in
tiles. A task sends a spanning forest of the links that it finds, not the links.

Defined results: a null text, or one without words, has fingerprint zero and links like any other; fewer
words than a shingle has are one shingle. Equal rows stay separate rows of one component. The smallest id
of a component names it; null ids are not smallest unless all are null, then the name is null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.common import documents, free_names, row_key, word_blocks
from snapcat.llm.components import components, forest
from snapcat.session import settle

WIDTH, SEED, MOST_BITS = 3, 42, 3
#: Homes of an anchor that one tile compares; rows that one group of tiles has, about; pairs compared at a time.
TILE, GROUP_ROWS, PAIRS = 8192, 50_000, 1 << 21
#: Anchors with several tiles that may be broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 100_000


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Bit set if it is set in over half the hashes of the shingles, repeats included."""
    set_bits, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    for words in word_blocks((text or "").encode().lower(), width - 1):
        if len(words) < width:
            if n:
                continue
            hashes = [digest(b" ".join(words), seed)] if words else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: len(words) - width].tolist()]
            hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += np.add.reduce(bits, axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", to: str = "fingerprint", width: int = WIDTH) -> DataFrame:
    """Adds the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())

    return docs.withColumn(to, of(F.col(text_col)))


class Golay:
    """Nearest code words of the perfect binary code [23, 12], from its generator polynomial."""

    GENERATOR = 0b110001110101

    def __init__(self):
        rest = [1 << i for i in range(11)]
        for _ in range(12):
            up = rest[-1] << 1
            rest.append(up ^ self.GENERATOR if up >> 11 else up)
        table = lambda bits: np.array([np.bitwise_xor.reduce([r for i, r in enumerate(bits) if x >> i & 1] or [0]) for x in range(1 << len(bits))], np.uint32)
        self.low, self.high = table(rest[:12]), table(rest[12:])
        self.error = np.zeros(2048, np.uint32)
        for k in range(4):
            for places in itertools.combinations(range(23), k):
                self.error[np.bitwise_xor.reduce([rest[i] for i in places] or [0])] = sum(1 << i for i in places)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The 12 leading bits of the code word within 3 bits of each 23-bit x; they determine the word."""
        return (x ^ self.error[self.low[x & 0xFFF] ^ self.high[x >> 12]]) >> 11


def halves(points: np.ndarray) -> list[np.ndarray]:
    return [(points.view(np.uint64) >> np.uint64(32 * h)).astype(np.uint32) for h in (0, 1)]


def anchors(code: Golay, half: int, x: np.ndarray) -> np.ndarray:
    """The anchor that covers each half fingerprint."""
    return (np.int64(half << 21) | (code.nearest(x & 0x7FFFFF).astype(np.int64) << 9) | (x >> 23).astype(np.int64)).astype(np.int32)


def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        points = batch.column("point").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([anchors(code, h, x) for h, x in enumerate(halves(points))]))], ["anchor"])


def placed(bits: int):
    """Rows (anchor, point, at_home): the home and all replicas of every point, for halves that differ in ``bits`` bits at most."""
    masks = [sum(1 << i for i in places) for k in range(bits + 1) for places in itertools.combinations(range(32), k)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            points = batch.column("point").to_numpy(zero_copy_only=False)
            for half, x in enumerate(halves(points)):
                home = anchors(code, half, x)
                reach = np.sort(np.stack([anchors(code, half, x ^ np.uint32(m)) for m in masks], 1), 1)
                new = np.ones(reach.shape, bool)
                new[:, 1:] = reach[:, 1:] != reach[:, :-1]
                row, _ = np.nonzero(new)
                anchor = reach[new]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(points[row]), pa.array(anchor == home[row])], ["anchor", "point", "at_home"])

    return place


def linker(most_bits: int):
    """Compares homes with all points of their anchor and tile; returns a forest of the links of the group."""

    def link(table: pa.Table) -> pa.Table:
        anchor, tile = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "tile"))
        point, at_home = table.column("point").to_numpy(), table.column("at_home").to_numpy(zero_copy_only=False)
        order = np.argsort(key := anchor << 32 | tile, kind="stable")
        key, point, at_home = key[order], point[order], at_home[order]
        home = np.flatnonzero(at_home)
        first, size = np.searchsorted(key, key[home]), np.searchsorted(key, key[home], "right")
        size -= first
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(size)
        done = 0
        while done < len(home):
            # Homes whose pairs fit together; a single home with more partners than that stands alone, its partners in one array.
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
            n = size[done:to]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            u, v = np.repeat(point[home[done:to]], n), point[np.repeat(first[done:to], n) + offset]
            near = (np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= most_bits) & (u != v)
            if near.any():
                a, b = forest(np.concatenate([a, u[near]]), np.concatenate([b, v[near]]))
            done = to
        return pa.table({"a": a, "b": b})

    return link


def point_links(points: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column ``point``, that connect all that are ``most_bits`` apart or less."""
    spark = points.sparkSession
    n = points.count()
    full = settle(points.mapInArrow(homes, "anchor int").groupBy("anchor").count().where(F.col("count") > TILE).select("anchor", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    rows = points.mapInArrow(placed(most_bits // 2), "anchor int, point long, at_home boolean")
    n_full = full.count()
    if n_full:
        rows = rows.join(F.broadcast(full) if n_full <= MOST_BROADCAST else full, "anchor", "left")
        one = F.pmod(F.xxhash64("point"), F.col("tiles")).cast("int")
        # A home goes to its tile; as a partner every point goes to all tiles of the anchor.
        tile = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("tile")
        rows = rows.select("anchor", "point", "at_home", F.coalesce(one, F.lit(0)).alias("own"), tile)
        rows = rows.select("anchor", "point", (F.col("at_home") & (F.col("tile") == F.col("own"))).alias("at_home"), "tile")
    else:
        rows = rows.withColumn("tile", F.lit(0))
    groups = max(1024, int(spark.conf.get("spark.sql.shuffle.partitions")), 30 * n // GROUP_ROWS)
    return rows.groupBy(F.pmod(F.xxhash64("anchor", "tile"), F.lit(groups)).alias("part")).applyInArrow(linker(most_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each row of ``docs``: its id, ``row_key_1`` and ``row_key_2`` (equal for rows of equal id and text), the
    fingerprint, the component's smallest fingerprint ``root`` and its smallest id ``component_id``."""
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        *row_key(id_col, text_col),
    )
    printed = settle(fingerprints(keyed, "text", "point", width).drop("text"))
    points = settle(printed.groupBy("point").agg(F.min("doc_id").alias("first_id")))
    found = components(point_links(points.select("point"), most_bits))
    rooted = points.join(found, F.col("point") == F.col("node"), "left").select("point", "first_id", F.coalesce("root", "point").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("point", "root", "component_id")
    return printed.join(named, "point").select("doc_id", "row_key_1", "row_key_2", F.col("point").alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component the row with the smallest id stays, and one of equal rows."""
    return first_of_each(docs, near_duplicates(docs, id_col, text_col, width, most_bits), id_col, text_col)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each ``root`` in ``found``, and one of equal rows."""
    stays = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row_key_1", "row_key_2")).alias("row")).select("row.row_key_1", "row.row_key_2")
    names = free_names(docs, "row_key_1", "row_key_2")
    keyed = docs.select("*", *(key.alias(name) for key, name in zip(row_key(id_col, text_col), names, strict=True)))
    return keyed.join(stays.toDF(*names), names, "left_semi").dropDuplicates(names).select(*docs.columns)


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_components": op10_simhash_components}
ORACLES: dict[str, str] = {}
