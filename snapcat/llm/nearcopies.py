"""Near copies by SimHash fingerprints and the Jaccard similarity of their word shingles.

Texts are linked by the method of ``simhash``: fingerprints over runs of ``WIDTH`` words that differ in 3 bits at most meet at
anchors of a covering code and form components. Texts of one component are candidates, and an exact check follows: a candidate becomes a
link only if the sets of runs, compared whole, are ``SIMILAR`` or more.

Most texts as similar as that are further than 3 bits apart, and anchors for many bits would need too many replicas. So more
candidates stand beside those of the fingerprints, under the same check: the sketch of a set is ``BANDS`` bands of ``ROWS`` minima, each
under a hash of its own; two texts of similarity s share a band with a chance of 1 - (1 - s ** ROWS) ** BANDS,
which is 0.999995 at 0.8 and more above. A component of fingerprints is one more band.

A band that k texts share does not give k * k pairs. First every member is held against one of them, another in
each band; the links join them to components. Bands whose members are still apart do so once more with another one of them. What is
left apart then is dealt out in tiles: a share of the members outside the band's largest component against a share of all
members, with their sets. A tile counts the common shingles of all its sets at once and gives a link for each member and other component at
most, so the rows are links and no pair is one. What is left out is a pair that is already in one component, so the components are those
of all links.

Equal sets are one point before anything is compared. Sets are made for candidates only.

Defined results: words are split at ASCII white space and ASCII letters are lowered; a text of fewer words is one
shingle; null texts and texts without words are equal. Equal rows stay separate rows of one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm.common import row_key, word_blocks
from snapcat.llm.components import components
from snapcat.llm.simhash import fingerprint, first_of_each
from snapcat.llm.simhash import point_links as fingerprint_links
from snapcat.llm.substring import BASES, HASHES, mixed, run_hashes
from snapcat.session import settle

#: Words of a shingle; the least similarity, as a fraction in whole numbers.
WIDTH, SIMILAR = 5, (4, 5)
BANDS, ROWS, SEED = 40, 6, 42
#: Shingles whose hashes are held at a time.
HELD = 1024
#: Times that the members of a band are held against one of them; bytes of sets on a side of a tile.
STARS, TILE_BYTES = 2, 8 << 20

SKETCH = pa.struct([("point", pa.int64()), ("bands", pa.list_(pa.int64())), ("fingerprint", pa.int64())])
ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, in order."""
    blocks = word_blocks((text or "").encode().lower(), 0)
    words = np.concatenate([np.fromiter(map(HASHES.__getitem__, own), np.uint64, len(own)) for own in blocks])
    return np.unique(run_hashes(words, min(width, len(words)), BASES[0])) if len(words) else words


def sketch(own: np.ndarray) -> tuple[int, np.ndarray]:
    """A hash of the whole set, and one of each band."""
    point = xxhash.xxh3_64_intdigest(own.tobytes())
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(own), HELD):
        # The high bits of a product depend on all bits of the factor; they decide the minimum.
        least = np.minimum(least, (own[k : k + HELD, None] * ODD[0]).min(0))
    rows = (mixed(least) * ODD[1]).reshape(BANDS, ROWS)
    return point, mixed(np.add.reduce(rows, axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def forgetting(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches; the worker, which lives on, lets go of the words it learnt when they end."""
    try:
        yield from batches
    finally:
        HASHES.clear()


def sketches(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``point``, equal for equal sets, ``bands`` and ``fingerprint``."""

    @F.arrow_udf("struct<point:long,bands:array<long>,fingerprint:long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from forgetting(map(sketched, batches))

    def sketched(texts: pa.Array) -> pa.Array:
        found = [sketch(shingles(t.as_py())) for t in texts]
        points = pa.array(np.array([p for p, _ in found], np.uint64).view(np.int64))
        bands = np.concatenate([b for _, b in found] or [np.zeros(0, np.uint64)]).view(np.int64)
        ends = np.arange(len(found) + 1, dtype=np.int32) * BANDS
        prints = pa.array([fingerprint(t.as_py(), WIDTH) for t in texts], pa.int64())
        return pa.StructArray.from_arrays([points, pa.ListArray.from_arrays(pa.array(ends), pa.array(bands)), prints], fields=list(SKETCH))

    # So that the sketch is not made again for each of its fields.
    return texts.withColumn("sketch", of.asNondeterministic()(F.col(text_col))).select("*", "sketch.*").drop("sketch")


def sets(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``set``: the shingles of every text."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from forgetting(pa.array([shingles(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64())) for texts in batches)

    return texts.withColumn("set", of(F.col(text_col)))


def similar(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) of points whose sets are similar enough; ``whole`` has the set of every point."""
    least, most = SIMILAR
    one, other = (whole.select(F.col("point").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return both.where(most * F.col("common") >= least * (F.col("sizes") - F.col("common"))).select("a", "b")


def pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def tile_links(keys: list[str]):
    """Links (a, b) of tiles, from rows sorted by ``keys``: side, point, root and set."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        side = rows.column("side").to_numpy()
        point, root = (rows.column(c).to_numpy() for c in ("point", "root"))
        sets = rows.column("set").combine_chunks()
        ends = sets.offsets.to_numpy()
        values, sizes = sets.values.to_numpy(), np.diff(ends)
        at = np.flatnonzero(side == 1)
        owner = np.repeat(at, sizes[at])
        held = np.concatenate([values[ends[k] : ends[k + 1]] for k in at] or [values[:0]])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        links = []
        for k in np.flatnonzero(side == 0):
            own = values[ends[k] : ends[k + 1]]
            low, high = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
            n = high - low
            # The places low, low + 1, ... high - 1 of every shingle.
            places = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            common = np.bincount(owner[places], minlength=len(point))
            least, most = SIMILAR
            near = np.flatnonzero((root != root[k]) & (side == 1) & (most * common >= least * (sizes[k] + sizes - common)))
            _, first = np.unique(root[near], return_index=True)
            links += [(point[k], point[j]) for j in near[first]]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            names = np.stack([batch.column(c).to_numpy() for c in keys], 1)
            starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(1)))
            for a, b in zip(starts, np.append(starts[1:], len(names)), strict=True):
                if held and tuple(names[a]) != last:
                    yield of(pa.Table.from_batches(held))
                    held = []
                last = tuple(names[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield of(pa.Table.from_batches(held))

    return tiles


def rest_links(rooted: DataFrame, whole: DataFrame) -> DataFrame:
    """Links between members of a band that are in different components; ``rooted`` has band, point and root."""
    sized = settle(rooted.join(whole.select("point", (8 * F.size("set")).cast("long").alias("bytes")), "point"))
    parts = sized.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    bands = parts.groupBy("band").agg(F.count("*").alias("parts"), F.max_by(F.struct("root", "bytes"), F.struct("n", "root")).alias("largest"), F.sum("bytes").alias("bytes"))
    tiles = lambda size: F.ceil((size + 1) / TILE_BYTES).cast("int")
    bands = bands.where("parts > 1").select("band", F.col("largest.root").alias("largest"), tiles(F.col("bytes") - F.col("largest.bytes")).alias("rows"), tiles(F.col("bytes")).alias("columns"))
    dealt = sized.drop("bytes").join(settle(bands), "band").join(whole, "point")
    own = lambda salt, n: F.pmod(F.xxhash64("point", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = dealt.where("root <> largest").select("band", own(0, "rows").alias("row"), each("columns").alias("column"), F.lit(0).alias("side"), "point", "root", "set")
    columns = dealt.select("band", each("rows").alias("row"), own(1, "columns").alias("column"), F.lit(1).alias("side"), "point", "root", "set")
    keys = ["band", "row", "column"]
    return rows.unionByName(columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tile_links(keys), "a long, b long")


def fingerprint_bands(printed: DataFrame) -> DataFrame:
    """(point, band) of every point: a band for each component of the fingerprints of its rows, linked as ``simhash`` links them."""
    printed = printed.select("point", "fingerprint").distinct()
    found = components(fingerprint_links(settle(printed.select(F.col("fingerprint").alias("point")).distinct())))
    root = F.coalesce("root", "fingerprint")
    return printed.join(found, F.col("fingerprint") == F.col("node"), "left").select("point", F.xxhash64(F.lit("fingerprints"), root).alias("band")).distinct()


def point_links(texts: DataFrame, points: DataFrame, more: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar points. ``points`` has point, row (the keys of a row that has the set) and
    bands, ``more`` has point and band; ``texts`` has row_key_1, row_key_2 and text."""
    members = points.select("point", F.explode("bands").alias("band")).unionByName(more)
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    rooted = settle(members.join(shared, "band").select("band", "point", F.col("point").alias("root")))
    wanted = points.join(rooted.select("point").distinct(), "point", "left_semi").select("point", "row.*")
    whole = texts.select("row_key_1", "row_key_2", "text").join(wanted, ["row_key_1", "row_key_2"]).dropDuplicates(["point"])
    whole = settle(sets(whole).select("point", "set"))
    links = None
    for star in range(STARS):
        # A band's first member by a hash that differs from band to band.
        first = rooted.groupBy("band").agg(F.min_by(F.struct(F.col("point").alias("first"), F.col("root").alias("first_root")), F.xxhash64("band", "point", F.lit(star))).alias("f"))
        tried = rooted.join(first.select("band", "f.*"), "band").where("root <> first_root").select(*pair("point", "first")).distinct()
        found = similar(tried, whole)
        links = settle(found if links is None else links.unionByName(found))
        roots = components(links).withColumnRenamed("node", "point")
        rooted = settle(rooted.drop("root").join(roots, "point", "left").select("band", "point", F.coalesce("root", "point").alias("root")))
        apart = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
        rooted = settle(rooted.join(apart, "band", "left_semi"))
    return links.unionByName(rest_links(rooted, whole))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``row_key_1`` and ``row_key_2`` (equal for rows of equal id and text) and
    ``root``, equal for the rows of a component."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    printed = settle(sketches(keyed).drop("text"))
    points = settle(printed.groupBy("point").agg(F.min(F.struct("row_key_1", "row_key_2")).alias("row"), F.first("bands").alias("bands")))
    found = components(point_links(keyed, points, settle(fingerprint_bands(printed)))).withColumnRenamed("node", "point")
    return printed.drop("bands").join(found, "point", "left").select("doc_id", "row_key_1", "row_key_2", F.coalesce("root", "point").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near copies: of each component the row with the smallest id stays, and one of equal rows."""
    return first_of_each(docs, near_copies(docs, id_col, text_col), id_col, text_col)
