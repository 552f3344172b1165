"""Removal of word runs that occur more than once, with a count-min sketch before the exact count.

A window is a number of consecutive words of one text. Its anchor is the smallest hash among the shorter
runs inside it; equal windows have equal anchors, at the same place, so no window starts more often than
its anchor stands somewhere. There are about ten times fewer anchor places than windows.

1. Every task counts its anchor places in a count-min sketch (two rows); the sketches of all tasks are
   merged cell by cell. What is kept of a merged cell is whether it holds two or more. Cells only
   overestimate, so a window whose anchor has a cell below two in either row starts nowhere else.
2. The other windows are counted exactly, by 128 bits of two independent hashes of all their words. A task
   sends a window once however often it has it: with the address of its only place, or as known repeated.
   The counting task sends the places of repeated windows back to their documents.
   Windows go to counting tasks by their anchor, which keeps runs of places together. The windows around a phrase
   of many documents share anchors and differ themselves; those of anchors that a task of the first step met
   ``HOT`` times or more, and of all in the same cell, go by their own hash.

The sketch grows with the input up to ``MOST_SKETCH`` bytes, which is what a broadcast may hold; beyond, it
lets more windows pass to the exact count, and loses none. Windows are judged on the input.

Defined results: a null or empty text has no words; texts shorter than a window keep all words; repeated
rows repeat each other's windows; rows of equal id and text get equal results. Words of any length and
texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.common import documents, portions, row_key, word_blocks

WINDOW = 35
#: Both rows of the merged sketch together, in bytes, at most; every Python worker holds it.
MOST_SKETCH = 256 << 20
#: Blocks of a sketch row that are merged apart; places and candidates a task holds before it sends them.
BLOCKS, HELD_PLACES, HELD_WINDOWS = 256, 2 << 20, 1 << 19
#: Bytes of text for each bucket of the exact count, so that a bucket fits a task however much passes the sketch.
BUCKET_BYTES = 4 << 20
#: Places of one sketch cell among those that a task holds, from which its windows are dealt out by their own hash.
HOT = 256
#: Words whose hashes a worker keeps.
KEPT = 200_000

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
U64 = np.uint64


class WordHashes(dict):
    """Hash of each word; the most recent ones are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def hashes_of(text: str | None) -> np.ndarray:
    return np.concatenate([np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words)) for words in word_blocks((text or "").encode(), 0)])


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if base not in POWERS or len(POWERS[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = [np.where(np.arange(size) == 0, U64(1), U64(b)) for b in (base, pow(base, -1, 1 << 64))]
        POWERS[base] = tuple(np.cumprod(x, dtype=U64) for x in steps)
    return POWERS[base][0][:n], POWERS[base][1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def run_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of n words, by its start."""
    if len(words) < n:
        return np.zeros(0, U64)
    up, down = powers(base, len(words))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * up, dtype=U64)])
    return mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def sliding(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """Best of each n consecutive values, by doubling."""
    span = 1
    while 2 * span <= n:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


class Windows:
    """The windows of some texts one after the other; ``valid`` starts do not run over a text's end."""

    def __init__(self, texts: list[str | None], window: int):
        own = [hashes_of(t) for t in texts]
        self.lengths = np.array([len(x) for x in own], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words, self.window = np.concatenate([*own, np.zeros(0, U64)]), window
        self.part = max(1, window // 2)
        n = max(0, len(self.words) - window + 1)
        self.valid = np.ones(n, bool)
        for end in (self.starts + self.lengths).tolist()[:-1]:
            self.valid[max(0, end - window + 1) : end] = False

    @cached_property
    def pieces(self) -> np.ndarray:
        """Hashes of the shorter runs that anchors are chosen from."""
        return run_hashes(self.words, self.part, BASES[0])

    @cached_property
    def anchor(self) -> np.ndarray:
        return sliding(self.pieces, self.window - self.part + 1) if len(self.valid) else np.zeros(0, U64)

    def places(self) -> np.ndarray:
        """The anchor hash at each place that is some window's anchor; ties are all places."""
        if not self.valid.any():
            return np.zeros(0, U64)
        width = self.window - self.part + 1
        padding = np.zeros(width - 1, U64)
        reach = sliding(np.concatenate([padding, np.where(self.valid, self.anchor, U64(0)), padding]), width, np.maximum)
        return self.pieces[reach[: len(self.pieces)] >= self.pieces]

    def exact(self, at: np.ndarray) -> list[np.ndarray]:
        """128 bits of the windows at some starts."""
        second = mixed(self.words ^ U64(0x94D049BB133111EB))
        return [run_hashes(w, self.window, b)[at] for w, b in ((self.words, BASES[0]), (second, BASES[1]))]


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (anchor * U64(ROWS[row])) >> U64(64 - bits)


def sketch_bits(text_bytes: int) -> int:
    """log2 of the cells in a row: about one for every eight bytes of text, as far as the bound goes."""
    return min(max(12, (text_bytes // 8).bit_length()), (MOST_SKETCH * 8 // len(ROWS)).bit_length() - 1)


SKETCH = "part int, block int, once array<int>, more array<int>, hot array<int>"
SKETCH_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("once", "more", "hot"))])


def sketcher(window: int, bits: int):
    """Partition sketches: of each row and block the cells counted once and more often; those of them, in the first row, that are hot."""
    shift = max(0, bits - BLOCKS.bit_length() + 1)

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors, out = np.concatenate(held), []
        for row in range(len(ROWS)):
            cell, count = np.unique(cells(anchors, row, bits), return_counts=True)
            block = (cell >> U64(shift)).astype(np.int64)
            offset = (cell & U64((1 << shift) - 1)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                single = count[a:b] == 1
                out.append((row, int(block[a]), offset[a:b][single], offset[a:b][~single], offset[a:b][(count[a:b] >= HOT) & (row == 0)]))
        yield pa.RecordBatch.from_pylist([dict(zip(SKETCH_ARROW.names, r, strict=True)) for r in out], SKETCH_ARROW)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for texts in portions(batch.column("text")):
                held.append(Windows(texts, window).places())
                n += len(held[-1])
                if n >= HELD_PLACES:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    return sketch


MERGED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("bits", pa.binary()), ("hot", pa.list_(pa.int32()))])


def merger(bits: int):
    size = 1 << max(0, bits - BLOCKS.bit_length() + 1)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hot = np.zeros(size, np.uint8), np.zeros(size, bool)
        for batch in batches:
            for name, n in (("once", 1), ("more", 2)):
                for own in batch.column(name):
                    at = own.values.to_numpy(zero_copy_only=False)
                    counts[at] = np.minimum(counts[at] + n, 2)
            hot[batch.column("hot").flatten().to_numpy(zero_copy_only=False)] = True
        yield pa.RecordBatch.from_pylist([{"part": key[0].as_py(), "block": key[1].as_py(), "bits": np.packbits(counts == 2, bitorder="little").tobytes(), "hot": np.flatnonzero(hot)}], MERGED)

    return merge


def merged_sketch(docs: DataFrame, window: int, bits: int) -> tuple[list[bytes], np.ndarray]:
    """For each row one bit a cell: whether the cell holds two or more. The hot cells of the first row, in order."""
    rows = docs.select("text").mapInArrow(sketcher(window, bits), SKETCH)
    blocks = rows.groupBy("part", "block").applyInArrow(merger(bits), "part int, block int, bits binary, hot array<int>")
    size = max(1, (1 << max(0, bits - BLOCKS.bit_length() + 1)) // 8)
    shift = max(0, bits - BLOCKS.bit_length() + 1)
    whole, hot = [bytearray(size * BLOCKS) for _ in ROWS], [np.zeros(0, U64)]
    for r in blocks.toLocalIterator():
        whole[r.part][r.block * size : r.block * size + len(r.bits)] = r.bits
        hot.append(np.array(r.hot, U64) | U64(r.block << shift))
    return [bytes(w) for w in whole], np.sort(np.concatenate(hot))


FOUND = "bucket int, known boolean, row_key_1 array<long>, row_key_2 array<long>, first array<int>, last array<int>, a array<long>, b array<long>"
FOUND_ARROW = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), *((c, pa.list_(pa.int64())) for c in ("row_key_1", "row_key_2")), *((c, pa.list_(pa.int32())) for c in ("first", "last")), *((c, pa.list_(pa.int64())) for c in ("a", "b"))])
MARKS = pa.schema([("row_key_1", pa.int64()), ("row_key_2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def spans(key_1: np.ndarray, key_2: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Places joined to runs of consecutive starts of one row key."""
    order = np.lexsort((start, key_2, key_1))
    key_1, key_2, start = key_1[order], key_2[order], start[order]
    same = (np.diff(key_1) == 0) & (np.diff(key_2) == 0) & (np.diff(start) <= 1)
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(start) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:] - 1, [len(start) - 1]]) if len(start) else first
    return [key_1[first], key_2[first], start[first].astype(np.int32), start[last].astype(np.int32)]


def repeats(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window whether the weights of all equal ones reach two, and one position for each distinct window."""
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]) if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    found = np.zeros(len(a), bool)
    found[order] = (np.bincount(group, weight[order], minlength=1) >= 2)[group]
    return found, order[new]


def buckets_of(anchor: np.ndarray, a: np.ndarray, bits: int, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each window, the same for equal ones: by the anchor, or by the window where the anchor's cell is hot."""
    return (mixed(np.where(np.isin(cells(anchor, 0, bits), hot), a.view(U64), anchor)) % U64(buckets)).astype(np.int64)


def finder(window: int, bits: int, sketch, buckets: int):
    """Windows that the sketch takes for repeated: runs of places that this task knows to be repeated, and for
    each bucket of the exact count every distinct window once, with its place (first) if that is the only one here."""

    def passes(anchor: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        ok = np.ones(len(anchor), bool)
        for row, held in enumerate(rows):
            cell = cells(anchor, row, bits)
            ok &= (held[cell >> U64(3)] >> (cell & U64(7)).astype(np.uint8) & 1).astype(bool)
        return ok

    def emit(held: list[tuple], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchor, a, b, key_1, key_2, start = (np.concatenate(x) for x in zip(*held, strict=True))
        here, one = repeats(a, b, np.ones(len(a)))
        out = []
        known = [key_1[here], key_2[here], start[here]]
        if here.any():
            k1, k2, first, last = spans(*known)
            for group in np.array_split(np.arange(len(k1)), max(1, len(k1) // 4096)):
                out.append((int(k1[group[0]] % buckets), True, k1[group], k2[group], first[group], last[group], [], []))
        bucket = buckets_of(anchor[one], a[one], bits, hot, buckets)
        order = np.lexsort((one, bucket))
        one, bucket = one[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
        for x, y in zip(cuts, cuts[1:], strict=False):
            at = one[x:y]
            # A window that stands here more than once has no address: its places are among the known ones.
            out.append((int(bucket[x]), False, key_1[at], key_2[at], np.where(here[at], -1, start[at]).astype(np.int32), [], a[at], b[at]))
        for k in range(0, len(out), 512):
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND_ARROW.names, r, strict=True)) for r in out[k : k + 512]], FOUND_ARROW)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hot = [np.frombuffer(r, np.uint8) for r in sketch.value[0]], sketch.value[1]
        held, n = [], 0
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_key_1", "row_key_2")]
            done = 0
            for texts in portions(batch.column("text")):
                own = Windows(texts, window)
                at = np.flatnonzero(own.valid)
                at = at[passes(own.anchor[at], rows)]
                if len(at):
                    doc = np.searchsorted(own.starts, at, "right") - 1
                    # Empty texts share their start with the next; the last one that starts there has the words.
                    a, b = (h.view(np.int64) for h in own.exact(at))
                    held.append((own.anchor[at], a, b, keys[0][done + doc], keys[1][done + doc], at - own.starts[doc]))
                    n += len(at)
                done += len(texts)
                if n >= HELD_WINDOWS:
                    yield from emit(held, hot)
                    held, n = [], 0
        if n:
            yield from emit(held, hot)

    return find


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of places of a bucket whose windows are repeated. Known runs pass through."""
    held = []
    for batch in batches:
        known = batch.column("known").to_numpy(zero_copy_only=False)
        take = lambda c, which: batch.column(c).filter(pa.array(which)).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(take(c, known)) for c in MARKS.names], schema=MARKS)
        held.append([take(c, ~known) for c in ("a", "b", "row_key_1", "row_key_2", "first")])
    a, b, key_1, key_2, first = (np.concatenate(x) for x in zip(*held, strict=True))
    found, _ = repeats(a, b, np.where(first < 0, 2.0, 1.0))
    found &= first >= 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans(key_1[found], key_2[found], first[found])], schema=MARKS)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs (first, last) of starts of repeated windows, by row key; ``docs`` has row_key_1, row_key_2 and text."""
    spark = docs.sparkSession
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(text_bytes)
    sketch = spark.sparkContext.broadcast(merged_sketch(docs, window, bits))
    buckets = max(BLOCKS, text_bytes // BUCKET_BYTES)
    found = docs.select("row_key_1", "row_key_2", "text").mapInArrow(finder(window, bits, sketch, buckets), FOUND)
    return found.groupBy("bucket").applyInArrow(decide, "row_key_1 long, row_key_2 long, first int, last int")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words outside every repeated window joined by a space, for each row."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    marks = repeated_windows(keyed, window).groupBy("row_key_1", "row_key_2").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    result = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def rest(texts: pa.Array, marks: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts, marks, strict=True):
            n, kept, n_kept = 0, [], 0
            bounds = [(x["first"], x["last"] + window) for x in own.as_py() or ()]
            for words in word_blocks((text.as_py() or "").encode(), 0):
                stays = np.ones(len(words), bool)
                for a, b in bounds:
                    stays[max(0, a - n) : max(0, b - n)] = False
                left = words if not bounds else [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                n, n_kept = n + len(words), n_kept + len(left)
                if left:
                    kept.append(b" ".join(left))
            rows.append({"n_words": n, "n_removed": n - n_kept, "kept": b" ".join(kept).decode()})
        return pa.array(rows, result)

    return keyed.join(marks, ["row_key_1", "row_key_2"], "left").withColumn("rest", rest("text", "marks")).select("doc_id", "rest.*")


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when windows that also start elsewhere go."""
    return remove_repeated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9 = r"""
WITH spelled AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), place AS (
    SELECT r, k, sha256(array_to_string(w[k : k + 34], ' ')) AS run FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM spelled)
), repeated AS (
    SELECT r, k FROM place JOIN (SELECT run FROM place GROUP BY run HAVING count(*) > 1) USING (run)
), word AS (
    SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM spelled
), kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
    FROM word ANTI JOIN (SELECT DISTINCT r, unnest(range(k, k + 35)) AS pos FROM repeated) AS g USING (r, pos) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM spelled LEFT JOIN kept USING (r)
"""

QUERIES = {"op9_repeated_substrings": op9_repeated_substrings}
ORACLES = {"op9_repeated_substrings": OP9}
