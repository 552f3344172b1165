"""Byte-level BPE encoding and decoding with a public vocabulary.

Text is cut into pre-tokens. Over the adjacent pairs of a pre-token stands a segment tree whose nodes
hold the smallest (rank, position) below them: the root is the leftmost pair of the lowest rank. A merge
changes three leaves and their paths to the root, and merging ends when the root holds no rank. The
trees of many short pre-tokens are rows of one array and are worked on together; long pre-tokens have a
tree each.

Defined results: a null or empty text has no ids and decodes to the empty text; null ids decode to the
empty text. Ids without a token are refused. Bytes that are not UTF-8 decode to U+FFFD. Texts of any
length are taken whole, a bounded number of pre-tokens at a time. Repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.common import documents, portions

#: The split of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of more bytes have a tree of their own.
SHORT = 64
#: Pre-tokens, and as many chunks, whose ids a task keeps.
KEPT = 120_000
#: Words whose trees stand side by side.
TOGETHER = 1 << 14
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file, as arrays that travel to the tasks."""

    def __init__(self, spec: bytes):
        read = json.loads(spec)
        model, before = read["model"], read["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("a byte-level BPE without prefix space is needed")
        if read["normalizer"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("normalizers, dropout and ignored merges are not supported")
        letters = byte_letters()
        as_byte = {letter: b for b, letter in enumerate(letters)}
        tokens = model["vocab"]
        self.digest = hashlib.sha256(spec).hexdigest()
        self.specials = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.bytes: list[bytes | None] = [None] * (1 + max([*tokens.values(), *self.specials.values()]))
        for token, i in tokens.items():
            self.bytes[i] = bytes(as_byte[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.array([tokens[c] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = len(self.bytes)
        pairs = np.array([tokens[a] * self.width + tokens[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.merged = np.array([tokens[a + b] for a, b in merges], np.int32)
        self.byte_ranks = self.rank(*np.broadcast_arrays(self.of_byte[:, None], self.of_byte)).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or NONE."""
        wanted = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], NONE)


def read_vocabulary(path: str) -> Vocabulary:
    """Read on the driver; the vocabulary, of fixed size, goes to the tasks with the function."""
    with open(path, "rb") as file:
        return Vocabulary(file.read())


def merge_short(vocabulary: Vocabulary, words: list[bytes], leaves: int) -> list[bytes]:
    """Ids, four bytes each, of words of 2 to ``leaves`` + 1 bytes; ``leaves`` is a power of two."""
    n, slots = len(words), leaves + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    column = np.arange(slots)
    alive = column < lengths[:, None]
    flat = np.frombuffer(b"".join(words), np.uint8)
    ids = np.zeros((n, slots), np.int32)
    ids[alive] = vocabulary.of_byte[flat]
    tree = np.full((n, 2 * leaves), NONE, np.int32)
    real = column[:-1] < lengths[:, None] - 1
    left = np.zeros((n, slots), np.uint8)
    left[alive] = flat
    rank = vocabulary.byte_ranks[left[:, :-1][real], left[:, 1:][real]]
    tree[:, leaves:][real] = np.where(rank == NONE, NONE, rank * leaves + np.nonzero(real)[1])
    k = leaves // 2
    while k:
        np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
        k //= 2
    # From here on all arrays are flat; a row's cells begin at row * slots, its tree at row * 2 * leaves.
    ids, tree, living = ids.ravel(), tree.ravel(), alive.ravel()
    after, before = np.tile(column + 1, n), np.tile(column - 1, n)

    def put(top: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + leaves
        tree[top + node] = value
        for _ in range(leaves.bit_length() - 1):
            node = node >> 1
            child = top + 2 * node
            tree[top + node] = np.minimum(tree[child], tree[child + 1])

    rows = np.arange(n)
    while True:
        root = tree[rows * (2 * leaves) + 1]
        open_ = root != NONE
        rows, root = rows[open_], root[open_].astype(np.int64)
        if not len(rows):
            break
        cell, top = rows * slots, rows * (2 * leaves)
        at = root % leaves
        gone = after[cell + at]
        follows = after[cell + gone]
        ids[cell + at] = vocabulary.merged[root // leaves]
        living[cell + gone] = False
        after[cell + at] = follows
        led = before[cell + at]
        right, left = np.flatnonzero(follows < lengths[rows]), np.flatnonzero(led >= 0)
        before[cell[right] + follows[right]] = at[right]
        pair_cells = [(cell[right], at[right], follows[right]), (cell[left], led[left], at[left])]
        first, second = (np.concatenate([ids[c + x[k]] for c, *x in pair_cells]) for k in (0, 1))
        place = np.concatenate([at[right], led[left]])
        rank = vocabulary.rank(first, second)
        found = np.where(rank == NONE, NONE, rank * leaves + place)
        new = np.full(len(rows), NONE, np.int32)
        new[right] = found[: len(right)]
        shut = np.flatnonzero(gone < leaves)
        # Paths that meet write the same minimum, so the three leaves of a merge go up together.
        put(
            np.concatenate([top[shut], top, top[left]]),
            np.concatenate([gone[shut], at, led[left]]),
            np.concatenate([np.full(len(shut), NONE, np.int32), new, found[len(right) :]]),
        )
    ends = np.cumsum(4 * alive.sum(1)).tolist()
    raw = ids[living].tobytes()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def merge_long(vocabulary: Vocabulary, word: bytes) -> bytes:
    """Ids, four bytes each, of one word of any length, with a tree of (rank, position) numbers in a list."""
    ids = vocabulary.of_byte[np.frombuffer(word, np.uint8)]
    size = 1 << max(1, (len(ids) - 1).bit_length())
    none = sys.maxsize
    rank = vocabulary.rank(ids[:-1], ids[1:]).astype(np.int64)
    level = np.full(size, none, np.int64)
    level[: len(rank)] = np.where(rank == NONE, none, (rank << 32) + np.arange(len(rank)))
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [none, *itertools.chain.from_iterable(x.tolist() for x in reversed(levels))]
    rank_of = dict(zip(vocabulary.pairs.tolist(), vocabulary.ranks.tolist(), strict=True)).get
    merged, width, end = vocabulary.merged.tolist(), vocabulary.width, len(ids)
    ids, after, before = ids.tolist(), list(range(1, end + 1)), list(range(-1, end - 1))

    def put(leaf: int) -> None:
        right = after[leaf]
        rank = rank_of(ids[leaf] * width + ids[right]) if ids[leaf] >= 0 and right < end else None
        node = leaf + size
        tree[node] = none if rank is None else (rank << 32) + leaf
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] != none:
        rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        gone = after[at]
        ids[at], ids[gone] = merged[rank], -1
        after[at] = after[gone]
        if after[gone] < end:
            before[after[gone]] = at
        put(gone)
        put(at)
        if before[at] >= 0:
            put(before[at])
    return np.array([i for i in ids if i >= 0], np.int32).tobytes()


class Encoder:
    """Encodes texts in a worker; the ids of recent pre-tokens, and of recent chunks between spaces or their number, are kept."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers.pre_tokenizers import ByteLevel

        self.vocabulary = vocabulary
        self.kept: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}
        self.wide = re.compile(r"\s\s")
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True)))) if vocabulary.specials else None
        # Unicode versions differ only in code points that an older one does not assign: texts with such, or with
        # any beyond 16 bits (which would make the search slow), go to the library's own split.
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        open_points = (c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cn")
        spans = [[c for _, c in group] for _, group in itertools.groupby(enumerate(open_points), lambda x: x[1] - x[0])]
        self.odd = re.compile("[" + "".join(f"\\u{s[0]:04x}-\\u{s[-1]:04x}" for s in spans) + "\U00010000-\U0010ffff]")

    def __enter__(self) -> Encoder:
        return self

    def __exit__(self, *_) -> None:
        self.kept.clear()
        self.chunks.clear()
        self.counts.clear()
        pa.default_memory_pool().release_unused()

    def pieces(self, text: str) -> Iterator[str]:
        if not text.isascii() and self.odd.search(text):
            return (text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text))
        return (m[0] for m in self.split.finditer(text)) if len(text) > 1 << 20 else iter(self.split.findall(text))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, four bytes each; words of about the same length are merged together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        ends = np.searchsorted(lengths[order], [1, 3, 5, 9, 17, 33, SHORT + 1], "right").tolist()
        found: list[bytes] = [b""] * len(words)
        start = 0
        for most, end in zip((1, 3, 5, 9, 17, 33, SHORT + 1), ends, strict=True):
            for first in range(start, end, TOGETHER):
                group = order[first : min(end, first + TOGETHER)].tolist()
                own = [words[i] for i in group]
                ids = [self.vocabulary.of_byte[w[0]].tobytes() for w in own] if most == 1 else merge_short(self.vocabulary, own, most - 1)
                for i, x in zip(group, ids, strict=True):
                    found[i] = x
            start = end
        for i in order[start:].tolist():
            found[i] = merge_long(self.vocabulary, words[i])
        return found

    def ids_of(self, pieces: list[str]) -> bytes:
        """Ids of some pre-tokens one after the other, four bytes each."""
        return self.ids_of_each([pieces])[0]

    def ids_of_each(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of several lists of pre-tokens, which are learnt together: a few words at a time cost as much as thousands."""
        self.learn(set().union(*lists), self.kept, lambda new: self.merge([w.encode() for w in new]))
        get = self.kept.__getitem__
        return [b"".join(map(get, pieces)) for pieces in lists]

    @staticmethod
    def learn(wanted: set[str], kept: dict, merge, most: int = KEPT) -> None:
        """Adds what is wanted to what is kept; if that were too much, only what is wanted stays."""
        missing = wanted.difference(kept)
        if len(kept) + len(missing) > most:
            old = {w: kept[w] for w in wanted if w in kept}
            kept.clear()
            kept.update(old)
        if missing:
            new = list(missing)
            kept.update(zip(new, merge(new), strict=True))

    def merge_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that follow a space. Only those that are not all letters have several pre-tokens."""
        split = [None if c.isalpha() else self.split.findall(" " + c) for c in chunks]
        ids = iter(self.merge([b" " + c.encode() for c, own in zip(chunks, split, strict=True) if own is None]))
        self.learn(set(itertools.chain.from_iterable(filter(None, split))), self.kept, lambda new: self.merge([w.encode() for w in new]))
        get = self.kept.__getitem__
        return [next(ids) if own is None else b"".join(map(get, own)) for own in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each. The chunks of all texts are learnt together.

        Unless white space stands beside white space, no pre-token reaches over the place before a space, so a
        text is cut at its spaces and the ids of a chunk that follows a space are the same anywhere.
        """
        plain = [len(t) <= 1 << 20 and not any(s in t for s in self.vocabulary.specials) and not self.wide.search(t) and (t.isascii() or not self.odd.search(t)) for t in texts]
        cut = [t.split(" ") if p else None for t, p in zip(texts, plain, strict=True)]
        self.learn(set().union(*(c[1:] for c in cut if c)), self.chunks, self.merge_chunks)
        heads = self.ids_of_each([self.split.findall(c[0]) if c else [] for c in cut])
        get = self.chunks.__getitem__
        return [head + b"".join(map(get, c[1:])) if c else self.other(t) for t, c, head in zip(texts, cut, heads, strict=True)]

    def other(self, text: str) -> bytes:
        """As encode, for any text: cut at special tokens, a bounded number of pre-tokens at a time."""
        out, done = [], 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            pieces = self.pieces(text[done : m.start() if m else len(text)])
            while some := list(itertools.islice(pieces, 1 << 18)):
                out.append(self.ids_of(some))
            if m:
                out.append(np.int32(self.vocabulary.specials[m[0]]).tobytes())
                done = m.end()
        return b"".join(out)


ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder, kept between its tasks; ``with`` lets go of what it learnt when a task ends."""
    if vocabulary.digest not in ENCODERS:
        ENCODERS[vocabulary.digest] = Encoder(vocabulary)
    return ENCODERS[vocabulary.digest]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the token ids of the whole text as ``array<int>``; null and empty texts get an empty array."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with encoder(vocabulary) as tool:
            for texts in batches:
                parts = [pa.array([], pa.list_(pa.int32()))]
                for some in portions(texts):
                    found = tool.encode([t or "" for t in some])
                    ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                    parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32))))
                yield pa.concat_arrays(parts)

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of the ids, special tokens included; null ids give the empty text."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        token = vocabulary.bytes
        return pa.array([b"".join(map(token.__getitem__, row)).decode("utf-8", "replace") for row in each_list(ids)], pa.string())

    return docs.withColumn(text_col, text(F.col(ids_col)))


def each_list(ids: pa.Array) -> Iterator[list[int]]:
    """One list at a time, so that a batch is not all Python numbers at once."""
    for row in ids:
        values = row.values
        yield [] if values is None else values.to_numpy(zero_copy_only=False).tolist()


def default_vocabulary(name: str = "byte_bpe_50k.json") -> Vocabulary:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path(name))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of the ids and of the decoded text."""
    vocabulary = default_vocabulary()
    both = decode(encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op6_bpe_codec": op6_bpe_codec}
ORACLES: dict[str, str] = {}
