"""Removal of benchmark passages with a generalised suffix automaton of the benchmark's words.

The automaton of a block of items accepts every run of words of any of them. A document's words stream
through it; the state after a word knows the longest run ending there that some item holds. Where that
run has the words of a window, the window's words are hit, and the state names the items. A word that no
item has leads back to the start, at the cost of one lookup.

The benchmark comes to the tasks in blocks of at most ``BLOCK_WORDS`` words; every block is held against
all documents, so a benchmark may have any size. Blocks after the first carry the findings along through
a written table.

Defined results: a null or empty text has no words and no findings; a null or wordless item has no
window. Items of fewer words than a window are one window. Rows of the benchmark with the same id are one
item; items with a null id hit words but are not named. Equal documents get equal findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.common import documents, free_names
from snapcat.session import settle

WINDOW = 10
#: Words of items in one automaton: about two states each, a few hundred bytes a state.
BLOCK_WORDS = 200_000
#: Documents of which a larger part is hit are dropped; of others the hit spans are cut out.
MOST_COVERED = 0.5

#: A-Z to a-z; every other ASCII byte outside 0-9 and a-z to a space. Positions stay.
PLAIN = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
FOUND = "struct<n_words:long,longest:long,spans:array<struct<first:long,last:long>>,items:array<string>>"
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("longest", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


class Automaton:
    """States of all runs of words of some items, with the items that hold a window at the window's state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.word.setdefault(w, len(self.word)) for w in words]) for name, words in items]
        for _, words in coded:
            last = 0
            for w in words:
                last = self.extend(last, w)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: Where a state's run has a window's length or more: the state of its last ``window`` words.
        self.tail = [0] * len(self.link)
        for s in order:
            if self.length[s] >= window:
                self.tail[s] = s if self.length[self.link[s]] < window else self.tail[self.link[s]]
        self.holders: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        for name, words in coded:
            s = n = 0
            for w in words:
                s, n = self.step(s, n, w)
                if n >= window:
                    self.holders.setdefault(self.tail[s], set()).add(name)
            if 0 < len(words) < window:
                short.setdefault(s, {}).setdefault(len(words), set()).add(name)
        #: Whole short items that end where a state's run ends, as (words, names), shortest first.
        self.short: list[tuple] = [()] * len(self.link)
        for s in order:
            self.short[s] = self.short[self.link[s]] + tuple(sorted((n, frozenset(names)) for n, names in short.get(s, {}).items()))
        self.least = min([window if self.holders else 1 << 60, *(n for own in short.values() for n in own)])

    def extend(self, last: int, w: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if (q := nexts[last].get(w)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self.split(last, q, w)
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, q, w)
        return new

    def split(self, p: int, q: int, w: int) -> int:
        """A copy of q for the shorter runs that reach it by w from p."""
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def step(self, s: int, n: int, w: int) -> tuple[int, int]:
        """State and length of the longest run that ends with w."""
        nexts, link = self.next, self.link
        while (to := nexts[s].get(w)) is None:
            if not s:
                return 0, 0
            s = link[s]
            n = self.length[s]
        return to, n + 1

    def scan(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set]:
        """Longest run, hit spans (first and last word) in order, and the items whose windows occur."""
        get, step, tail, short, window, least = self.word.get, self.step, self.tail, self.short, self.window, self.least
        s = n = longest = 0
        spans: list[list[int]] = []
        states, wholes = set(), set()
        for at, word in enumerate(words):
            w = get(word)
            if w is None:
                s = n = 0
                continue
            s, n = step(s, n, w)
            if n > longest:
                longest = n
            if n >= least:
                hit = 0
                for m, names in short[s]:
                    if m <= n:
                        hit = m
                        wholes.add(names)
                if n >= window:
                    hit = window
                    states.add(tail[s])
                if hit:
                    first = at - hit + 1
                    while spans and spans[-1][1] >= first - 1:
                        first = min(first, spans.pop()[0])
                    spans.append([first, at])
        return longest, [(a, b) for a, b in spans], set().union(*wholes, *(self.holders[s] for s in states))


AUTOMATA: dict[tuple, Automaton] = {}


def automaton(key: tuple, items: list[tuple[str | None, list[bytes]]], window: int) -> Automaton:
    """This worker's automaton; it is built once and kept until a task brings another block."""
    if key not in AUTOMATA:
        AUTOMATA.clear()
        AUTOMATA[key] = Automaton(items, window)
    return AUTOMATA[key]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of at most ``most`` words; a longer item in pieces that overlap, so that no window is lost."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        words = words_of(row.text)
        for a in range(0, max(1, len(words) - window + 1), max(1, most - window + 1)) if words else ():
            piece = words[a : a + most]
            if held and held + len(piece) > most:
                yield block
                block, held = [], 0
            block.append((row.id, piece))
            held += len(piece)
    if block:
        yield block


def scanner(items: list[tuple[str | None, list[bytes]]], window: int):
    key = (hash(tuple((name, tuple(words)) for name, words in items)), len(items), window)

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        machine = automaton(key, items, window)
        rows = []
        for text, earlier in zip(texts, before, strict=True):
            words = words_of(text.as_py())
            longest, spans, names = machine.scan(words)
            names.discard(None)
            if (old := earlier.as_py()) is not None:
                longest, names = max(longest, old["longest"]), names | set(old["items"])
                spans = union([*spans, *((x["first"], x["last"]) for x in old["spans"])])
            rows.append({"n_words": len(words), "longest": longest, "spans": [{"first": a, "last": b} for a, b in spans], "items": sorted(names)})
        return pa.array(rows, FOUND_ARROW)

    # So that a filter on the findings does not scan a second time to be applied earlier.
    return scan.asNondeterministic()


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined]


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, to: str = "found") -> DataFrame:
    """Adds ``to``: number of words, longest run shared with an item, hit spans of words, and sorted ids of the items found."""
    out, first = docs.withColumn(to, F.lit(None).cast(FOUND)), True
    for items in blocks(benchmark, item_id, item_text, window):
        out = (out if first else settle(out)).withColumn(to, scanner(items, window)(F.col(text_col), F.col(to)))
        first = False
    return out.withColumn(to, scanner([], window)(F.col(text_col), F.col(to))) if first else out


def hit_words(found: str = "found"):
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def cut(text: str, spans: list[dict]) -> str:
    """The text without the spans of words and the white space before each."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", raw.translate(PLAIN))]
    kept, done = [], 0
    for x in spans:
        kept.append(raw[done : places[x["first"]][0]].rstrip())
        done = places[x["last"]][1]
    return b"".join([*kept, raw[done:]]).decode().strip()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_covered: float = MOST_COVERED) -> DataFrame:
    """Cuts hit spans out of the texts and drops documents of which more than ``most_covered`` is hit.

    Other documents, null texts among them, stay as they are, all their columns too.
    """
    (mark,) = free_names(docs, "found")
    found = benchmark_spans(docs, benchmark, text_col, item_id, item_text, window, mark)
    found = found.where(hit_words(mark) <= F.lit(most_covered) * F.col(f"{mark}.n_words"))

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, marks: pa.Array) -> pa.Array:
        spans = (m["spans"].as_py() for m in marks)
        return pa.array([cut(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, spans, strict=True)], pa.string())

    return found.withColumn(text_col, cleaned(F.col(text_col), F.col(mark))).select(*docs.columns)


def op8_benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of the whole benchmark hit."""
    found = benchmark_spans(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "found.n_words",
        hit_words().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


OP8 = r"""
WITH spelled AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS run
    FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)
), place AS (
    SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS run
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM spelled, (SELECT DISTINCT n FROM win))
), hit AS (
    SELECT p.r, p.k, p.n, win.item_id FROM place AS p JOIN win ON p.n = win.n AND p.run = win.run
), hit_count AS (
    SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM spelled LEFT JOIN hit_count USING (r) LEFT JOIN named USING (r)
"""

QUERIES = {"op8_benchmark_spans": op8_benchmark_spans}
ORACLES = {"op8_benchmark_spans": OP8}
