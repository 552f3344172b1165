"""Token counts that follow edits: only what an edit touches is encoded again.

A text is kept as chunks that begin with white space after something else. No pre-token reaches over such
a place, whatever stands around it, so a chunk has the same tokens anywhere. Some chunks together are a
leaf of a segment tree whose nodes hold the characters and tokens below them. An edit goes down the tree
to the chunks that hold it and the character before and after it; these are spelled anew, cut and encoded
again, and the sums on the paths to the root follow.

Defined results: a null text is empty, null edits are none. Edits apply one after the other; each counts
code points in the text that the ones before it left. Places beyond the end are the end; null places and
lengths are 0, null insertions nothing. A document and its edits are one row and are worked on in one
task. Repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.bpe import Encoder, Vocabulary, default_vocabulary, encoder
from snapcat.llm.common import documents, portions

#: Chunks in a leaf at first; an edited leaf may have more.
LEAF = 64
#: Chunks whose number of tokens a task keeps.
KEPT = 400_000
#: Unicode white space, which is what the split of the vocabulary goes by.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
EDITS = "array<struct<at:int,remove:int,put:string>>"
EDITS_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("remove", pa.int32()), ("put", pa.string())]))
FOUND = "struct<n_before:long,n_after:long,n_edits:long,n_encoded:long>"
FOUND_ARROW = pa.struct([(c, pa.int64()) for c in ("n_before", "n_after", "n_edits", "n_encoded")])


def is_simple(tool: Encoder, text: str) -> bool:
    """Whether spaces alone cut the text, and its chunks need no special care."""
    return not tool.wide.search(text) and not any(s in text for s in tool.vocabulary.specials) and (text.isascii() or not tool.odd.search(text))


def counted(tool: Encoder, texts: list[str]) -> list[tuple[list[str], list[int]]]:
    """Chunks and their tokens for each text. The chunks of all simple texts are learnt together."""
    cut = [t.split(" ") if is_simple(tool, t) else None for t in texts]
    tool.learn(set().union(*(c[1:] for c in cut if c)), tool.counts, lambda new: [len(ids) // 4 for ids in tool.merge_chunks(new)], KEPT)
    heads = tool.ids_of_each([tool.split.findall(c[0]) if c else [] for c in cut])
    get, out = tool.counts.__getitem__, []
    for text, own, head in zip(texts, cut, heads, strict=True):
        if own is None:
            chunks = CHUNK.findall(text)
            out.append((chunks, [chunk_tokens(tool, c) for c in chunks]))
        elif text:
            # The first chunk may be empty: the text begins with a space.
            tokens = [len(head) // 4, *map(get, own[1:])]
            own[1:] = map(" ".__add__, own[1:])
            out.append((own, tokens))
        else:
            out.append(([], []))
    return out


def chunk_tokens(tool: Encoder, chunk: str) -> int:
    """Tokens of a chunk; what follows a space in a simple text is known already, as its count holds anywhere."""
    known = tool.counts.get(chunk[1:]) if chunk[0] == " " else None
    return len(tool.other(chunk)) // 4 if known is None else known


class CountedText:
    """A text as leaves of chunks, and sums of characters and tokens over them."""

    def __init__(self, tool: Encoder, chunks: list[str], tokens: list[int]):
        self.tool, self.encoded = tool, 0
        self.chunks = [chunks[k : k + LEAF] for k in range(0, len(chunks), LEAF)] or [[]]
        self.tokens = [tokens[k : k + LEAF] for k in range(0, len(chunks), LEAF)] or [[]]
        self.size = 1 << (len(self.chunks) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.size)
        for leaf in range(len(self.chunks)):
            self.sums[self.size + leaf] = (sum(map(len, self.chunks[leaf])), sum(self.tokens[leaf]))
        for node in range(self.size - 1, 0, -1):
            self.add_up(node)

    def add_up(self, node: int) -> None:
        (a, b), (c, d) = self.sums[2 * node], self.sums[2 * node + 1]
        self.sums[node] = (a + c, b + d)

    def update(self, leaf: int) -> None:
        node = self.size + leaf
        self.sums[node] = (sum(map(len, self.chunks[leaf])), sum(self.tokens[leaf]))
        while node > 1:
            node //= 2
            self.add_up(node)

    @property
    def n_chars(self) -> int:
        return self.sums[1][0]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def find(self, place: int) -> tuple[int, int, int]:
        """Leaf, chunk and start of the chunk that holds a character; the text is not empty."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place - start >= self.sums[node][0]:
                start += self.sums[node][0]
                node += 1
        leaf = node - self.size
        for k, chunk in enumerate(self.chunks[leaf]):
            if place - start < len(chunk):
                return leaf, k, start
            start += len(chunk)
        raise IndexError(place)

    def edit(self, at: int, remove: int, put: str) -> None:
        at = min(max(at, 0), self.n_chars)
        remove = min(max(remove, 0), self.n_chars - at)
        if not remove and not put:
            return
        if self.n_chars:
            leaf, first, start = self.find(max(0, at - 1))
            until, last, _ = self.find(min(self.n_chars - 1, at + remove))
        else:
            leaf, first, start, until, last = 0, 0, 0, 0, -1
        old = []
        for k in range(leaf, until + 1):
            a, b = first if k == leaf else 0, last + 1 if k == until else len(self.chunks[k])
            old += self.chunks[k][a:b]
            if k > leaf:
                del self.chunks[k][a:b], self.tokens[k][a:b]
                self.update(k)
            else:
                place = slice(a, b)
        text = "".join(old)
        text = text[: at - start] + put + text[at - start + remove :]
        chunks = CHUNK.findall(text)
        self.encoded += len(text)
        self.chunks[leaf][place] = chunks
        self.tokens[leaf][place] = [chunk_tokens(self.tool, c) for c in chunks]
        self.update(leaf)

    def text(self) -> str:
        return "".join(c for own in self.chunks for c in own)


def count_edited(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", edits_col: str = "edits", to: str = "count") -> DataFrame:
    """Adds ``to``: tokens before and after the edits, the number of edits, and the characters encoded again for them."""

    @F.arrow_udf(FOUND)
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with encoder(vocabulary) as tool:
            for texts, edits in batches:
                rows = []
                for some in portions(texts):
                    for chunks, tokens in counted(tool, [t or "" for t in some]):
                        own = CountedText(tool, chunks, tokens)
                        before, todo = own.n_tokens, edits[len(rows)].as_py() or []
                        for e in todo:
                            own.edit(e["at"] or 0, e["remove"] or 0, e["put"] or "")
                        rows.append({"n_before": before, "n_after": own.n_tokens, "n_edits": len(todo), "n_encoded": own.encoded})
                yield pa.array(rows, FOUND_ARROW)

    return docs.withColumn(to, count(F.col(text_col), F.col(edits_col)))


#: What the edits below mask: e-mail addresses, and runs of four digits or more.
MASKED = re.compile(r"(?P<mail>[\w.+-]+@[\w-]+\.[\w.-]+)|[0-9]{4,}")
#: The same where the text has no @: there the search for an address would read every word from each of its places.
UNADDRESSED = re.compile(r"(?P<mail>(?!))|[0-9]{4,}")


def masking(text_col: str, source_col: str) -> Column:
    """Edits that mask addresses and long numbers, last one first, and put the source on a line at the top."""

    @F.arrow_udf(EDITS)
    def edits(texts: pa.Array, sources: pa.Array) -> pa.Array:
        rows = []
        for given, source in zip(texts, sources, strict=True):
            text = given.as_py() or ""
            masked = (MASKED if "@" in text else UNADDRESSED).finditer(text)
            found = [{"at": m.start(), "remove": m.end() - m.start(), "put": "[MAIL]" if m["mail"] else "[NUMBER]"} for m in masked]
            rows.append([*reversed(found), {"at": 0, "remove": 0, "put": f"Source: {source.as_py() or 'unknown'}\n"}])
        return pa.array(rows, EDITS_ARROW)

    return edits(F.col(text_col), F.col(source_col).cast("string"))


def op4_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after it is masked and given a line with its source."""
    docs = documents(spark, sf_dir).select("doc_id", "text", masking("text", "source").alias("edits"))
    return count_edited(docs, default_vocabulary()).select("doc_id", "count.*")


QUERIES = {"op4_edited_token_counts": op4_edited_token_counts}
ORACLES: dict[str, str] = {}
