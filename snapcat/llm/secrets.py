"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``LEAST`` characters that keys, tokens and digests are spelled with, less a name and
'=' before it; or a value of any length and any characters that is assigned to a credential's name, in quotes or up to
white space; or the password, or else the user, of a URL. Of values inside each other the inner one is taken. Its
features are its length, the transitions between kinds of characters, how much of it dictionary words cover
(the most frequent words of all documents), its path, and the words beside it. The forest is trained on
labelled findings, a bounded sample of them: for each label those with the ``SAMPLE`` smallest hashes.

``label_findings`` labels what plain rules are sure of: a value of letters and digits that is assigned to a
credential's name is a secret; words (letters that rarely change case), numbers and placeholders are none.
All other candidates are what the forest is for. Other labels can be given instead.

Defined results: null and empty texts have no candidates; null paths are empty. Without labelled findings
nothing is a secret; if all have one label, every candidate gets it. Equal rows get equal findings.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm.common import documents, row_key
from snapcat.session import settle

LEAST = 16
#: Labelled findings of each label that train the forest; words of the dictionary; trees and their depth.
SAMPLE, DICTIONARY, TREES, DEPTH = 5000, 5000, 20, 6
SEED = 7
#: A candidate is a secret from this probability on.
SURE = 0.5
MASK = "[SECRET]"

CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=\-]{{{LEAST},}}")
#: What may end a name that a value is assigned to; the name before it; credentials in URLs, and the text before a password there.
SEPARATOR = re.compile(r":=|=>|={1,3}|:(?!//)")
NAME = re.compile(r"([A-Za-z_][\w.-]*)[\"'`]?\s*$")
USERINFO = re.compile(r"://([^\s/@:\"'`<>]*:)?([^\s/\"'`<>]+)@")
PASSWORD_NEXT = re.compile(r"://[^\s/@:]*:$")
#: What an unquoted value ends before, and what does not belong to it at its end.
SPACE, PARAMETER, CLOSING = re.compile(r"\s"), re.compile(r"&[\w.-]+="), ",;:.)]}>\"'`"
#: Names of credentials, words of placeholders, parts of paths that hold no real ones.
CREDENTIAL = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "bearer", "credential", "access", "private")
#: Those that other words contain ("author", "monkey") and that count as whole words only.
SHORT = ("api", "key", "auth", "bearer", "access", "private")
PLACEHOLDER = ("example", "sample", "test", "dummy", "your", "placeholder", "changeme", "xxxx")
KINDS = "uld+"
ASSIGNED = re.compile(r"([A-Za-z_][\w.-]*)[\"'`]?\s*(?::=|=>|={1,3}|:)\s*[\"'`]?$")
WORDS = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Characters before and after a candidate in which neighbours are looked for.
BESIDE = 48
FEATURES = ["length", "upper", "lower", "digit", "other", *(f"{a}{b}" for a in KINDS for b in KINDS), "hex", "entropy", "covered", "assigned", "quoted", "credential", "credential_near", "placeholder", "path_depth", "path_test"]

FINDING = "array<struct<first:int,length:int,value:string,name:string,features:array<double>>>"
FINDING_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32()), ("value", pa.string()), ("name", pa.string()), ("features", pa.list_(pa.float64()))]))


def kind(c: str) -> int:
    return 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 3


def words_in(text: str) -> set[str]:
    """Runs of letters, and the words in them where the case tells."""
    return {w.lower() for w in (*WORDS.findall(text), *PARTS.findall(text))}


def names_credential(name: str) -> bool:
    own = words_in(name)
    return any(c in own if c in SHORT else c in name.lower() for c in CREDENTIAL)


def is_placeholder(words: set[str]) -> bool:
    return any(w in PLACEHOLDER or len(w) >= 4 and set(w) == {"x"} for w in words)


def escaped(text: str, first: int, at: int) -> bool:
    """Whether an odd number of backslashes stands before a place. Only they are looked at."""
    k = at
    while k > first and text[k - 1] == "\\":
        k -= 1
    return (at - k) % 2 == 1


def assigned_values(text: str) -> list[tuple[int, int]]:
    """Places (first, end) of the values assigned to credentials' names. Time is linear: ends are looked for once."""
    ends: dict[str, int] = {}

    def following(what: str, find, at: int) -> int:
        if ends.get(what, -1) < at:
            found = find(at)
            ends[what] = found if found >= 0 else len(text)
        return ends[what]

    def first(pattern: re.Pattern):
        return lambda at: m.start() if (m := pattern.search(text, at)) else -1

    out = []
    for m in SEPARATOR.finditer(text):
        name = NAME.search(text[max(0, m.start() - BESIDE) : m.start()])
        if not name or not names_credential(name[1]):
            continue
        a = m.end()
        while text[a : a + 1] in (" ", "\t"):
            a += 1
        if (quote := text[a : a + 1]) in ("'", '"', "`"):
            a += 1
            b = following(quote, lambda at, q=quote: text.find(q, at), a)
            while b < len(text) and escaped(text, a, b):
                b = following(quote, lambda at, q=quote: text.find(q, at), b + 1)
            if b < len(text) and b <= following("line", lambda at: text.find("\n", at), a):
                if b > a:
                    out.append((a, b))
                continue
        b = min(following("space", first(SPACE), a), following("parameter", first(PARAMETER), a))
        while b > a and text[b - 1] in CLOSING:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def places(text: str) -> list[tuple[int, int]]:
    """Places (first, end) of all candidates, in order; none overlaps another."""
    sure: list[tuple[int, int]] = []
    for own in sorted({*assigned_values(text), *(m.span(2) for m in USERINFO.finditer(text))}):
        while sure and sure[-1][1] > own[0]:
            sure.pop()
        sure.append(own)
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # '=' inside a run ends a name; at its end it is part of the value.
        cut = text.rfind("=", a, a + len(m[0].rstrip("=")))
        a = max(a, cut + 1)
        while k < len(sure) and sure[k][1] <= a:
            k += 1
        if b - a >= LEAST and (k == len(sure) or sure[k][0] >= b):
            out.append((a, b))
    return sorted(out + sure)


def covered(value: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words of three letters or more cover, longest first from each place."""
    value, i, hit = value.lower(), 0, 0
    while i < len(value):
        n = next((n for n in range(min(12, len(value) - i), 2, -1) if value[i : i + n] in words), 0)
        hit += n
        i += n or 1
    return hit / len(value)


def describe(value: str, before: str, after: str, path: str, words: frozenset[str]) -> tuple[str, list[float]]:
    """The name that the value is assigned to (or ""), and its features."""
    kinds = [kind(c) for c in value]
    pairs = [0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        pairs[4 * a + b] += 1
    n = len(value)
    found = ASSIGNED.search(before)
    name = found[1] if found else ""
    near = [w.lower() for w in WORDS.findall(before)[-4:] + WORDS.findall(after)[:2]]
    counts = [value.count(c) / n for c in set(value)]
    features = [
        n, *(kinds.count(k) / n for k in range(4)), *(p / max(1, n - 1) for p in pairs),
        sum(c in "0123456789abcdefABCDEF" for c in value) / n, -sum(p * math.log2(p) for p in counts), covered(value, words),
        bool(name), before[-1:] in ("'", '"', "`") and after[:1] == before[-1:],
        names_credential(name) or bool(PASSWORD_NEXT.search(before)), any(w in CREDENTIAL for w in near),
        is_placeholder({*near, *words_in(value)}),
        path.count("/"), is_placeholder(words_in(path)),
    ]
    return name, [float(f) for f in features]


def dictionary(docs: DataFrame, text_col: str, size: int = DICTIONARY) -> frozenset[str]:
    """The most frequent words of 3 to 12 letters in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(3, 12))
    return frozenset(r.word for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).collect())


def candidates(docs: DataFrame, words: frozenset[str], text_col: str = "text", path_col: str | None = "source", to: str = "candidates") -> DataFrame:
    """Adds ``to``: place and length in code points, value, name it is assigned to and features of every candidate."""

    @F.arrow_udf(FINDING)
    def find(texts: pa.Array, paths: pa.Array) -> pa.Array:
        rows = []
        for text, path in zip(texts, paths, strict=True):
            text, path, own = text.as_py() or "", path.as_py() or "", []
            for a, b in places(text):
                name, features = describe(text[a:b], text[max(0, a - BESIDE) : a], text[b : b + BESIDE], path, words)
                own.append({"first": a, "length": b - a, "value": text[a:b], "name": name, "features": features})
            rows.append(own)
        return pa.array(rows, FINDING_ARROW)

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    # So that the findings are not looked for a second time to pass over rows without any.
    return docs.withColumn(to, find.asNondeterministic()(F.col(text_col), path))


def label_findings(found: DataFrame) -> DataFrame:
    """Findings (value, name, features) that plain rules are sure of, with ``label`` 1 or 0."""
    at = {name: F.col("features")[k] for k, name in enumerate(FEATURES)}
    mixed = (at["digit"] > 0) & (at["upper"] + at["lower"] > 0)
    secret = (at["credential"] == 1) & mixed & (at["entropy"] >= 3) & (at["placeholder"] == 0)
    words = (at["digit"] == 0) & (at["lu"] + at["ul"] <= 0.1)
    label = F.when(secret, 1).when(words | (at["digit"] + at["other"] == 1) | (at["placeholder"] == 1), 0)
    sure = found.withColumn("label", label.cast("double")).where(F.col("label").isNotNull())
    # Secrets stand in the sample a second time without what the rule knew them by, so that the forest learns the rest too.
    known_by = [FEATURES.index(c) for c in ("assigned", "quoted", "credential", "credential_near")]
    bare = F.transform("features", lambda x, i: F.when(i.isin(known_by), 0.0).otherwise(x))
    return sure.select("value", "features", "label").unionByName(sure.where("label = 1").select("value", bare.alias("features"), "label"))


def train(labelled: DataFrame) -> RandomForestClassificationModel | float:
    """A forest from labelled findings (value, features, label); a number if they do not have two labels."""
    distinct = labelled.groupBy("label", "value", "features").agg(F.xxhash64("value").alias("hash"))
    # The smallest of every task, then of those: no task holds all findings of a label.
    some = [distinct.where(F.col("label") == label).orderBy("hash", "value", "features").limit(SAMPLE) for label in (0, 1)]
    # At most 2 * SAMPLE rows: one task, in a fixed order, gives the same forest on any cluster.
    sample = some[0].unionByName(some[1]).select("label", "hash", "value", "features").coalesce(1).sortWithinPartitions("label", "hash", "value", "features")
    sample = settle(sample.select("label", array_to_vector("features").alias("vector")))
    labels = [r.label for r in sample.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", probabilityCol="chance", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(sample)


class Trees:
    """The trees of a forest as arrays: a task judges the features of its texts by itself."""

    def __init__(self, forest: RandomForestClassificationModel | float):
        self.constant = forest if isinstance(forest, float) else None
        if self.constant is not None:
            return
        size = max(tree.numNodes for tree in forest.trees)
        shape = (len(forest.trees), size)
        # A leaf leads to itself.
        self.left = np.tile(np.arange(size), (shape[0], 1))
        self.right = self.left.copy()
        self.feature, self.limit, self.chance = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
        for t, tree in enumerate(forest.trees):
            upcoming = [(tree._call_java("rootNode"), 0)]
            used = 1
            while upcoming:
                node, at = upcoming.pop()
                if node.getClass().getSimpleName() == "LeafNode":
                    counts = list(node.impurityStats().stats())
                    self.chance[t, at] = counts[1] / sum(counts)
                    continue
                self.feature[t, at], self.limit[t, at] = node.split().featureIndex(), node.split().threshold()
                self.left[t, at], self.right[t, at] = used, used + 1
                upcoming += [(node.leftChild(), used), (node.rightChild(), used + 1)]
                used += 2

    def scores(self, features: np.ndarray) -> np.ndarray:
        """The mean chance of the leaves that each row comes to."""
        if self.constant is not None:
            return np.full(len(features), self.constant)
        total = np.zeros(len(features))
        for left, right, feature, limit, chance in zip(self.left, self.right, self.feature, self.limit, self.chance, strict=True):
            at = np.zeros(len(features), np.int64)
            for _ in range(DEPTH):
                lower = features[np.arange(len(features)), feature[at]] <= limit[at]
                at = np.where(lower, left[at], right[at])
            total += chance[at]
        return total / len(self.left)


def judge(found: DataFrame, forest: RandomForestClassificationModel | float) -> DataFrame:
    """Adds ``score`` and ``is_secret`` to findings with features."""
    if isinstance(forest, float):
        scored = found.withColumn("score", F.lit(forest))
    else:
        scored = forest.transform(found.withColumn("vector", array_to_vector("features"))).withColumn("score", vector_to_array("chance")[1])
    return scored.withColumn("is_secret", F.col("score") >= SURE)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, row_key_1, row_key_2, first, length, value, name, score and is_secret of every candidate of every row."""
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"), *row_key(id_col, text_col))
    own = candidates(keyed, dictionary(keyed, "text"), "text", "path")
    found = settle(own.select("doc_id", "row_key_1", "row_key_2", F.inline("candidates")))
    return judge(found, train(label_findings(found) if labelled is None else labelled)).select(
        "doc_id", "row_key_1", "row_key_2", "first", "length", "value", "name", "score", "is_secret")


def masked(text: str, path: str, words: frozenset[str], trees: Trees, mask: str) -> str:
    """A text with its secrets replaced by the mask."""
    spans = places(text)
    if not spans:
        return text
    features = [describe(text[a:b], text[max(0, a - BESIDE) : a], text[b : b + BESIDE], path, words)[1] for a, b in spans]
    kept, done = [], 0
    for (a, b), score in zip(spans, trees.scores(np.array(features)), strict=True):
        if score >= SURE:
            kept += [text[done:a], mask]
            done = b
    return "".join([*kept, text[done:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret replaced by the mask; all rows and columns stay. One pass learns, another one masks: no text is shuffled."""
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    own = docs.select(F.col(text_col).alias("text"), path.alias("path"))
    words = dictionary(own, "text")
    if labelled is None:
        found = candidates(own, words, "text", "path").select(F.inline("candidates")).select("value", "name", "features")
        labelled = label_findings(settle(found))
    trees = Trees(train(labelled))

    @F.arrow_udf("string")
    def clean(texts: pa.Array, paths: pa.Array) -> pa.Array:
        rows = ((t.as_py(), p.as_py() or "") for t, p in zip(texts, paths, strict=True))
        return pa.array([None if t is None else masked(t, p, words, trees, mask) for t, p in rows], pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col), path)).select(*docs.columns)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in any document, with the forest's verdict."""
    return scan(documents(spark, sf_dir)).drop("row_key_1", "row_key_2")


QUERIES = {"op3_secrets": op3_secrets}
ORACLES: dict[str, str] = {}
