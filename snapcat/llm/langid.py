"""Language by compression: the language whose text helps most to compress a document.

For every language a raw-content zstandard dictionary is made of a bounded sample of labelled texts: of
the distinct texts those with the ``SAMPLE`` smallest hashes, and of each of these the ``CUT`` characters from a place that
its hash tells. A document, reduced to lower-case letters, is compressed with each dictionary in blocks of ``BLOCK`` bytes, so that the
dictionary stays what counts in a long text. The smallest sum wins; a document whose runner-up is less
than ``LEAST_MARGIN`` larger is rejected. Texts too short to compress are repeated, which every dictionary
then sees.

The model has at most ``PIECES`` pieces of ``CUT`` characters, ``SAMPLE`` a language at most and one at least: with more labels
than ``PIECES`` / ``SAMPLE`` each has fewer.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every
text if nothing is labelled. With one language all texts with a letter are of it, score 1. Ties go to the
language with more labelled texts, then by name. Labels may be any string; null labels teach nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapcat.llm.common import documents
from snapcat.session import settle

SAMPLE, CUT, PIECES, SHARES = 64, 1000, 1 << 17, 32
BLOCK, SHORT, REPEATS = 4096, 256, 3
#: By how much, of its own size, the runner-up must be larger.
LEAST_MARGIN = 0.005
#: Scale of the score: a runner-up larger by this share is e times less likely.
SCALE = 0.02
UNKNOWN = "und"

#: ASCII letters in lower case and all other characters stay, the rest of ASCII turns to spaces.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
FOUND = "struct<lang:string,score:double,margin:double,rejected:boolean>"
FOUND_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])


def letters(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" "


def sample(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, n, hash, text): for each language its number of distinct texts and a piece of some of them."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    distinct = labelled.groupBy("lang", "hash").agg(F.lit(1).alias("one"))
    counts = settle(distinct.groupBy("lang").agg(F.count("*").alias("n")))
    size = max(1, min(SAMPLE, PIECES // max(1, counts.count())))
    # The smallest hashes of each share of a language's texts, then of the language.
    lowest = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).where(F.col("rank") <= size)
    shares = distinct.select("lang", "hash", F.pmod("hash", F.lit(SHARES)).alias("share"))
    some = lowest(lowest(shares, "lang", "share"), "lang").select("lang", "hash")
    # A piece at a place that depends on the text; the beginnings of many texts may be alike.
    length = F.length("text")
    first = F.pmod(F.xxhash64("hash"), F.greatest(length - CUT + 1, F.lit(1))).cast("int") + 1
    # At most PIECES rows of two short values, or one a label.
    texts = labelled.join(F.broadcast(some), ["lang", "hash"], "left_semi").select("lang", "hash", F.substring("text", first, F.lit(CUT)).alias("text"))
    return texts.dropDuplicates(["lang", "hash"]).join(counts, "lang")


class Model:
    """Dictionaries by language, the one with most labelled texts first."""

    def __init__(self, rows: list):
        texts, counts = defaultdict(list), {}
        for r in rows:
            texts[r.lang].append((r.hash, r.text))
            counts[r.lang] = r.n
        order = sorted(counts, key=lambda lang: (-counts[lang], lang))
        self.contents = {lang: b"".join(letters(t) for _, t in sorted(texts[lang])) for lang in order}
        self.digest = hashlib.sha256(repr(self.contents).encode()).hexdigest()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the labelled rows of ``docs``; only the text and the label are read."""
    return Model(sample(docs, text_col, lang_col).collect())


COMPRESSORS: dict[str, dict[str, zstandard.ZstdCompressor]] = {}


def compressors(model: Model) -> dict[str, zstandard.ZstdCompressor]:
    """This worker's compressors, kept between its tasks."""
    if model.digest not in COMPRESSORS:
        COMPRESSORS.clear()
        settings = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, chain_log=16, hash_log=17, search_log=3, min_match=4, target_length=16,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        made = COMPRESSORS[model.digest] = {}
        for lang, content in model.contents.items():
            # Content of fewer than eight bytes is no dictionary.
            dictionary = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            made[lang] = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)
    return COMPRESSORS[model.digest]


def classify(text: str | None, tools: dict[str, zstandard.ZstdCompressor]) -> dict:
    if text is None or not tools or not any(map(str.isalpha, text)):
        return {"lang": UNKNOWN, "score": 0.0, "margin": 0.0, "rejected": True}
    raw = letters(text)
    if len(raw) < SHORT:
        raw *= REPEATS
    blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
    sizes = {lang: sum(len(tool.compress(b)) for b in blocks) for lang, tool in tools.items()}
    best = min(sizes, key=sizes.__getitem__)
    least = sizes[best]
    margin = min((size / least - 1 for lang, size in sizes.items() if lang != best), default=math.inf)
    score = 1 / sum(math.exp((least - size) / least / SCALE) for size in sizes.values())
    return {"lang": best, "score": score, "margin": margin, "rejected": margin < LEAST_MARGIN}


def identify(docs: DataFrame, model: Model, text_col: str = "text", to: str = "language") -> DataFrame:
    """Adds ``to``: language, score (0 to 1), margin of the runner-up and whether that is too narrow."""

    @F.arrow_udf(FOUND)
    def language(texts: pa.Array) -> pa.Array:
        tools = compressors(model)
        return pa.array([classify(t.as_py(), tools) for t in texts], FOUND_ARROW)

    return docs.withColumn(to, language(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learnt from: those whose id has the remainder 2; a null id has none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"))


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
