"""Language by compression with one dictionary per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.llm.common import release

UNKNOWN = "und"
# Bounds of the sample the dictionaries are made of.
SAMPLE_DOCS = 600
DICT_BYTES = 512 * 1024
MAX_LANGUAGES = 512
# A text is compressed in blocks of this many bytes, so that the dictionary matters in all of it.
BLOCK = 8192
LEVEL = 6
MIN_MARGIN = 0.001


def fit(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES,
) -> dict[str, bytes]:
    """Raw-content dictionaries of all languages of the training rows.

    A language's dictionary is the start of its ``sample_docs`` texts of smallest key hash, in
    equal parts, ``dict_bytes`` in all. Only these bounded parts reach the driver. Null texts and
    languages are left out; more than ``MAX_LANGUAGES`` languages are an error.
    """
    part = F.substring(F.col(text), 1, dict_bytes)
    known = docs.filter(train & F.col(text).isNotNull() & (F.length(text) > 0) & F.col(lang).isNotNull())
    known = known.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("h"), F.col(key).alias("k"))
    counts = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Of a frequent language only about four times the wanted rows, those of small hash, are ranked.
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, 4 * sample_docs / r["count"])) for r in counts], "lang string, share double"
    )
    low = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) <= F.col("share")
    by_hash = F.shiftrightunsigned("h", 11)
    w = Window.partitionBy("lang").orderBy(by_hash, "k")
    chosen = known.join(F.broadcast(shares), "lang").filter(low)
    chosen = chosen.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= sample_docs)
    ids = chosen.select(F.col("k").alias(key), F.col("lang").alias("_lang"), "i").distinct()
    texts = docs.select(key, part.alias("part")).join(F.broadcast(ids), key).select("_lang", "i", F.substring("part", 1, dict_bytes // 8).alias("part"))
    found: dict[str, dict[int, str]] = {}
    for row in texts.collect():
        if row["part"]:
            found.setdefault(row["_lang"], {})[row["i"]] = row["part"]
    out = {}
    for name in sorted(found):
        parts = [found[name][i].lower().encode() for i in sorted(found[name])]
        # Long texts give way to short ones until all fit.
        share, left = {}, dict_bytes
        for n, i in enumerate(sorted(range(len(parts)), key=lambda i: len(parts[i]))):
            share[i] = min(len(parts[i]), left // (len(parts) - n))
            left -= share[i]
        content = b"\n".join(parts[i][: share[i]] for i in range(len(parts)))
        # The library takes dictionaries of eight bytes and more.
        out[name] = content.ljust(8, b" ")
    return out


def _compressors(dictionaries: dict[str, bytes], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name, content in dictionaries.items():
        params = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=len(content), source_size=BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def _verdict(text: str | None, compressors: list) -> tuple[str, float, float]:
    """Language, score and margin of one text."""
    if not compressors or not text or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0
    raw = text.lower().encode()
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), i) for i, (_, c) in enumerate(compressors))
    best, which = sizes[0]
    margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
    return compressors[which][0], 1 / (1 + math.exp(-min(40.0 * margin, 40.0))), margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN, level: int = LEVEL
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin`` and ``rejected``.

    The whole text in lower case is compressed with the dictionary of each language, in blocks; the language of
    the smallest sum wins, ties go to the first by code point. ``margin`` is by how much the
    winner is smaller than the next, relative to the next; ``rejected`` marks margins below
    ``min_margin`` and texts without a language. ``score`` is a logistic of the margin, 0.5 to 1. Texts that are null or have no
    letter are ``und`` with score 0, as is every text if no language was learned. Columns named like the added ones
    are replaced. Rows keep their order within partitions; nothing is shuffled.
    """
    added = ("lang_pred", "score", "margin", "rejected")
    docs = docs.drop(*added)
    content = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = _compressors(content.value, level)
        for texts in batches:
            found = [_verdict(t.as_py(), compressors) for t in texts]
            yield pa.array(
                [{"lang_pred": a, "score": b, "margin": c} for a, b, c in found],
                pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())]),
            )
        release()

    guess = F.arrow_udf(run, "lang_pred string, score double, margin double")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), guess(F.col(text).cast("string")).alias("guess")).select(
        "row.*",
        *[F.col(f"guess.{c}").alias(c) for c in added[:3]],
        (F.col("guess.margin") < F.lit(float(min_margin))).alias("rejected"),
    )
