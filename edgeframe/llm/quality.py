"""Quality rules with compression bands.

Besides word-level rules, a document's zstandard ratio (bytes before / bytes
after) must lie in a band that depends on its length: short texts hardly
compress and long natural texts land between 2 and 4, so too high a ratio
means repetition and too low a one means noise.  Fixed chunks of the text are
held against bands too, the rest after the last whole chunk by the limits of
its own length, so that a bad stretch of a long document counts; a document
goes when more than half of its chunks are outside.

Base64 of random bytes has ratios up to 1.25 below 1,000 bytes, 1.31 at 3,000
and 1.33 beyond.  The prose of the test tables has at least 1.42 between 400 and
2,000 bytes, 1.9 up to 10,000 and 2.2 beyond; scripts of three bytes a character
have somewhat less.  The lower limits stand between, nearer to the noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.llm import textops
from edgeframe.llm.shared import named, others, quoted, small_batches

#: Length limits: (bytes below which the band holds, least ratio, greatest ratio).
BANDS = ((100, 0.0, 3.0), (400, 0.75, 4.0), (2000, 1.2, 6.0), (10_000, 1.4, 8.0), (float("inf"), 1.5, 10.0))
CHUNK, CHUNK_SHARE = 4096, 0.5
LEVEL = 3

LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\r\x0b\x0c"


def band(size: int) -> tuple[float, float]:
    """The least and greatest whole-document ratio for a text of ``size`` bytes."""
    return next((lo, hi) for below, lo, hi in BANDS if size < below)


def _outside(size: int, ratio: float) -> bool:
    lo, hi = band(size)
    return not lo <= ratio <= hi


def _ratios(compressor, data: bytes) -> tuple[float, float]:
    """Whole-document ratio and the share of chunks outside their bands."""
    if not data:
        return 1.0, 0.0
    whole = len(data) / len(compressor.compress(data))
    if len(data) <= CHUNK:
        return whole, float(_outside(len(data), whole))
    cuts = range(0, len(data), CHUNK)
    bad = sum(_outside(len(part), len(part) / len(compressor.compress(part))) for part in (data[i : i + CHUNK] for i in cuts))
    return whole, bad / len(cuts)


def _repeated(words: textops.Words) -> np.ndarray:
    """For each row, the words in windows that occur twice or more in it."""
    grams, valid = words.grams(words.hashes(), WINDOW)
    at = np.flatnonzero(valid)
    order = at[np.lexsort((grams[at], words.doc[at]))]
    fresh = textops.changes(words.doc[order], grams[order])
    group = np.cumsum(fresh) - 1
    again = order[np.bincount(group)[group] > 1] if len(order) else order
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return total[words.first[1:]] - total[words.first[:-1]]


def _duplicate_lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return again


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``zstd_ratio``, ``bad_chunks``, ``base_failed``, ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in
    8-word windows that the text has twice.  ``kept`` is false if that holds
    or the ratios leave their bands.

    Null and empty texts have no words, so they fail.  Every other column is
    passed on as it is; columns named like the new ones are replaced.
    Repeated rows are judged alike.  An empty table gives an empty result.
    """
    new = (*COUNTS, "zstd_ratio", "bad_chunks")
    keep = [T.StructField(c, docs.select(quoted(c)).schema[0].dataType) for c in others(docs, *new, "base_failed", "kept")]
    small_batches(docs.sparkSession)
    place = [f.name.lower() for f in keep].index(text_col.lower())
    text = f"c{place}"
    rest = docs.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(keep)))
    out = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)), *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in new[-2:])])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        for batch in batches:
            for part in textops.slices(batch, text):
                array = textops.as_arrow(part.column(text))
                words = textops.Words(array)
                lead = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
                chars = np.concatenate([[0], np.cumsum(lead[words.end] - lead[words.start])])
                symbols = np.concatenate([[0], np.cumsum(np.isin(words.raw, np.frombuffer(SYMBOLS, np.uint8)))])
                texts = [words.raw[a:b].tobytes() for a, b in zip(words.off[:-1], words.off[1:], strict=True)]
                ratios = np.array([_ratios(compressor, t) for t in texts], dtype=float).reshape(-1, 2)
                counts = [
                    np.diff(words.first),
                    chars[words.first[1:]] - chars[words.first[:-1]],
                    symbols[words.off[1:]] - symbols[words.off[:-1]],
                    np.array([_duplicate_lines(t.decode()) if b"\n" in t else 0 for t in texts], np.int64),
                    _repeated(words),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c.astype(np.int64)) for c in counts), *(pa.array(c) for c in ratios.T)], out.fieldNames())

    found = rest.mapInArrow(rows, out)
    size, ratio = F.coalesce(F.octet_length(text), F.lit(0)), F.col("zstd_ratio")
    outside = F.lit(False)
    for below, lo, hi in reversed(BANDS):
        here = ~ratio.between(lo, hi)
        outside = here if below == float("inf") else F.when(size < below, here).otherwise(outside)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return named(found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~outside & (F.col("bad_chunks") <= CHUNK_SHARE)), keep)


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query over whole ``documents``."""
    report = quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return report.select("doc_id", *COUNTS, "base_failed", "kept", "zstd_ratio", "bad_chunks")
