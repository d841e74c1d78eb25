"""Substring dedup: cut word windows that already stand in an earlier document.

Every window of ``width`` consecutive words gets a Rabin-Karp hash.  Spark
counts them - the smallest and the largest document of each hash - and a
window goes where a smaller document holds it too; the covered words merge
into maximal intervals.

Sending all hashes through a shuffle would cost several times the text, so an
exact sieve comes first.  A window's *anchor* is the smallest hash among its
``anchor``-word grams: equal windows have equal anchors, and neighbouring
windows mostly share one, so a document has about ``2 / (width - anchor + 2)``
anchors a word.  Windows whose anchor stands in one document only cannot
repeat and are never shuffled.  All counting is ``min``/``max`` per hash with
map-side combining, and joins back to the documents are plain equi-joins whose
hot keys Spark can split, so a passage in a third of all documents is no
bottleneck.  Two different windows are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.llm import textops
from edgeframe.llm.shared import stored

WIDTH, ANCHOR = 50, 10

Batches = Iterator[pa.RecordBatch]


def _anchored(words: textops.Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hash, anchor and validity for each word as a start."""
    hashes = words.hashes()
    windows, valid = words.grams(hashes, width)
    grams, _ = words.grams(hashes, anchor)
    return windows, textops.sliding_min(grams, width - anchor + 1), valid


def _anchor_rows(width: int, anchor: int) -> Callable[[Batches], Batches]:
    def rows(batches: Batches) -> Batches:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                words = textops.Words(textops.as_arrow(part.column("text")))
                _, low, valid = _anchored(words, width, anchor)
                at = np.flatnonzero(valid)
                at = at[textops.changes(words.doc[at], low[at])]
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(words.doc[at])), pa.array(textops.signed(low[at]))], ["doc", "anchor"])

    return rows


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return np.asarray(column.flatten()).astype(np.int64), np.repeat(np.arange(len(column)), counts)


def _member(rows: np.ndarray, values: np.ndarray, set_rows: np.ndarray, set_values: np.ndarray) -> np.ndarray:
    """Whether each (row, value) is in the set of pairs."""
    if not len(set_values):
        return np.zeros(len(values), dtype=bool)
    order = np.lexsort((set_values, set_rows))
    keys = np.empty(len(order), dtype=[("r", np.int64), ("v", np.int64)])
    keys["r"], keys["v"] = set_rows[order], set_values[order]
    # ranks of values keep the search on plain integers
    ranks = np.unique(set_values)
    at = np.minimum(np.searchsorted(ranks, values), len(ranks) - 1)
    known = ranks[at] == values
    packed = keys["r"] * len(ranks) + np.searchsorted(ranks, keys["v"])
    want = rows.astype(np.int64) * len(ranks) + at
    place = np.minimum(np.searchsorted(packed, want), len(packed) - 1)
    return known & (packed[place] == want)


def _window_rows(width: int, anchor: int) -> Callable[[Batches], Batches]:
    def rows(batches: Batches) -> Batches:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                words = textops.Words(textops.as_arrow(part.column("text")))
                windows, low, valid = _anchored(words, width, anchor)
                at = np.flatnonzero(valid)
                values, owner = _flat(part.column("anchors"))
                at = at[_member(words.doc[at], textops.signed(low[at]), owner, values)]
                found = textops.signed(windows[at])
                order = np.lexsort((found, words.doc[at]))
                at, found = at[order], found[order]
                keep = textops.changes(words.doc[at], found)
                at, found = at[keep], found[keep]
                values, owner = _flat(part.column("later"))
                late = _member(words.doc[at], textops.signed(low[at]), owner, values)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(words.doc[at])), pa.array(found), pa.array(late)], ["doc", "window", "later"])

    return rows


def _cut_rows(width: int, spans: pa.DataType) -> Callable[[Batches], Batches]:
    def rows(batches: Batches) -> Batches:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                words = textops.Words(textops.as_arrow(part.column("text")))
                values, owner = _flat(part.column("windows"))
                covered = np.zeros(len(words) + 1, np.int64)
                if len(values):
                    windows, valid = words.grams(words.hashes(), width)
                    at = np.flatnonzero(valid)
                    at = at[_member(words.doc[at], textops.signed(windows[at]), owner, values)]
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + width, -1)
                gone = np.cumsum(covered)[:-1] > 0
                raw, kept, found = words.raw.tobytes(), [], []
                count = np.concatenate([[0], np.cumsum(gone)])
                for r in range(words.rows):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    text = raw[words.off[r] : words.off[r + 1]].split()
                    if count[b] > count[a]:
                        lost = gone[a:b]
                        flips = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
                        found.append([{"start": int(s), "end": int(e)} for s, e in zip(flips[::2], flips[1::2], strict=True)])
                        text = [w for w, x in zip(text, lost.tolist(), strict=True) if not x]
                    else:
                        found.append([])
                    kept.append(b" ".join(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(np.diff(words.first).astype(np.int64)), pa.array((count[words.first[1:]] - count[words.first[:-1]]).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(found, spans)],
                    ["doc", "n_words", "n_removed", "kept_text", "removed"],
                )

    return rows


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_text``, ``removed``.

    ``removed`` lists the maximal intervals of removed words (end exclusive),
    ``kept_text`` the other words joined by single spaces.  A window is removed
    when its word sequence also starts in a document with a smaller id; all
    windows are judged on the input.

    Null or empty texts have no words and come back empty; texts shorter than
    ``width`` lose nothing; rows whose id is null have no place in the order,
    so they lose nothing and take nothing from others; repeated rows (equal
    ids) are treated alike, as neither id is smaller.  Other columns are not
    read.  An empty table gives an empty result.
    """
    if not 1 <= anchor <= width:
        raise ValueError("the anchor must fit into the window")
    # an alias of a column to its own name would hide from Spark that both joins below shuffle the same texts
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col) if text_col == "text" else F.col(text_col).alias("text"))
    kind = docs.schema["doc"].dataType
    whole = docs.filter(F.col("doc").isNotNull())

    anchors = stored(whole.filter(F.length("text") >= 2 * width - 1).mapInArrow(_anchor_rows(width, anchor), T.StructType([T.StructField("doc", kind), T.StructField("anchor", T.LongType())])), "op1-anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("anchor", "lo")
    # a window can only go where its anchor stands in a smaller document
    later = F.when(F.col("doc") > F.col("lo"), F.col("anchor"))
    per_doc = anchors.join(shared, "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(later).alias("later"))

    pairs = T.StructType([T.StructField("doc", kind), T.StructField("window", T.LongType()), T.StructField("later", T.BooleanType())])
    windows = whole.join(per_doc, "doc").select("doc", "text", "anchors", "later").mapInArrow(_window_rows(width, anchor), pairs)
    first = windows.groupBy("window").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("window", "lo")
    gone = windows.filter("later").drop("later").join(first, "window").filter("doc > lo").groupBy("doc").agg(F.collect_set("window").alias("windows"))

    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = T.StructType([T.StructField("doc", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", spans)])
    cut = _cut_rows(width, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    judged = whole.join(gone, "doc", "left").select("doc", "text", "windows")
    nameless = docs.filter(F.col("doc").isNull()).withColumn("windows", F.lit(None).cast("array<long>"))
    return judged.unionByName(nameless).mapInArrow(cut, out).withColumnRenamed("doc", id_col)


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of what :func:`remove_repeated_windows` keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS lo FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM s JOIN m USING (g) WHERE doc_id > lo),
k AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(js, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
