"""Near duplicates by bottom-k sketches of word shingles, confirmed exactly.

1. Each text's distinct shingles are hashed by one function; equal sets
   collapse to one, known by its 128-bit digest, and a sketch keeps the ``K``
   smallest hashes.  An id with several texts links their sets.
2. Inverted lists hold, for every run of ``RUN`` neighbouring retained values,
   the sets that have it.  In two sets at the threshold, 85 % of the union's
   smallest hashes are common, and the chance that no three neighbours are is
   below 1e-9 for 48 values; smaller sets are kept whole, where a run is
   certain.  A list is joined to its hub only, so its pairs grow with its
   length, not its square.  The hub is the member whose own lists are longest
   in all: of a group of edited copies the least edited, which most are near to.
3. A pair's union sketch estimates its similarity; far misses go.  The sets of
   the others are written once as sorted hashes and confirmed in full by joins,
   so no pair's texts stand side by side.  Links become components.
4. A list whose members all sit in one component is settled.  In the others
   hubs are chosen once more, by whole sets: the set whose shingles are the most
   frequent ones, as equal sketches hide the edits between their values.
5. The rest is finished by an exact join over the sets in unsettled lists:
   shingles in order of rarity among them, where linked sets share one in a
   short prefix.  Only pairs across components are tested, and hot shingles come
   last in that order.  A set that is too far from the hub of its group has
   enough shingles of its own to keep the group's out of its prefix, so neither
   a large group around one text nor a frequent passage forms pairs.

Nothing about documents is collected on the driver but counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.llm import textops
from edgeframe.llm.shared import dropped, quoted, stored

SHINGLE, PERCENT = 5, 85
K, RUN = 48, 3
#: A pair whose union sketch shares less than this part of the threshold's expectation is dropped (6.8 sigma at K = 48).
SLACK = 0.59
#: A list of ids up to this many rows (some 100 bytes each as a hash table) is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1 << 17


def shingle_sets(array: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, sorted by both.

    A row with fewer than ``width`` words has its whole sequence as one
    shingle, a row without words has none.
    """
    words = textops.Words(array, lower=True)
    hashes, sizes = words.hashes(), np.diff(words.first)
    grams, valid = words.grams(hashes, width)
    at = np.flatnonzero(valid)
    rows, values = [words.doc[at]], [grams[at]]
    for k in range(1, width):
        short = np.flatnonzero(sizes == k)
        rows.append(short)
        values.append(words.grams(hashes, k)[0][words.first[short]])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = textops.changes(row, value)
    return row[new], value[new]


def _digests(value: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's set, null for an empty one."""
    data, ends = value.tobytes(), (8 * np.cumsum(n)).tolist()
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() if b > a else None for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _sketch_rows(width: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                row, value = shingle_sets(textops.as_arrow(part.column("text")), width)
                n = np.bincount(row, minlength=part.num_rows)
                first = np.cumsum(n) - n
                low = np.arange(len(row)) - first[row] < k
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(n.astype(np.int64)), pa.array(_digests(value, n), pa.binary()), textops.lists(textops.signed(value[low]), np.minimum(n, k))],
                    ["doc", "n", "digest", "sketch"],
                )

    return rows


def _set_rows(width: int):
    """One row a text: the digest of its set and the whole set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                row, value = shingle_sets(textops.as_arrow(part.column("text")), width)
                n = np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(_digests(value, n), pa.binary()), textops.lists(textops.signed(value), n)], ["digest", "shingles"])

    return rows


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the smallest node reachable, for the nodes of ``links`` (a, b).

    Alternates large-star and small-star steps until nothing changes; the
    rounds grow with the logarithm of the longest chain.  Roots are listed
    too.  Each round is written to the shared folder, and the round before it
    deleted.

    Links from a node to itself or with a null end count as none; repeated
    links count once; other columns are not read.  Nodes are of any type with
    an order.  No links give an empty result.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before, now = None, mark(edges)
    while now != before and now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # repeated rows change no minimum and go with the last step
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, stored(small.unionByName(down.withColumnRenamed("m", "b")).distinct(), name)
        before, now = now, mark(edges)
        dropped(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _only(rows: DataFrame, ids: DataFrame, on: str = "doc") -> DataFrame:
    """The rows whose ``on`` is among the distinct ``ids``, a written table: its count decides how they are joined."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, "left_semi")


def _full_sets(texts: DataFrame, heads: DataFrame, wanted: DataFrame, width: int, name: str) -> DataFrame:
    """(digest, shingles) of the ``wanted`` digests, written once."""
    ids = stored(wanted.distinct(), f"{name}-ids")
    docs = stored(_only(heads.select("digest", "doc"), ids, "digest").select("doc").distinct(), f"{name}-docs")
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    sets = _only(_only(texts, docs).select("text").mapInArrow(_set_rows(width), schema), ids, "digest")
    # repeated rows have one set
    return stored(sets.groupBy("digest").agg(F.first("shingles").alias("shingles")), name)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The ``pairs`` (a, b, ...) whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("digest").alias(x), F.col("shingles").alias(f"s_{x}"))
    # sets have no repeated hashes, so the common ones tell the union's size
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, (F.size("s_a") + F.size("s_b")).alias("both"), F.size(F.array_intersect("s_a", "s_b")).alias("common"))
    return stored(joined.filter(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select(*pairs.columns), name)


def _likely(a: Column, b: Column, k: int, percent: int) -> Column:
    """Whether the union sketch allows the threshold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return 100 * shared >= SLACK * percent * F.size(union)


def _likely_pairs(pairs: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b, ...) that sizes and union sketches allow."""
    side = lambda x: heads.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & _likely(F.col("s_a"), F.col("s_b"), k, percent)
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(sized).select(*pairs.columns)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Texts with ``100 * |common| >= percent * |union|`` shingles are linked;
    ``component_id`` is the smallest id reachable, ``kept`` marks the row that
    has it.

    A null or empty text has no shingles and is linked with nothing.  Rows
    whose id is null keep their own: ``component_id`` null, ``kept`` true.
    Rows of a repeated id share a component, whatever their texts, with all
    that any of those texts is near to; every row of the smallest id is kept.
    Other columns are not read.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text"))
    kind = docs.schema["doc"].dataType
    texts = docs.filter("doc is not null")
    sketch = T.StructType([T.StructField("doc", kind), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    sketches = stored(docs.mapInArrow(_sketch_rows(width, k), sketch), "op8-sketches")

    sets = sketches.filter("doc is not null and digest is not null")
    heads = stored(sets.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "op8-heads")
    several = sets.groupBy("doc").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("doc", F.col("lo").alias("b"))
    same_id = stored(sets.select("doc", F.col("digest").alias("a")).join(several, "doc").filter("a > b").select("a", "b").distinct(), "op8-same-id")

    runs = F.transform(F.sequence(F.lit(1), F.size("sketch") - RUN + 1), lambda i: F.xxhash64(F.slice("sketch", i, RUN)))
    keys = heads.filter(F.size("sketch") >= RUN).select("digest", F.explode(runs).alias("key"))
    lists = keys.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("top"), F.count("*").alias("size")).filter("low < top")
    hits = stored(keys.join(lists.select("key", "size"), "key"), "op8-hits")

    # one order over all sets, so a group's lists have one hub
    ordered = hits.join(hits.groupBy("digest").agg(F.sum("size").alias("weight")), "digest")
    hubs = ordered.groupBy("key").agg(F.max(F.struct("weight", "digest")).alias("hub")).select("key", F.col("hub.digest").alias("a"))
    estimated = hits.join(hubs, "key").filter("digest <> a").select("a", F.col("digest").alias("b")).distinct()
    likely = stored(_likely_pairs(estimated, heads, k, percent), "op8-pairs")
    full = _full_sets(texts, heads, likely.select(F.explode(F.array("a", "b")).alias("digest")), width, "op8-sets")
    links = _confirmed(likely, full, percent, "op8-links").unionByName(same_id)

    found = components(links, "op8-stars")
    label = F.coalesce(F.col("root"), F.col("digest")).alias("class")
    # a list of two is settled by its one pair
    classed = hits.filter("size > 2").join(found.withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", label)
    open_keys = classed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key")
    unsettled = stored(classed.join(open_keys, "key").select("key", "digest", "class"), "op8-unsettled")
    dropped(hits, full)
    # late links join whole classes, so only classes go through the stars again
    merged = components(_late_links(unsettled, texts, heads, width, percent, k), "op8-late-stars").select(F.col("node").alias("class"), F.col("root").alias("late"))
    classes = heads.select("digest", "doc").join(found.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "doc", label)
    classes = classes.join(merged, "class", "left").select("digest", "doc", F.coalesce("late", "class").alias("class"))
    smallest = classes.groupBy("class").agg(F.min("doc").alias("component"))
    component = classes.join(smallest, "class").select("digest", "component")
    members = sketches.join(component, "digest", "left")
    component_id = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return members.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("doc") == component_id, F.lit(True)).alias("kept"))


def _late_links(lists: DataFrame, texts: DataFrame, heads: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) between classes of the unsettled ``lists`` (key, digest, class): by hubs, then by rarest-first prefixes."""
    unsettled = stored(lists.select("digest", "class").distinct(), "op8-classes")
    full = _full_sets(texts, heads, unsettled.select("digest"), width, "op8-late-sets")
    shingles = full.join(unsettled, "digest").select(F.col("digest").alias("doc"), "class", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    # a shingle of one class cannot link two
    spread = shingles.groupBy("shingle").agg(F.count("*").alias("df"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    by_df = W.partitionBy("doc").orderBy("df", "shingle")
    weight = F.sum(F.col("df") - 1).over(by_df.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    index = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100.0 + percent)) + 1
    ranked = shingles.join(spread, "shingle").withColumn("rank", F.row_number().over(by_df)).withColumn("weight", weight)
    # the first row of a set tells its weight, whether or not its shingle can link
    ranked = ranked.withColumn("links", (F.col("rank") <= probe) & (F.col("lo") < F.col("hi"))).filter("links or rank = 1")
    prefix = stored(ranked.select("doc", "n", "shingle", "rank", "weight", "links", (F.col("rank") <= index).alias("indexed")), "op8-prefix")

    weights = prefix.filter("rank = 1").select(F.col("doc").alias("digest"), F.struct("weight", -F.col("n"), F.col("doc").alias("digest")).alias("order"))
    members = lists.join(weights, "digest")
    hubs = members.groupBy("key").agg(F.max(F.struct("order", "class")).alias("hub")).select("key", F.col("hub.order.digest").alias("a"), F.col("hub.class").alias("class_a"))
    estimated = lists.join(hubs, "key").filter("class <> class_a").select("a", F.col("digest").alias("b"), "class_a", F.col("class").alias("class_b")).distinct()
    likely = stored(_likely_pairs(estimated, heads, k, percent), "op8-hub-pairs")
    by_hubs = _confirmed(likely, full, percent, "op8-hub-links").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    merged = components(by_hubs, "op8-hub-stars").select(F.col("node").alias("class"), "root")
    now = stored(unsettled.join(merged, "class", "left").select(F.col("digest").alias("doc"), F.coalesce("root", "class").alias("class")), "op8-hub-classes")

    linking = prefix.filter("links").select("doc", "n", "shingle", "rank", "indexed").join(now, "doc")
    apart = linking.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("shingle")
    linking = stored(linking.join(apart, "shingle"), "op8-linking")
    side = lambda df, x: df.select(F.col("doc").alias(x), F.col("class").alias(f"class_{x}"), F.col("n").alias(f"n_{x}"), F.col("rank").alias(f"rank_{x}"), "shingle")
    # common shingles that two sets of these sizes need; one of them has fewer than the rest before it in both
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100.0 + percent))
    early = (F.col("rank_a") <= F.col("n_a") - need + 1) & (F.col("rank_b") <= F.col("n_b") - need + 1)
    near = F.expr(f"class_a <> class_b and (n_a < n_b or (n_a = n_b and a < b)) and 100 * n_a >= {percent} * n_b")
    pairs = stored(side(linking.filter("indexed"), "a").join(side(linking, "b"), "shingle").filter(near & early).select("a", "b", "class_a", "class_b").distinct(), "op8-late-pairs")
    links = _confirmed(pairs, full, percent, "op8-late-links").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    dropped(prefix, linking, full, likely, pairs, unsettled, now)
    # the classes that the hubs' links made are named by one of their own
    return by_hubs.unionByName(links)


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query over whole ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (
  WITH RECURSIVE q(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, q.root FROM q JOIN e ON e.u = q.node WHERE q.root < e.v)
  SELECT node, min(root) AS root FROM q GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = d.doc_id
"""
