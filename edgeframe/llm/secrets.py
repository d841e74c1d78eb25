"""Secret scan with multipart credential linking, in DataFrame operations only.

Single-part detectors (`BASE`) report by themselves.  Weak parts - an
identifier assignment, a bare high-entropy word, an endpoint - mean nothing
alone, so they are reported only where complementary parts stand within the
same scope.  A scope is ``reach`` code points to either side of a part inside
one document; the interval join of parts is a range frame over the document's
parts in order of position, so no pairs are formed.

One pass over the text finds all parts of a document as arrays.  Offsets come
from splitting: the k-th match starts after k + 1 pieces and k matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeframe.llm.shared import quoted, stored

#: Code points between the starts of parts of one credential, at most.
REACH = 200

#: Kind, pattern, group that must reach the length, and that length.  Fixed values.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: Weak parts: kind, pattern, group, length.  Fixed values.
WEAK = (
    ("identifier", r"""(?i:(user(?:_?name)?|login|client_?id|account|access_?id|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3),
    ("material", r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
    ("endpoint", r"(?i:https?|wss?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[A-Za-z0-9.:@/_?&=%~+-]+", 0, 8),
)

#: Strings of which every match has one.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "hex": (), "identifier": (":", "="), "material": (), "endpoint": ("://",)}

#: Which role each kind plays in a credential.
ROLE = {"assign": "secret", "hex": "secret", "material": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
ORDER = [k for k, *_ in BASE] + [k for k, *_ in WEAK]


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, order, end>> of the matches of one kind."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    sized = F.zip_with(F.transform(F.slice(gaps, 1, F.size(whole)), F.length), F.transform(whole, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    sized = F.zip_with(sized, F.transform(tested, F.length), lambda s, t: F.struct(s["g"].alias("g"), s["m"].alias("m"), t.alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int>>").alias("found"))
    order = ORDER.index(kind)

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["g"], acc["at"] + x["g"] + x["m"]
        new = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["t"] >= least, F.concat(acc["found"], new)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(sized, start, step)["found"]
    # a literal that every match has, before the pattern is tried
    may = reduce(Column.__or__, [F.contains(text, F.lit(s)) for s in NEEDS[kind]], F.lit(not NEEDS[kind]))
    return F.when(may & text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,order:int,end:int>>"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, of spans in order."""
    name = lambda o: F.element_at(F.array(*map(F.lit, ORDER)), o + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s["order"]), s["start"].cast("string"), s["end"].cast("string"))))


def _nearest(role: Column, reach: int, window) -> Column:
    """Start of the part with ``role`` nearest to this one, the earlier of two; null if none is within reach."""
    at = F.when(role, F.col("start"))
    left, right = F.max(at).over(window.rangeBetween(-reach, 0)), F.min(at).over(window.rangeBetween(0, reach))
    return F.when(left.isNull() | (right - F.col("start") < F.col("start") - left), right).otherwise(left)


def _scanned(docs: DataFrame, reach: int, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(``row``, ``spans``, ``links``); ``row`` is the id or, if ``whole``, all columns.

    The patterns run once over each text: the parts are written down and read
    again by the steps after.  Rows are told apart by id and text.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    row = F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns))) if whole else F.struct(F.col(quoted(id_col)).alias("id"))
    scanned = docs.select(row.alias("row"), F.col(quoted(id_col)).alias("doc"), F.xxhash64(text).alias("print"), F.concat(*(_spans(text, *x) for x in BASE + WEAK)).alias("parts"))
    found = stored(scanned, "op3-parts")
    # documents without weak or complementary parts, nearly all, are done: no shuffle
    # of base kinds alone only a secret and an access identifier can be linked
    kinds = lambda r: F.exists("parts", lambda p: p["order"].isin([i for i, (k, *_) in enumerate(BASE) if ROLE[k] == r]))
    weak = F.exists("parts", lambda p: p["order"] >= len(BASE)) | (kinds("secret") & kinds("identifier"))
    none = F.array().cast("array<struct<secret:int,identifier:int,endpoint:int>>")
    rows = found.filter(weak)
    parts = rows.select("doc", "print", "parts").dropDuplicates(["doc", "print"])
    each = parts.select("doc", "print", F.explode("parts").alias("p")).select("doc", "print", "p.*")
    by_start = W.partitionBy("doc", "print").orderBy("start")
    near = by_start.rangeBetween(-reach, reach)
    sofar = W.partitionBy("doc", "print").orderBy("start", "order").rowsBetween(W.unboundedPreceding, -1)
    role = lambda r: F.col("order").isin([i for i, k in enumerate(ORDER) if ROLE[k] == r]) & ~F.col("covered")
    strong = F.col("order") < len(BASE)
    # base kinds come first at one start, so a stronger part around this one has been seen
    inside = F.col("end") <= F.coalesce(F.max(F.when(strong, F.col("end"))).over(sofar), F.lit(-1))
    judged = (
        each.withColumn("covered", ~strong & inside)
        .withColumn("ids", F.count_if(role("identifier")).over(near))
        .withColumn("keys", F.count_if(role("secret")).over(near))
        .withColumn("identifier", _nearest(role("identifier"), reach, by_start))
        .withColumn("endpoint", _nearest(role("endpoint"), reach, by_start))
    )
    complete = F.when(role("secret"), F.col("ids") > 0).when(role("identifier"), F.col("keys") > 0).otherwise((F.col("ids") > 0) & (F.col("keys") > 0))
    linked = judged.groupBy("doc", "print").agg(
        F.array_sort(F.collect_list(F.when(strong | (~F.col("covered") & complete), F.struct("start", "order", "end")))).alias("spans"),
        F.array_sort(F.collect_set(F.when(role("secret") & F.col("identifier").isNotNull(), F.struct(F.col("start").alias("secret"), "identifier", "endpoint")))).alias("links"),
    )
    same = rows["doc"].eqNullSafe(linked["doc"]) & (rows["print"] == linked["print"])
    return found.filter(~weak).select("row", F.array_sort("parts").alias("spans"), none.alias("links")).unionByName(rows.join(linked, same).select("row", "spans", "links"))


def scan_secrets(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``spans``, ``links``.

    ``spans`` has every reported span as (start, order, end) in code points,
    end exclusive, by start, then kind in the order of ``ORDER``.  ``links`` has
    (secret, identifier, endpoint) by their starts: each secret with the nearest
    identifier and, if there is one, the nearest endpoint within reach.  A weak secret needs an identifier within
    ``reach`` code points of its start, a weak identifier needs a secret, and
    an endpoint needs both; a weak part inside a stronger part is that part.

    Null and empty texts have no spans; rows with a null id are scanned like
    others; repeated rows come back as often as they occur, each with its
    spans; other columns are not read.  An empty table gives an empty result.
    """
    found = _scanned(docs, reach, id_col, text_col, False)
    return found.select(F.col("row")["id"].alias(id_col), "spans", "links")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, its columns and rows, with every reported span replaced by ``mask``.

    Overlapping spans become one mask.  Null texts stay null; other columns,
    whatever their names, pass unread.
    """
    found = _scanned(docs, reach, id_col, text_col, True)
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    text = F.col("row")[f"c{place}"]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mask))
        # a span that begins inside the last one only lengthens it
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when((s["start"] >= acc["at"]) | (acc["out"] == ""), fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step)
    clean = F.when(F.size("spans") > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
    return found.select(*(clean.alias(c) if i == place else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query over whole ``documents``."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["order"] == ORDER.index(k))).cast("long").alias(f"n_{k}")
    links = F.concat_ws(",", F.transform("links", lambda x: F.concat_ws(":", x["secret"].cast("string"), x["identifier"].cast("string"), x["endpoint"].cast("string"))))
    return found.select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["order"] >= len(BASE))).cast("long").alias("linked"), links.alias("links"))


def _sql() -> str:
    """The same in DuckDB SQL, out of the same tables of patterns."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT rid, {ORDER.index(kind)} AS ord, string_split_regex(t, {quoted(p)}) AS g, regexp_extract_all(t, {quoted(p)}) AS m, regexp_extract_all(t, {quoted(p)}, {group}) AS x, {least} AS least FROM d WHERE regexp_matches(t, {quoted(p)})"
        for kind, p, group, least in BASE + WEAK
    )
    of = lambda r: ", ".join(str(i) for i, k in enumerate(ORDER) if ROLE[k] == r)
    name = f"[{', '.join(quoted(k) for k in ORDER)}][ord + 1]"
    text = f"coalesce(string_agg({name} || ':' || a || ':' || b, ',' ORDER BY a, ord, b) FILTER (WHERE {{0}}), '')"
    n = len(BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE ord = {i}) AS n_{k}" for i, (k, *_) in enumerate(BASE))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
p AS (SELECT rid, ord, (list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0))::BIGINT AS a, length(m[i]) AS n FROM i WHERE length(x[i]) >= least),
s AS (SELECT rid, ord, a, a + n AS b FROM p),
c AS (SELECT *, ord >= {n} AND b <= coalesce(max(CASE WHEN ord < {n} THEN b END) OVER (PARTITION BY rid ORDER BY a, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS covered FROM s),
j AS (SELECT *, count(*) FILTER (WHERE ord IN ({of("identifier")}) AND NOT covered) OVER w AS ids, count(*) FILTER (WHERE ord IN ({of("secret")}) AND NOT covered) OVER w AS keys,
  max(CASE WHEN ord IN ({of("identifier")}) AND NOT covered THEN a END) OVER l AS il, min(CASE WHEN ord IN ({of("identifier")}) AND NOT covered THEN a END) OVER r AS ir,
  max(CASE WHEN ord IN ({of("endpoint")}) AND NOT covered THEN a END) OVER l AS el, min(CASE WHEN ord IN ({of("endpoint")}) AND NOT covered THEN a END) OVER r AS er
  FROM c WINDOW w AS (PARTITION BY rid ORDER BY a RANGE BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING), l AS (PARTITION BY rid ORDER BY a RANGE BETWEEN {REACH} PRECEDING AND CURRENT ROW), r AS (PARTITION BY rid ORDER BY a RANGE BETWEEN CURRENT ROW AND {REACH} FOLLOWING)),
k AS (SELECT DISTINCT rid, a, CASE WHEN il IS NULL OR ir - a < a - il THEN ir ELSE il END AS i, CASE WHEN el IS NULL OR er - a < a - el THEN er ELSE el END AS e FROM j WHERE ord IN ({of("secret")}) AND NOT covered),
q AS (SELECT rid, string_agg(a || ':' || i || coalesce(':' || e, ''), ',' ORDER BY a) AS links FROM k WHERE i IS NOT NULL GROUP BY rid),
r AS (SELECT *, NOT covered AND ord >= {n} AND CASE WHEN ord IN ({of("secret")}) THEN ids > 0 WHEN ord IN ({of("identifier")}) THEN keys > 0 ELSE ids > 0 AND keys > 0 END AS linked FROM j),
o AS (SELECT rid, {counts}, sha256({text.format(f"ord < {n}")}) AS base_sha256, {text.format(f"ord < {n} OR linked")} AS spans, count(*) FILTER (WHERE linked) AS linked FROM r GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(linked, 0) AS linked, coalesce(links, '') AS links FROM d LEFT JOIN o USING (rid) LEFT JOIN q USING (rid)
"""


OP3_SQL = _sql()
