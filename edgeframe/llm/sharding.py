"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's id alone decides its virtual slot; the map says which shard a slot
lives in.  Resharding edits the map and never the slots: :meth:`SlotMap.grown`
hands an even share of slots to one more shard, :meth:`SlotMap.rebalanced`
moves slots by their bytes.  Each edit is a new version; the map is a table of
``slots`` rows a version, whatever the corpus.

Positions inside a shard are gapless without a sort of the shard: rows are
numbered inside (virtual slot, sub-slot) and shifted by the running count of
the groups before it.  Counts and bytes of these groups are one table of
``slots * SUB`` rows at most, which also says what each slot weighs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeframe.llm.shared import scratch_dir, stored

SLOTS, SHARDS = 4096, 24
#: Parts of a slot that are numbered apart, by the text, so that rows without an id spread too.
SUB = 16
#: Bytes that a record takes besides its text.
OVERHEAD = 8


def _one_more(owner: list[int]) -> list[int]:
    """The fullest shards give slots to a new one until it has an even share."""
    new, owner = max(owner) + 1, list(owner)
    held: dict[int, list[int]] = {s: [] for s in range(new)}
    for slot, shard in enumerate(owner):
        held[shard].append(slot)
    for _ in range(len(owner) // (new + 1)):
        fullest = max(held, key=lambda s: (len(held[s]), -s))
        owner[held[fullest].pop()] = new
    return owner


@dataclass
class SlotMap:
    """Owners of the slots, version by version; the last one holds."""

    versions: list[list[int]] = field(default_factory=list)

    @classmethod
    def even(cls, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """The map that growing from one shard to ``shards`` gives, as version 1.

        It depends on the two numbers only, and the map of one more shard is
        this one with some slots moved into that shard.
        """
        if not 1 <= shards <= slots:
            raise ValueError("there must be a slot for each shard")
        owner = [0] * slots
        for _ in range(shards - 1):
            owner = _one_more(owner)
        return cls([owner])

    @property
    def version(self) -> int:
        return len(self.versions)

    @property
    def owner(self) -> list[int]:
        return self.versions[-1]

    def grown(self) -> SlotMap:
        """One more shard; no slot moves between the old ones."""
        return SlotMap([*self.versions, _one_more(self.owner)])

    def at(self, version: int) -> SlotMap:
        """The map as it was at a version, its history with it."""
        return SlotMap(self.versions[:version])

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """Move slots from the heaviest to the lightest shard while that narrows the gap."""
        owner = list(self.owner)
        load = dict.fromkeys(range(max(owner) + 1), 0)
        for slot, shard in enumerate(owner):
            load[shard] += slot_bytes.get(slot, 0)
        target = sum(load.values()) / len(load)
        for _ in owner:
            heavy, light = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
            gap = load[heavy] - load[light]
            if gap <= tolerance * target:
                break
            movable = [(slot_bytes.get(s, 0), s) for s, o in enumerate(owner) if o == heavy and 0 < slot_bytes.get(s, 0) < gap]
            if not movable:
                break
            size, slot = min(movable, key=lambda x: (abs(x[0] - gap / 2), x[1]))
            owner[slot] = light
            load[heavy] -= size
            load[light] += size
        return SlotMap([*self.versions, owner])

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, virtual_slot, shard), one row a slot and version."""
        rows = [(v + 1, s, o) for v, owner in enumerate(self.versions) for s, o in enumerate(owner)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        found: dict[int, dict[int, int]] = {}
        for version, slot, shard in spark.read.parquet(path).select("version", "virtual_slot", "shard").collect():
            found.setdefault(version, {})[slot] = shard
        return cls([[owner[s] for s in range(len(owner))] for _, owner in sorted(found.items())])


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: 32 bits of its MD5 (of its decimal or text form)."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def _sized(docs: DataFrame, slots: int, id_col: str, text_col: str) -> DataFrame:
    """Each row's id, size, text_crc32, virtual_slot and sub-slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), slot_of(F.col(id_col), slots).alias("virtual_slot"))
    return rows.withColumn("sub", (F.col("text_crc32") % SUB).cast("int"))


def slot_weights(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(virtual_slot, sub, rows, bytes), at most ``slots * SUB`` rows; slots without a row are absent.

    A null text weighs as an empty one, null ids share a slot, repeated rows
    count each; an empty table gives an empty result.
    """
    return _sized(docs, slots, id_col, text_col).groupBy("virtual_slot", "sub").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def slot_bytes(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(virtual_slot, rows, bytes): what rebalancing weighs; :func:`slot_weights` without the sub-slots."""
    return slot_weights(docs, slots, id_col, text_col).groupBy("virtual_slot").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def assign_shards(docs: DataFrame, slot_map: SlotMap, id_col: str = "doc_id", text_col: str = "text", after: SlotMap | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Each row's id, size, text_crc32, shard, slot, grown_shard, virtual_slot, slot_bytes, map_version.

    ``slot`` is the row's place in its shard, without gaps from 0; rows of a
    shard are ordered by virtual slot, a hash of the text, id, then text hash.
    ``grown_shard`` is the shard in the map ``after``, else after
    :meth:`SlotMap.grown`; ``slot_bytes`` is the size of all rows of the
    virtual slot.  ``weights`` is a table of :func:`slot_weights`, if at hand.

    A null text has size 8 and checksum 0 like an empty one; all null ids
    share the virtual slot of the empty string; repeated rows get places of
    their own; other columns are not read, so their names cannot clash.  An
    empty table gives an empty result.
    """
    spark, slots, after = docs.sparkSession, len(slot_map.owner), after or slot_map.grown()
    rows = _sized(docs, slots, id_col, text_col)
    owners = spark.createDataFrame(list(zip(range(slots), slot_map.owner, after.owner, strict=True)), "virtual_slot int, shard int, grown_shard int")
    groups = (slot_weights(docs, slots, id_col, text_col) if weights is None else weights).join(F.broadcast(owners), "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot", "sub").rowsBetween(W.unboundedPreceding, -1)
    # slots * SUB rows at most, however large the corpus
    groups = groups.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("slot_bytes", F.sum("bytes").over(W.partitionBy("virtual_slot"))).drop("rows", "bytes")
    inside = W.partitionBy("virtual_slot", "sub").orderBy(id_col, "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(groups), ["virtual_slot", "sub"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard", "virtual_slot", "slot_bytes", F.lit(slot_map.version).alias("map_version"))
    )


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: the law is ``key``, id and shard count decide.

    The bytes of each slot are aggregated and stored; the map, with one more
    shard as its second version, is saved in the shared folder and rows are
    assigned from what is read back.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = stored(slot_weights(docs), "slot-weights")
    path = f"{scratch_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    SlotMap.even(SHARDS, SLOTS).grown().save(spark, path)
    saved = SlotMap.load(spark, path)
    out = assign_shards(docs, saved.at(1), after=saved.at(2), weights=weights)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes", "map_version")


def _sql() -> str:
    """The contract query in DuckDB SQL; the two maps are literal lists, the checksum is spelled out."""
    now = SlotMap.even(SHARDS, SLOTS)
    return f"""
WITH z AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END)) AS t, {now.owner} AS now, {now.grown().owner} AS later),
b AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
c AS (SELECT doc_id, octet_length(x)::BIGINT + {OVERHEAD} AS size, now, later, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS} AS v,
  xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(x), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, h: xor(t[(xor(a, h) & 255) + 1], a >> 8)), 4294967295)::BIGINT AS text_crc32 FROM b, z),
s AS (SELECT *, now[v + 1]::INT AS shard, later[v + 1]::INT AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY v, text_crc32 % {SUB}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard, v::INT AS virtual_slot, (sum(size) OVER (PARTITION BY v))::BIGINT AS slot_bytes, 1::INT AS map_version FROM s
"""


OP4_SQL = _sql()
