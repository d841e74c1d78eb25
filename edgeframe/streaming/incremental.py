"""Content-hash cache, snapshot differences and the change stream.

The cache is a Parquet table of facts with the path's and the content's MD5
and the time of analysis.  A change stream is any streaming DataFrame of
(path, kind, seq, content) with kinds add, change and unlink; each micro-batch
keeps the last change of a path, drops the path's old rows and scans the new
content.  The built-in file source cannot serve as that stream: it reports
neither changed nor deleted files, so :class:`FolderChanges` lists a folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeframe.sources.typescript import FACTS, Scanner, extract

TTL_DAYS = 7
CHANGES = "path string, kind string, seq long, content string"


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, path_key, file_hash) of files (path, content)."""
    return files.select("path", F.md5("path").alias("path_key"), F.md5(F.coalesce("content", F.lit(""))).alias("file_hash"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): unchanged, changed, added or removed between two snapshots (path, content)."""
    old, new = (fingerprints(x).select("path", F.col("file_hash").alias(n)) for x, n in ((before, "old"), (after, "new")))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "path", "full_outer").select("path", state.alias("state"))


class Cache:
    """Facts by file, valid while the content is the same and for ``ttl_days``."""

    def __init__(self, spark: SparkSession, path: str, ttl_days: int = TTL_DAYS):
        self.spark, self.path, self.ttl_days = spark, path.rstrip("/"), ttl_days
        self.schema = FACTS + ", path_key string, file_hash string, cached_at timestamp"

    def _versions(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted((n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))), key=lambda n: int(n[1:]))

    def read(self) -> DataFrame:
        """The newest complete version; empty at first."""
        found = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> None:
        """A new version beside the old one, so that a reader or a lost executor never sees half of it."""
        found = self._versions()
        number = int(found[-1][1:]) + 1 if found else 0
        rows.select(*(c.split(" ")[0] for c in self.read().columns)).write.mode("overwrite").parquet(f"{self.path}/v{number}")

    def valid(self) -> DataFrame:
        return self.read().filter(F.col("cached_at") >= F.current_timestamp() - F.expr(f"INTERVAL {self.ttl_days} DAYS"))

    def lookup(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(facts of files whose content is cached, files that must be scanned)."""
        marks = fingerprints(files).select("path", "file_hash")
        hits = self.valid().join(marks, ["path", "file_hash"], "left_semi").select(*self.read().columns)
        return hits, files.join(hits.select("path").distinct(), "path", "left_anti")

    def stamped(self, facts: DataFrame, files: DataFrame) -> DataFrame:
        return facts.join(fingerprints(files), "path").withColumn("cached_at", F.current_timestamp())

    def stats(self) -> DataFrame:
        """Entries, their size in characters and the oldest time."""
        return self.read().agg(F.countDistinct("path_key").alias("entries"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size"), F.min("cached_at").alias("oldest"))

    def invalidate(self, paths: DataFrame) -> None:
        self.write(self.read().join(paths.select("path"), "path", "left_anti"))

    def prune(self) -> None:
        self.write(self.valid())

    def clear(self) -> None:
        self.write(self.read().limit(0))


def analyze_incrementally(files: DataFrame, cache: Cache, scanner: type[Scanner] = Scanner) -> DataFrame:
    """Facts of ``files``; only new and changed ones are scanned, and the cache follows the snapshot."""
    hits, todo = cache.lookup(files)
    cache.write(hits.unionByName(cache.stamped(extract(todo, scanner), todo)))
    return cache.read().drop("path_key", "file_hash", "cached_at")


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path; other files than sources are dropped."""
    wanted = changes.filter(F.col("path").rlike(r"\.tsx?$") & ~F.col("path").rlike(r"(^|/)(node_modules|\.git|dist|build|coverage)/"))
    return wanted.groupBy("path").agg(F.max_by(F.struct("kind", "content"), "seq").alias("c")).select("path", "c.kind", "c.content")


def apply_changes(changes: DataFrame, cache: Cache, scanner: type[Scanner] = Scanner) -> None:
    """One batch: changed and removed paths lose their rows, changed ones are scanned."""
    last = last_changes(changes).persist()
    kept = cache.read().join(last.select("path"), "path", "left_anti")
    fresh = last.filter("kind <> 'unlink'").select("path", "content")
    cache.write(kept.unionByName(cache.stamped(extract(fresh, scanner), fresh)))
    last.unpersist()


def watch(changes: DataFrame, cache: Cache, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, available_now: bool = False):
    """Start the stream of changes into the cache; replays of a batch give the same rows."""

    def batch(df: DataFrame, number: int) -> None:
        apply_changes(df, cache)
        if on_batch:
            on_batch(df, number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    # a fixed tick stands for the quiet period that a debounce waits for
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 milliseconds")).start()


class FolderChanges:
    """Changes of a folder between two looks at it, as rows of :data:`CHANGES`."""

    def __init__(self, root: str):
        self.root, self.seen, self.seq = Path(root), {}, 0

    def poll(self) -> list[tuple[str, str, int, str | None]]:
        out, now = [], {}
        for file in sorted(p for p in self.root.rglob("*") if p.suffix in (".ts", ".tsx") and p.is_file()):
            path, content = str(file.relative_to(self.root)), file.read_text(errors="replace")
            now[path] = hashlib.md5(content.encode()).hexdigest()
            if self.seen.get(path) != now[path]:
                self.seq += 1
                out.append((path, "change" if path in self.seen else "add", self.seq, content))
        for path in self.seen.keys() - now.keys():
            self.seq += 1
            out.append((path, "unlink", self.seq, None))
        self.seen = now
        return out
