"""Size-tiered compaction of a sharded table, with DataFrame operations only.

A store is a folder with ``shards/``, where Parquet files are written once and never changed, and ``manifest/``, with one folder of
JSON lines per version. A version lists the live shards (path, rows, bytes). It is written beside and then renamed to its number;
the rename fails if another writer took the number first, so readers see whole versions only. A writer that comes second applies its change to the version
that came first and tries again; a merge whose shards are gone by then is given up (``CommitConflict``).

``append`` writes an arrival as small shards. ``compact`` sorts the live shards into tiers, each ``FANOUT`` times as large as the one
before; the shards of a tier that has ``FANOUT`` or more of them are read together and written anew as files of about the target
size, until no tier has so many. Spark's reader packs the files of a merge into its tasks and each task writes
one file, so no row is shuffled. Shards of the target size or more are left alone. ``vacuum`` deletes files that no kept version lists, but none of a
write that has begun and is not committed yet: each registers itself under ``pending/`` first. What a writer that died has left goes after ``PENDING_HOURS``.

Defined cases: an arrival without rows adds no shard but a version; nulls, repeated rows and columns of any name are kept as they
are; a store without versions can't be read, compacting it does nothing; a row larger than the target is a file of its own.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm._common import new_path, table

FANOUT = 4
TARGET_BYTES = 64 << 20
ARRIVAL_ROWS = 2_000
PENDING_HOURS = 24.0
TRIES = 20


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout

    def _at(self, path: str) -> tuple[JavaObject, JavaObject]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._at(f"{self.path}/manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, rows and bytes of a version's live shards, the latest by default."""
        version = self.versions()[-1] if version is None else version
        return self.spark.read.schema("path string, rows long, bytes long").json(f"{self.path}/manifest/{version:08d}")

    def _commit(self, shards: DataFrame, version: int) -> int:
        """Renames a finished manifest to its number; this kind of rename fails where the number is taken, and is atomic on HDFS."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        beside = f"{self.path}/manifest/_{uuid.uuid4().hex}"
        shards.select("path", "rows", "bytes").write.json(beside)
        _, final = self._at(f"{self.path}/manifest/{version:08d}")
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(kind, 1)
        how[0] = kind.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._at(beside)[1], final, how)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    def _listed(self, folder: str) -> DataFrame:
        """The files that one write made, with their rows (from the footers) and bytes."""
        meta = F.col("_metadata")
        files = self.spark.read.parquet(folder).select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes"))
        return files.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")).filter("rows > 0")

    def _begin(self) -> str:
        """Registers a write; the folder for its files."""
        name = uuid.uuid4().hex
        fs, p = self._at(f"{self.path}/pending/{name}")
        fs.create(p).close()
        return f"{self.path}/shards/{name}"

    def _end(self, folder: str) -> None:
        fs, p = self._at(f"{self.path}/pending/{folder.rsplit('/', 1)[1]}")
        fs.delete(p, False)

    def _publish(self, change: Callable[[DataFrame | None], DataFrame]) -> int:
        """Commits what change() makes of the latest version's shards (None if there is no version), again and again until no other writer is first."""
        for _ in range(TRIES):
            known = self.versions()
            try:
                return self._commit(change(self.manifest(known[-1]) if known else None), (known[-1] if known else 0) + 1)
            except CommitConflict:
                if not self.versions() or self.versions() == known:
                    raise
        raise CommitConflict(f"{TRIES} other writers were first")

    def append(self, rows: DataFrame, rows_per_shard: int = ARRIVAL_ROWS) -> int:
        folder = self._begin()
        rows.write.option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        new = self._listed(folder)
        version = self._publish(lambda live: new if live is None else live.unionByName(new))
        self._end(folder)
        return version

    def tiers(self, shards: DataFrame) -> DataFrame:
        """shards with their tier: how many times ``fanout`` the target is as large, rounded down; null from half the target on."""
        below = F.floor(F.log(F.lit(float(self.target)) / F.greatest(F.col("bytes"), F.lit(1))) / math.log(self.fanout)).cast("int")
        return shards.withColumn("tier", F.when(F.col("bytes") * 2 <= self.target, below))

    def compact_once(self) -> int | None:
        """Merges the crowded tier of the smallest shards into target-sized files; the new version, or None if no tier is crowded."""
        known = self.versions()
        if not known:
            return None
        shards = self.tiers(self.manifest(known[-1]))
        crowded = shards.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).filter(F.col("tier").isNotNull() & (F.col("n") >= self.fanout))
        tier = crowded.orderBy(F.desc("tier")).first()
        if tier is None:
            return None
        run = shards.filter(F.col("tier") == tier["tier"])
        paths = [r["path"] for r in run.select("path").orderBy("path").toLocalIterator()]
        folder = self._begin()
        self.spark.read.parquet(*paths).coalesce(max(1, round(tier["bytes"] / self.target))).write.parquet(folder)
        new = self._listed(folder)
        merged = run.select("path")

        def replaced(live: DataFrame | None) -> DataFrame:
            if live is None or live.join(merged, "path", "left_semi").count() != len(paths):
                raise CommitConflict("another writer merged some of these shards")
            return live.join(merged, "path", "left_anti").unionByName(new)

        version = self._publish(replaced)
        self._end(folder)
        return version

    def compact(self) -> int:
        """Merges until no tier is crowded; how many versions that took."""
        n = 0
        while self.compact_once() is not None:
            n += 1
        return n

    def _pending(self, hours: float) -> set[str]:
        """Writes that have begun in the last hours and are not committed."""
        fs, p = self._at(f"{self.path}/pending")
        since = (time.time() - 3600 * hours) * 1000
        return {s.getPath().getName() for s in fs.listStatus(p) if s.getModificationTime() >= since} if fs.exists(p) else set()

    def vacuum(self, keep: int = 1, pending_hours: float = PENDING_HOURS) -> int:
        """Deletes versions but the last ``keep`` and all files that none of these lists and no pending write may list yet; the number of files."""
        fs, top = self._at(f"{self.path}/shards")
        there, files = [], fs.listFiles(top, True)
        while files.hasNext():
            p = files.next().getPath()
            if p.getName().endswith(".parquet"):
                there.append(p)
        # in this order: a file listed above whose write is not pending here was committed before, so the versions below have it
        pending = self._pending(pending_hours)
        known = self.versions()
        live = {r["path"] for v in known[-keep:] for r in self.manifest(v).select("path").toLocalIterator()}
        for v in known[:-keep]:
            fs.delete(self._at(f"{self.path}/manifest/{v:08d}")[1], True)
        deleted = 0
        for p in there:
            if p.getParent().getName() not in pending and p.toUri().toString() not in live and p.toString() not in live:
                deleted += fs.delete(p, False)
        return deleted

    def read(self, version: int | None = None) -> DataFrame:
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.parquet(*paths)


def op6_tiered_compaction(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """``documents`` arrives in parts, by a hash of the id; each arrival is appended, then crowded tiers are merged. Read back from the
    last version: doc_id, text_sha256, and the version, rows and bytes of the shard that holds it."""
    store = ShardStore(spark, new_path(spark, "shard-store"))
    docs = table(spark, sf_dir, "documents")
    for k in range(arrivals):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
        if store.compact():
            store.vacuum()
    shards = store.manifest().select(F.col("path").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    rows = store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("_metadata.file_path").alias("shard"))
    # broadcast by Spark where the manifest is small, else joined by a shuffle
    return rows.join(shards, "shard").select("doc_id", "text_sha256", "shard_rows", "shard_bytes", F.lit(store.versions()[-1]).alias("version"))
