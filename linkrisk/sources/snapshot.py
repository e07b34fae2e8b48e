"""The threat snapshot in buckets with a manifest: a batch rewrites the buckets that it touches, and readers see whole versions.

A version is a manifest that names a folder for each bucket of ids. Rows of untouched buckets stay where they are. The manifest
is put in place by one rename after the data is written, so a batch that fails leaves no version, and who reads a version is not
disturbed by the next one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkrisk.functions.shared import dropped_at_end, written
from linkrisk.operators import threat
from linkrisk.sources.feed import parse_feed
from linkrisk.streaming.jobs import SNAPSHOT

BUCKETS = 64


class BucketedSnapshot:
    """The snapshot under ``root``, whose number of buckets never changes."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """The numbers of all complete versions, rising."""
        place = self.path(f"{self.root}/manifest")
        if not self.fs.exists(place):
            return []
        names = [item.getPath().getName() for item in self.fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def folders(self, version: int) -> dict[int, str]:
        """Each bucket's folder in a version; buckets without rows have none."""
        if version < 0:
            return {}
        stream = self.fs.open(self.path(f"{self.root}/manifest/{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): f for b, f in json.loads(text)["folders"].items()}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest if not given), of all buckets or some; none before the first version."""
        if version is None:
            version = max(self.versions(), default=-1)
        some = [f for b, f in self.folders(version).items() if buckets is None or b in buckets]
        if not some:
            return self.spark.createDataFrame([], SNAPSHOT)
        return self.spark.read.schema(SNAPSHOT).parquet(*[f"{self.root}/{f}" for f in some])

    def touched(self, rows: DataFrame, base: int) -> list[int]:
        """The buckets that a batch's good rows change: those of its ids, and those of other ids with its URLs."""
        own = rows.select(self.bucket(F.col("id")).alias("b"))
        others = self.read(base).join(rows.select("url").distinct(), "url", "left_semi").select(self.bucket(F.col("id")).alias("b"))
        return sorted(r.b for r in own.unionByName(others).distinct().collect())  # at most ``buckets`` rows

    def apply(self, feed: DataFrame, version: int) -> DataFrame:
        """Upserts a feed batch into the newest version below ``version`` and makes it that version; returns the statistics.

        The result equals ``threat.upsert`` over the whole snapshot: what a batch can change, its ids' rows and those with its
        URLs, lies in the buckets that it rewrites. A version that is made again replaces itself.
        """
        base = max((v for v in self.versions() if v < version), default=-1)
        feed = written(feed, "feed")
        buckets = self.touched(threat.entries(feed).where(~F.col("failed")).select("id", "url"), base)
        new, counts = threat.upsert(self.read(base, buckets), feed)
        folder = f"data/{version}-{uuid.uuid4().hex}"
        placed = new.withColumn("bucket", self.bucket(F.col("id")))
        placed.repartitionByRange("bucket", "id").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        counts = written(counts, "counts")
        made = self.fs.listStatus(self.path(f"{self.root}/{folder}"))
        changed = {int(name.removeprefix("bucket=")): f"{folder}/{name}" for name in (x.getPath().getName() for x in made) if name.startswith("bucket=")}
        kept = {b: f for b, f in self.folders(base).items() if b not in buckets}
        self.publish(version, kept | changed)
        return counts

    def publish(self, version: int, folders: dict[int, str]) -> None:
        """Puts a manifest in place by one rename."""
        aside, place = self.path(f"{self.root}/manifest/.{version}-{uuid.uuid4().hex}"), self.path(f"{self.root}/manifest/{version}.json")
        out = self.fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps({"version": version, "folders": folders}).encode()))
        finally:
            out.close()
        if self.fs.exists(place):
            self.fs.delete(place, False)
        if not self.fs.rename(aside, place):
            raise OSError(f"version {version} could not be put in place")

    def drop_old(self, keep: int = 2) -> None:
        """Deletes all versions but the newest ``keep``, and the data that only they use."""
        versions = self.versions()
        used = {f.rsplit("/", 1)[0] for v in versions[-keep:] for f in self.folders(v).values()}
        for v in versions[:-keep]:
            self.fs.delete(self.path(f"{self.root}/manifest/{v}.json"), False)
        if self.fs.exists(self.path(f"{self.root}/data")):
            for item in self.fs.listStatus(self.path(f"{self.root}/data")):
                if f"data/{item.getPath().getName()}" not in used:
                    self.fs.delete(item.getPath(), True)


def refresh_buckets(spark: SparkSession, landing: str, root: str, stats: str, checkpoint: str, buckets: int = BUCKETS, every: str | None = None) -> StreamingQuery:
    """Upserts feed files, one a batch in order of arrival, into versions of a bucketed snapshot; statistics by batch id."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(landing)

    def write(batch: DataFrame, number: int) -> None:
        with dropped_at_end(batch.sparkSession):
            feed = parse_feed(batch.select("value", F.monotonically_increasing_id().alias("line_no")))
            counts = BucketedSnapshot(batch.sparkSession, root, buckets).apply(feed, number)
            counts.write.mode("overwrite").parquet(f"{stats}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
