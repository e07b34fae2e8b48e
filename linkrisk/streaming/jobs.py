"""Continuous jobs: scoring requests as they come, refreshing the threat snapshot, look-ups once per domain, delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkrisk.functions import urls
from linkrisk.functions.shared import Scratch, dropped_at_end
from linkrisk.operators import threat
from linkrisk.sources.feed import parse_feed

SNAPSHOT = "id bigint, url string, host string, match_key string, threat string, tags string, url_status string, date_added timestamp_ntz, last_online timestamp_ntz, urlhaus_link string, reporter string"


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Scores each micro-batch of ``requests`` with ``score`` and writes it by batch id.

    A batch that is run again after a failure overwrites its own folder, so no verdict is written twice. The intermediate
    tables that ``score`` writes are dropped when the batch is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        with dropped_at_end(batch.sparkSession):
            score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_version(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """The newest complete version of a snapshot (-1 and no rows before the first)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(path):
        for item in fs.listStatus(path):
            name = item.getPath().getName()
            if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")):
                found.append(int(name.removeprefix("version=")))
    if not found:
        return -1, spark.createDataFrame([], SNAPSHOT)
    return max(found), spark.read.schema(SNAPSHOT).parquet(f"{root}/version={max(found)}")


def refresh_stream(spark: SparkSession, landing: str, root: str, stats: str, checkpoint: str, every: str | None = None, rejected: str | None = None) -> StreamingQuery:
    """Upserts feed files, one file a batch in order of arrival, into versions of the snapshot under ``root``.

    Each batch writes a new version and its statistics by batch id; a failed batch leaves earlier versions as they are. A
    batch that is run again starts from the version before it. Rows that fail are put aside, as they came, in ``rejected``
    (``stats`` with "-rejected" if not given) by batch id.
    """
    aside = rejected or f"{stats.rstrip('/')}-rejected"
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(landing)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        version, old = current_version(session, root)
        if version >= number:
            old = session.read.schema(SNAPSHOT).parquet(f"{root}/version={number - 1}") if number else session.createDataFrame([], SNAPSHOT)
        feed = parse_feed(batch.select("value", F.monotonically_increasing_id().alias("line_no")))
        new, counts = threat.upsert(old, feed)
        new.write.mode("overwrite").parquet(f"{root}/version={number}")
        counts.write.mode("overwrite").parquet(f"{stats}/batch={number}")
        bad = threat.entries(feed).where("failed").select("line_no")
        feed.join(bad, "line_no", "left_semi").write.mode("overwrite").parquet(f"{aside}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def lookups(requests: DataFrame, time: str = "ts", url: str = "url", keep: str = "7 days") -> DataFrame:
    """The registered domains to look up, each once within ``keep``; rows later than the watermark are dropped."""
    domain = urls.registered_or_host(urls.host_of(F.col(url)))
    rows = requests.select(F.col(time).alias("ts"), domain.alias("domain")).where("domain <> ''")
    return rows.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["domain"])


def deliver(rows: DataFrame, send: Callable[[DataFrame], DataFrame], out: str, dead: str, number: int, tries: int = 3) -> None:
    """Sends rows at most ``tries`` times; what is left goes to the dead-letter table.

    ``send`` takes and returns rows with a boolean ``delivered``. What each try has done is written before anything reads it, so
    a lost executor sends nothing again. Both tables are written by batch number, so a batch that is run again replaces its own
    rows.
    """
    scratch, left = Scratch(rows.sparkSession, "deliver"), rows
    for attempt in range(tries):
        done = scratch.keep(send(left), f"try-{attempt}")
        done.where("delivered").drop("delivered").write.mode("overwrite").parquet(f"{out}/batch={number}/try={attempt}")
        left = done.where("not delivered").drop("delivered")
    left.write.mode("overwrite").parquet(f"{dead}/batch={number}")
    scratch.drop_all()
