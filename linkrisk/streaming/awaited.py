"""Requests that wait for their captures: stream-stream outer joins with two watermarks and a bound in time.

A request meets the first hop of its URL and then the page of the URL that the hop leads to, whichever comes first. A capture
counts if it was made within a bound after the request. State is kept for as long as the bound and the watermarks ask for; when
they have passed, a request without capture goes on with what a request has that ran out of time. The same code over tables
gives the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkrisk.dims import SETTINGS, Settings
from linkrisk.functions import html, urls
from linkrisk.functions.shared import dropped_at_end, written
from linkrisk.operators import content, domain, verdict
from linkrisk.operators.brands import Brands
from linkrisk.operators.redirects import REDIRECTS

LATE = "pipeline_timeout"


def with_captures(requests: DataFrame, hops: DataFrame, pages: DataFrame, within: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """``requests`` (analysis_id, url, ts) with hop_status, hop_error, final_url, status_code, fetch_error and html.

    ``hops``: url, status_code, raw_location, error, ts; ``pages``: url, status_code, content_type, content_length, html, error,
    ts. Captures count from a request's time to ``within`` after it. Without hop the URL itself is the final one and
    ``hop_error`` is pipeline_timeout; without page ``fetch_error`` is. A URL that is captured more than once within the bound
    gives a row for each capture. Rows later than the watermark (``late``) are dropped, null URLs meet nothing.
    """
    asked = requests.select("analysis_id", "url", "ts").withWatermark("ts", late)
    hop = hops.select(F.col("url").alias("_hop_url"), F.col("ts").alias("_hop_ts"), F.struct("status_code", "raw_location", "error").alias("_hop")).withWatermark("_hop_ts", late)
    soon = lambda t: (F.col(t) >= F.col("ts")) & (F.col(t) <= F.col("ts") + F.expr(f"interval {within}"))
    met = asked.join(hop, (F.col("url") == F.col("_hop_url")) & soon("_hop_ts"), "left_outer")
    leads = F.col("_hop.status_code").isin(REDIRECTS) & (F.coalesce("_hop.raw_location", F.lit("")) != "")
    met = met.select(
        "analysis_id",
        "url",
        "ts",
        F.when(leads, urls.resolve(F.col("url"), F.col("_hop.raw_location"))).otherwise(F.col("url")).alias("final_url"),
        F.col("_hop.status_code").alias("hop_status"),
        F.when(F.col("_hop").isNull(), LATE).otherwise(F.col("_hop.error")).alias("hop_error"),
    )
    page = pages.select(F.col("url").alias("_page_url"), F.col("ts").alias("_page_ts"), F.struct("status_code", "content_type", "content_length", "html", "error").alias("_page")).withWatermark("_page_ts", late)
    met = met.join(page, (F.col("final_url") == F.col("_page_url")) & soon("_page_ts"), "left_outer")
    return met.select("analysis_id", "url", "ts", "final_url", "hop_status", "hop_error", F.col("_page").isNotNull().alias("captured"), "_page.*")


def classified(rows: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The rows of ``with_captures`` with ``fetch_error``, and html only of pages that can be read."""
    error = content.fetch_error(rows.withColumn("url", F.col("final_url")), settings=settings)
    marked = rows.withColumn("fetch_error", F.when(~F.col("captured"), LATE).otherwise(error))
    return marked.select("analysis_id", "url", "ts", "final_url", "hop_status", "hop_error", "status_code", "fetch_error", F.when(F.col("fetch_error").isNull(), F.col("html")).alias("html"))


def scored(rows: DataFrame, brands: Brands, settings: Settings = SETTINGS) -> DataFrame:
    """analysis_id, final_url, fetch_error, domain_score, content_signals, content_score, score, verdict of classified rows."""
    own = domain.score_domains(rows.select(F.col("final_url").alias("_url")).distinct(), brands, url="_url", settings=settings).select("_url", "domain_score")
    made = content.score_features(html.features(rows, "html", "final_url"), brands, url="final_url", settings=settings)
    made = made.join(own, made["final_url"] == own["_url"], "left")
    read = F.col("fetch_error").isNull()
    made = made.withColumn("content_score", F.when(read, F.col("content_score")).otherwise(content.failed_score(F.col("fetch_error"), settings)))
    made = made.withColumn("content_signals", F.when(read, F.col("content_signals")).otherwise(F.array(F.lit("FETCH_FAILED"))))
    score = verdict.total_score(F.coalesce("domain_score", F.lit(0)), F.lit(0), F.col("content_score"), F.lit(False), settings)
    made = made.withColumn("score", score)
    return made.select("analysis_id", "final_url", "fetch_error", "domain_score", "content_signals", "content_score", "score", verdict.verdict(F.col("score"), F.lit(False), settings).alias("verdict"))


def score_awaited(requests: DataFrame, hops: DataFrame, pages: DataFrame, brands: Brands, out: str, checkpoint: str, every: str | None = None, **bounds: str) -> StreamingQuery:
    """Writes the verdicts of requests once their captures have come, or their time is over, by batch id.

    A batch that is run again after a failure overwrites its own folder. Its rows are written to the shared folder first, as
    scoring reads them twice and the joins' state must move on once; that table is dropped when the verdicts are written.
    """

    def write(batch: DataFrame, number: int) -> None:
        with dropped_at_end(batch.sparkSession):
            rows = written(classified(batch), "awaited")
            if not rows.isEmpty():
                scored(rows, brands).write.mode("overwrite").parquet(f"{out}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    stream = with_captures(requests, hops, pages, **bounds)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
