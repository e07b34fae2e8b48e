"""Look-ups shared while they run: one question for a domain, and its answer for every request that waits or comes in time.

Requests and answers are one stream, keyed by domain. State of a domain: when its running look-up was asked, the requests
that wait (a list, which the state store keeps on disk), and the last good answer. A look-up that is not answered within
``patience`` is given up, and a good answer serves requests for ``keep``; both are event-time timers, so state goes when its time is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkrisk.dims import SETTINGS, Settings
from linkrisk.functions import urls

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind "ask": a look-up to make; "answer": a request's answer, or why there is none.
EVENTS = "domain string, kind string, analysis_id string, ts timestamp, fetched_at timestamp, body string, error string"
GIVEN_UP = "pipeline_timeout"


def use_rocksdb(spark: SparkSession) -> None:
    """Keeps streaming state on disk; processors with timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def millis(t: datetime) -> int:
    """A time as the row holds it (of the session's zone, UTC) in milliseconds."""
    return int(t.replace(tzinfo=t.tzinfo or timezone.utc).timestamp() * 1000)


class SharedLookups(StatefulProcessor):
    def __init__(self, keep: timedelta, patience: timedelta):
        self.keep, self.patience = int(keep.total_seconds() * 1000), int(patience.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "asked long")
        self.waiting = handle.getListState("waiting", "analysis_id string, ts long")
        self.known = handle.getValueState("known", "fetched long, body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        domain, answer = key[0], None
        # whatever the order of a batch's rows: requests wait first, then the newest answer is given to those it serves
        for r in rows:
            if r["kind"] == "request":
                self.waiting.appendValue((r["analysis_id"], millis(r["ts"])))
            elif answer is None or (millis(r["ts"]), r["error"] is None, r["body"] or "") > answer[:3]:
                answer = (millis(r["ts"]), r["error"] is None, r["body"] or "", r["error"])
        if answer:
            at, good, body, error = answer
            self.running.clear()
            if good:
                self.remember(at, body)
            else:
                yield from self.release(domain, lambda ts: ts <= at, None, None, error)
        if self.known.exists():
            at, body = self.known.get()
            yield from self.release(domain, lambda ts: at > ts - self.keep, at, body, None)
        yield from self.ask(domain)

    def remember(self, at: int, body: str) -> None:
        if not self.known.exists() or at > self.known.get()[0]:
            self.known.update((at, body))
            self.handle.registerTimer(at + self.keep)

    def release(self, domain: str, serves, at: int | None, body: str | None, error: str | None) -> Iterator[Row]:
        """Answers for the waiting requests that are served; the others go on waiting."""
        if not self.waiting.exists():
            return
        left = []
        for analysis_id, ts in self.waiting.get():
            if serves(ts):
                yield self.event(domain, "answer", analysis_id, ts, at, body, error)
            else:
                left.append((analysis_id, ts))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()

    def ask(self, domain: str) -> Iterator[Row]:
        """A question, if requests wait and none is running."""
        if self.waiting.exists() and not self.running.exists():
            first = min(ts for _, ts in self.waiting.get())
            self.running.update((first,))
            self.handle.registerTimer(first + self.patience)
            yield self.event(domain, "ask", None, first, None, None, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.known.exists() and self.known.get()[0] + self.keep <= now:
            self.known.clear()
        if self.running.exists() and self.running.get()[0] + self.patience <= now:
            self.running.clear()
            yield from self.release(key[0], lambda ts: ts <= now, None, None, GIVEN_UP)
            # what came later than this question's patience needs a question of its own
            yield from self.ask(key[0])

    @staticmethod
    def event(domain, kind, analysis_id, ts, at, body, error) -> Row:
        time = lambda ms: None if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
        return Row(domain=domain, kind=kind, analysis_id=analysis_id, ts=time(ts), fetched_at=time(at), body=body, error=error)

    def close(self) -> None:
        pass


def shared_lookups(
    requests: DataFrame, answers: DataFrame, late: str = "1 hour", patience: timedelta = timedelta(minutes=10), settings: Settings = SETTINGS
) -> DataFrame:
    """The stream of look-ups to make (kind "ask") and of the requests' answers (kind "answer"), by domain.

    ``requests``: analysis_id, url, ts. ``answers``: domain, fetched_at, body, error. Each domain has one running look-up at
    most. A good answer serves all requests that wait and those that come within ``lookup_days`` of it; an error serves those
    that wait and is not kept; without any answer within ``patience`` the waiting requests get ``pipeline_timeout``. Rows later
    than the watermark (``late``) are dropped; requests without host need no look-up and are left out.
    """
    domain = urls.registered_or_host(urls.host_of(F.col("url")))
    text = F.lit(None).cast("string")
    asked = requests.select(domain.alias("domain"), F.lit("request").alias("kind"), "analysis_id", "ts", text.alias("body"), text.alias("error"))
    told = answers.select("domain", F.lit("answer").alias("kind"), text.alias("analysis_id"), F.col("fetched_at").alias("ts"), "body", "error")
    both = asked.unionByName(told).where("domain <> ''").withWatermark("ts", late)
    processor = SharedLookups(timedelta(days=settings.lookup_days), patience)
    return both.groupBy("domain").transformWithState(processor, EVENTS, "append", "eventtime")
