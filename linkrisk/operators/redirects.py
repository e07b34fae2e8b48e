"""Redirect chains over captured hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.dims import SETTINGS, Settings
from linkrisk.functions import urls
from linkrisk.functions.shared import written
from linkrisk.operators import blocks

REDIRECTS = [301, 302, 303, 307, 308]
SCHEMES = ["http", "https", "ftp"]
HOP = "struct<url: string, status_code: int, raw_location: string, location: string, method: string>"


def answers(hops: DataFrame) -> DataFrame:
    """One answer per URL: HEAD, or GET where HEAD has no status, 400, 403 or 405, or redirects without a location.

    A URL whose GET is needed but was not captured has no answer.
    """
    methods = {
        m: F.max(F.when(F.col("method") == m, F.struct("status_code", "raw_location", "error")))
        for m in ("HEAD", "GET")
    }
    rows = hops.groupBy("url").agg(*[c.alias(m) for m, c in methods.items()])
    head = F.col("HEAD")
    retry = (
        head.isNull()
        | head["status_code"].isNull()
        | head["status_code"].isin(400, 403, 405)
        | (head["status_code"].isin(REDIRECTS) & (F.coalesce(head["raw_location"], F.lit("")) == ""))
    )
    picked = F.when(retry, F.col("GET")).otherwise(head)
    return rows.where(picked.isNotNull()).select("url", picked["status_code"].alias("status_code"), picked["raw_location"].alias("raw_location"), picked["error"].alias("error"), F.when(retry, "GET").otherwise("HEAD").alias("method"))


def unsafe_hosts(dns: DataFrame) -> DataFrame:
    """(host, blocked): whether any address that a host resolves to is local or no address at all."""
    known = blocks.with_kind(dns.select("host", "ip"), "ip", blocks.special_blocks(dns.sparkSession))
    return known.groupBy("host").agg(F.bool_or(F.coalesce(F.col("kind") == "local", F.lit(True))).alias("blocked"))


def preferred(rows: DataFrame, hops: DataFrame, added: str = "scheme_was_added", url: str = "url") -> DataFrame:
    """``rows`` with ``start``: the https form of URLs whose scheme was added, where that answers with HTML (2xx or 3xx)."""
    good = hops.where("method = 'HEAD' and status_code >= 200 and status_code < 400 and contains(lower(content_type), 'text/html')")
    good = good.select(F.col("url").alias("_https")).distinct().withColumn("_ok", F.lit(True))
    df = rows.withColumn("_https", F.when(F.col(added), urls.https_variant(F.col(url))))
    df = df.join(good, "_https", "left")
    return df.withColumn("start", F.when(F.col("_ok"), F.col("_https")).otherwise(F.col(url))).withColumn("upgraded", F.coalesce("_ok", F.lit(False))).drop("_https", "_ok")


def _end(signal: Column | None, error: Column | None, hop: bool) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return F.struct(text(signal).alias("signal"), text(error).alias("error"), F.lit(hop).alias("hop"))


def edges(hops: DataFrame) -> DataFrame:
    """(_u, a) per answered URL: where a chain that comes there goes, or how it ends, whatever it has visited before.

    Made once for all rows and rounds, so that a round only joins: locations are resolved here, not wherever a row walks.
    """
    status, raw, url = F.col("status_code"), F.col("raw_location"), F.col("url")
    df = answers(hops)
    location = F.when(status.isin(REDIRECTS) & (F.coalesce(raw, F.lit("")) != ""), urls.resolve(url, raw))
    df = df.withColumn("_next", location).withColumn("_to", urls.host_of(F.col("_next"))).withColumn("_from", urls.host_of(url))
    there = F.col("_next").isNotNull()
    df = df.withColumn("_scheme", F.when(there, F.lower(F.regexp_extract("_next", r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))))
    unsafe = there & ~F.coalesce(F.col("_scheme"), F.lit("")).isin(SCHEMES)
    stop = (
        F.when(status.isNull(), _end(None, F.coalesce("error", F.lit("dns_failure")), False))
        .when(status >= 500, _end(None, F.concat(F.lit("server_error_"), status.cast("string")), True))
        .when(status.isin(REDIRECTS) & ~there, _end(None, F.lit("missing_location_header"), True))
        .when(unsafe, _end(F.concat(F.lit("unsafe_scheme:"), F.col("_scheme")), F.concat(F.lit("unsafe_redirect_scheme:"), F.col("_scheme")), True))
        .when(~there, _end(None, None, True))
    )
    df = df.withColumn("stop", stop)
    goes = F.col("stop").isNull()
    down = goes & (urls.scheme_of(url) == "https") & (F.col("_scheme") == "http")
    crossed = goes & urls.domain_changed(F.col("_from"), F.col("_to"))
    crossing = F.concat(F.lit("cross_origin:"), F.col("_from"), F.lit("->"), F.col("_to"))
    signals = F.array_compact(F.array(F.when(down, "scheme_downgrade"), F.when(crossed, crossing)))
    made = F.struct("status_code", F.when(there, raw).alias("raw_location"), F.col("_next").alias("next"), "method", F.col("_from").alias("host"), "stop", signals.alias("signals"))
    return df.select(url.alias("_u"), made.alias("a"))


def _follow(df: DataFrame) -> DataFrame:
    """One hop for each row, given its edge in ``a`` (null without an answer) and its host in ``_h``."""
    a, cur, host = F.col("a"), F.col("cur"), F.col("_h")
    late = F.lit("pipeline_timeout")
    stop = (
        F.when(F.array_contains("visited", cur), _end(F.lit("redirect_loop"), None, False))
        .when(host == "", _end(None, F.lit("invalid_host"), False))
        .when(F.coalesce("blocked", urls.is_local_ipv4(host)), _end(F.lit("ssrf_blocked"), F.lit("ssrf_blocked"), False))
        .when(a.isNull(), _end(late, late, False))
        .otherwise(a["stop"])
    )
    df = df.withColumn("_stop", stop)
    goes = F.col("_stop").isNull()
    hop = F.struct(cur.alias("url"), a["status_code"].alias("status_code"), a["raw_location"].alias("raw_location"), a["next"].alias("location"), a["method"].alias("method"))
    new_signals = F.when(goes, a["signals"]).otherwise(F.array_compact(F.array(F.col("_stop.signal"))))
    return df.select(
        "id",
        "url",
        F.when(goes, a["next"]).otherwise(cur).alias("cur"),
        F.when(goes | F.col("_stop.hop"), F.concat("hops", F.array(hop.cast(HOP)))).otherwise(F.col("hops")).alias("hops"),
        F.concat("visited", F.array(cur)).alias("visited"),
        F.concat("signals", new_signals).alias("signals"),
        F.col("_stop.error").alias("error"),
        goes.alias("alive"),
    )


def unchain(starts: DataFrame, hops: DataFrame, dns: DataFrame | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """Per distinct (start, upgraded) in ``starts``: final_url, hops, hop_count, timed_out, error and signals.

    At most ``max_hops`` rounds, each a join of the rows that still walk on their current URL; rows whose chain has ended are
    put aside. Each round is written to the shared folder, which keeps plans short. A URL without captured answer ends its chain as a request that ran out of time. ``dns`` (host, ip) blocks hosts that resolve to local addresses.
    """
    known = written(edges(hops), "answers")
    blocked = written(unsafe_hosts(dns).withColumnRenamed("host", "_h"), "hosts") if dns is not None else None
    df = starts.select("start", "upgraded").distinct()
    df = df.select(
        F.col("upgraded").alias("id"),
        F.col("start").alias("url"),
        F.col("start").alias("cur"),
        F.array().cast(f"array<{HOP}>").alias("hops"),
        F.array().cast("array<string>").alias("visited"),
        F.when(F.col("upgraded"), F.array(F.lit("schemeless_https_upgrade"))).otherwise(F.array().cast("array<string>")).alias("signals"),
    )
    ended = []
    for _ in range(settings.max_hops):
        df = df.withColumn("_u", F.col("cur")).join(known, "_u", "left").withColumn("_h", F.coalesce("a.host", urls.host_of(F.col("cur"))))
        if blocked is not None:
            df = df.join(blocked, "_h", "left")
        else:
            df = df.withColumn("blocked", F.lit(None).cast("boolean"))
        step = written(_follow(df), "hops")
        ended.append(step.where("not alive"))
        df = step.where("alive")
    for part in ended:
        df = df.unionByName(part)
    over = F.when(F.col("alive"), F.array(F.lit("max_hops_reached"))).otherwise(F.array().cast("array<string>"))
    return df.select(
        F.col("url").alias("start"),
        F.col("id").alias("upgraded"),
        F.col("cur").alias("final_url"),
        "hops",
        F.size("hops").alias("hop_count"),
        F.coalesce(F.col("error") == "timeout", F.lit(False)).alias("timed_out"),
        "error",
        F.concat("signals", over).alias("chain_signals"),
    )


def crosses(signals: Column) -> Column:
    return F.exists(signals, lambda s: s.startswith("cross_origin:"))


def without_blocked(rows: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """The rows whose host is neither blocked by name or address nor resolves to a local address."""
    bad = unsafe_hosts(dns).where("blocked").select(F.col("host").alias("_h"))
    df = rows.withColumn("_h", urls.host_of(F.col(url))).where(~urls.is_blocked_host(F.col("_h")))
    return df.join(bad, "_h", "left_anti").drop("_h")
