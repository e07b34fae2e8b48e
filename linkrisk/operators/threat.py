"""Threat lists: feed refresh and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.functions import urls
from linkrisk.functions.shared import written
from linkrisk.operators import sketch
from linkrisk.sources.captures import newest

ENTRY = ["id", "url", "host", "match_key", "threat", "tags", "url_status", "date_added", "last_online", "urlhaus_link", "reporter"]


def feed_time(text: Column) -> Column:
    """The feed's two time formats; null for blank, ``None``, ``N/A`` or anything else."""
    t = F.trim(text)
    shaped = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}( UTC)?$")
    return F.when(shaped, F.regexp_replace(t, " UTC$", "").try_cast("timestamp_ntz"))


def tag_list(tags: Column) -> Column:
    """Comma-separated tags, trimmed, without blanks; [] for null."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def entries(feed: DataFrame) -> DataFrame:
    """Feed rows (nine text columns, ``line_no``, ``short``) as snapshot rows with ``failed``.

    A row fails if it is short, its id is no whole number, its url is empty or has no match key.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    df = feed.withColumn("_id", F.trim("id").try_cast("bigint")).withColumn("match_key", urls.match_key(F.col("url")))
    failed = F.col("short") | F.col("_id").isNull() | (F.coalesce(F.col("url"), F.lit("")) == "") | F.col("match_key").isNull()
    return df.select(
        F.col("_id").alias("id"),
        "url",
        urls.host_of(F.col("url")).alias("host"),
        "match_key",
        *[blank(c).alias(c) for c in ("threat", "tags", "url_status")],
        feed_time(F.col("dateadded")).alias("date_added"),
        feed_time(F.col("last_online")).alias("last_online"),
        *[blank(c).alias(c) for c in ("urlhaus_link", "reporter")],
        "line_no",
        F.coalesce(failed, F.lit(True)).alias("failed"),
    )


def latest(rows: DataFrame) -> DataFrame:
    """One row per id, the last of the batch; pre-aggregated, so a repeated id is no hot spot."""
    columns = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "line_no").alias("_row")).select("id", "_row.*")


def upsert(snapshot: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, stats) after a feed batch; stats: inserted, updated, total, failed (ids count once).

    An id in both has the batch's row. Of several ids with one url the largest keeps it and the others are left out.
    """
    rows = entries(feed)
    good = latest(rows.where(~F.col("failed"))).select(*ENTRY)
    merged = snapshot.select(*ENTRY).join(good.select("id"), "id", "left_anti").unionByName(good)
    owner = merged.groupBy("url").agg(F.max("id").alias("id"))
    new = merged.join(owner.select("id"), "id", "left_semi")
    known = good.join(snapshot.select("id", F.lit(1).alias("_known")), "id", "left")
    changes = known.agg(F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if(F.col("_known").isNotNull()).alias("updated"))
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"))
    return new, changes.crossJoin(totals)  # one row each


def by_match_key(snapshot: DataFrame) -> DataFrame:
    """One row per match key: the one with the largest id."""
    columns = [c for c in snapshot.columns if c != "match_key"]
    return snapshot.groupBy("match_key").agg(F.max_by(F.struct(*columns), "id").alias("_row")).select("match_key", "_row.*")


def canonical(url: Column) -> Column:
    """The URL without http(s) scheme and trailing slashes of its path: equal for all variants of one URL."""
    bare = F.regexp_replace(url, "^(?i)https?://", "//")
    return F.regexp_replace(bare, r"/+(?=$|[?#])", "")


def hits(candidates: DataFrame, snapshot: DataFrame, key: str = "url", filtered: bool = True) -> DataFrame:
    """(``key``, match_type, matched_key, threat, tags, urlhaus_link) of the distinct listed URLs in ``candidates``.

    An exact hit on any URL variant wins, by the variants' order; else the match key's row. Both sides meet on one canonical
    key (no explosion into variants), and the hit is then checked to be one of the URL's variants. Most URLs are listed
    nowhere: a Bloom filter of the list's canonical and match keys leaves them out before anything is shuffled.
    """
    rows = candidates.select(F.col(key).alias("u")).where("u is not null")
    rows = rows.withColumn("canon", canonical(F.col("u"))).withColumn("mk", urls.match_key(F.col("u")))
    if filtered:
        found = sketch.build(snapshot, {"canon": canonical(F.col("url")), "mk": F.col("match_key")})
        rows = sketch.may_hold(rows, {"canon": F.col("canon"), "mk": F.col("mk")}, found)
    rows = written(rows.distinct(), "candidates")  # they are read twice, and their keys are dear
    listed = snapshot.select(canonical(F.col("url")).alias("canon"), F.struct(F.col("url").alias("matched"), "threat", "tags", "urlhaus_link").alias("hit"))
    met = rows.join(listed, "canon").withColumn("place", F.array_position(urls.url_variants(F.col("u")), F.col("hit.matched"))).where("place > 0")
    exact = met.groupBy("u").agg(F.min_by("hit", "place").alias("exact"))
    keyed = by_match_key(snapshot.select("id", "match_key", "threat", "tags", "urlhaus_link"))
    keyed = keyed.select(F.col("match_key").alias("mk"), F.struct(F.col("match_key").alias("matched"), "threat", "tags", "urlhaus_link").alias("keyed"))
    rows = rows.join(exact, "u", "left").join(keyed, "mk", "left")
    hit = F.coalesce("exact", "keyed")
    kind = F.when(F.col("exact").isNotNull(), "url").when(F.col("mk").contains("/"), "host_path").otherwise("host")
    return rows.where(hit.isNotNull()).select(
        F.col("u").alias(key),
        kind.alias("match_type"),
        hit["matched"].alias("matched_key"),
        hit["threat"].alias("threat"),
        tag_list(hit["tags"]).alias("tags"),
        hit["urlhaus_link"].alias("urlhaus_link"),
    )


def lookup(candidates: DataFrame, snapshot: DataFrame, key: str = "url") -> DataFrame:
    """(``key``, is_threat and ``hits``' columns) of the distinct URLs in ``candidates``, listed or not."""
    rows = candidates.select(key).where(F.col(key).isNotNull()).distinct()
    out = rows.join(hits(rows, snapshot, key), key, "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return out.select(key, F.col("match_type").isNotNull().alias("is_threat"), "match_type", "matched_key", "threat", tags.alias("tags"), "urlhaus_link")


def safe_browsing(pairs: DataFrame, captures: DataFrame) -> DataFrame:
    """Per (final_url, original_url): gsb_checked, gsb_threat, gsb_types and gsb_error over both URLs, the final one first.

    URLs without capture are unchecked. The error is the first one, and only where nothing was checked.
    """
    one = newest(captures, "url").select("url", F.struct("checked", "error", F.col("matches.threat_type").alias("types")).alias("_capture"))
    rows = pairs.select("final_url", "original_url").where("final_url is not null or original_url is not null").distinct()
    for name in ("final_url", "original_url"):
        rows = rows.join(one.select(F.col("url").alias(name), F.col("_capture").alias(f"_{name}")), name, "left")
    first = F.col("_final_url")
    second = F.when(~F.col("final_url").eqNullSafe(F.col("original_url")), F.col("_original_url"))
    none = F.array().cast("array<string>")
    checked = F.coalesce(first["checked"], F.lit(False)) | F.coalesce(second["checked"], F.lit(False))
    types = F.concat(F.coalesce(first["types"], none), F.coalesce(second["types"], none))
    return rows.select(
        "final_url",
        "original_url",
        checked.alias("gsb_checked"),
        (F.size(types) > 0).alias("gsb_threat"),
        F.array_distinct(F.filter(types, lambda t: F.coalesce(t, F.lit("")) != "")).alias("gsb_types"),
        F.when(~checked, F.coalesce(first["error"], second["error"])).alias("gsb_error"),
    )


def check(pairs: DataFrame, snapshot: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Both sources for each (final_url, original_url): is_malicious, sources_checked, threat_types and the list match.

    The list is asked for the final URL first, then for the original one.
    """
    rows = pairs.select("final_url", "original_url").distinct()
    found = written(hits(rows.select(F.explode(F.array_distinct(F.array("final_url", "original_url"))).alias("url")), snapshot), "hits")
    hit = lambda name: found.select(F.col("url").alias(name), F.struct("match_type", "matched_key", "threat", "tags", "urlhaus_link").alias(f"_{name}"))
    rows = rows.join(hit("final_url"), "final_url", "left").join(hit("original_url"), "original_url", "left")
    rows = rows.withColumn("list", F.coalesce("_final_url", "_original_url")).drop("_final_url", "_original_url")
    if captures is not None:
        rows = rows.join(safe_browsing(pairs, captures), ["final_url", "original_url"], "left")
    else:
        rows = rows.withColumns({"gsb_checked": F.lit(False), "gsb_threat": F.lit(False), "gsb_types": F.array().cast("array<string>"), "gsb_error": F.lit(None).cast("string")})
    types = F.concat("gsb_types", F.when(F.coalesce(F.col("list.threat"), F.lit("")) != "", F.array("list.threat")).otherwise(F.array().cast("array<string>")))
    return rows.select(
        "final_url",
        "original_url",
        (F.col("gsb_threat") | F.col("list").isNotNull()).alias("is_malicious"),
        (F.lit(1) + F.col("gsb_checked").cast("int")).alias("sources_checked"),
        F.array_distinct(types).alias("threat_types"),
        "gsb_threat",
        "gsb_types",
        "gsb_error",
        F.col("list").isNotNull().alias("list_threat"),
        "list.match_type",
        "list.matched_key",
    )
