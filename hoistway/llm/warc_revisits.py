"""Not-modified revisit resolution over WARC records.

A revisit record says that the server answered 304 to a conditional request. It is resolved against the latest earlier full response of the
same canonical URL (an as-of join on (date, record id)): if the validators that both carry agree, the response's payload stands for the
revisit, and the response's headers are merged with those fields that a 304 may update. If they disagree, or there is no validator in common or no
earlier response, the revisit stays unresolved and says why; no older response is tried.

Plan: the as-of join is a running last() over (URL, hour, date, id), so that even a URL with a third of all rows is split by hour; an hour whose first
revisit comes before its first response takes the last response of an earlier hour, found by a second running last() over one
row for each URL and hour. Only ids, dates and headers pass the windows; payloads are joined afterwards by the response's id, if asked for.

Defined results: a null URL or date matches nothing (status no_original); repeated records each get a row; equal dates are ordered by record id;
header names compare without case and come out in lower case; the last of repeated fields counts. Columns other than those of RECORD are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = "record_id long, warc_type string, target_uri string, date timestamp, headers map<string,string>"
#: Fields that a 304 response updates (RFC 9110, 15.4.5).
MERGED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and leading www./m. dropped, host in lower case, default port, fragment, tracking parameters and a closing slash removed."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    path = F.regexp_replace(path, r"([?&])(utm_[a-z]+|ref)=[^&]*", r"$1")
    path = F.regexp_replace(F.regexp_replace(path, r"&+", "&"), r"\?&", "?")
    path = F.regexp_replace(F.regexp_replace(path, r"[?&]+$", ""), r"/+$", "")
    return F.concat(host, path)


def _etag(headers: Column) -> Column:
    """Weak comparison: without W/."""
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """A row for each revisit: record_id, canonical_url, date, response_id, status, headers (merged where resolved, else its own)."""
    r = records.select("record_id", "warc_type", canonical_url(F.col("target_uri")).alias("url"), "date", _lower_names(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))).alias("headers")).where(F.col("warc_type").isin("response", "revisit"))
    r = r.withColumn("hour", F.floor(F.unix_seconds("date") / 3600))
    full = F.when((F.col("warc_type") == "response") & F.col("date").isNotNull(), F.struct("record_id", "headers"))
    known = r.where(F.col("url").isNotNull() & F.col("date").isNotNull())
    within = Window.partitionBy("url", "hour").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = known.withColumn("same_hour", F.last(full, ignorenulls=True).over(within)).where("warc_type = 'revisit'")
    hours = known.where("warc_type = 'response'").groupBy("url", "hour").agg(F.max_by(F.struct("record_id", "headers"), F.struct("date", "record_id")).alias("last"))
    wanted = seen.where("same_hour IS NULL").select("url", "hour").distinct()
    line = hours.select("url", "hour", "last").unionByName(wanted.withColumn("last", F.lit(None).cast(hours.schema["last"].dataType)))
    line = line.withColumn("earlier", F.last("last", ignorenulls=True).over(Window.partitionBy("url").orderBy("hour").rangeBetween(Window.unboundedPreceding, -1)))
    carried = line.where("last IS NULL AND earlier IS NOT NULL").select("url", "hour", "earlier")
    joined = seen.join(carried, ["url", "hour"], "left").withColumn("original", F.coalesce("same_hour", "earlier"))
    lost = r.where("warc_type = 'revisit' AND (url IS NULL OR date IS NULL)").withColumn("original", F.lit(None).cast(joined.schema["original"].dataType))
    cols = ["record_id", "url", "date", "headers", "original"]
    return _checked(joined.select(cols).unionByName(lost.select(cols)))


def _lower_names(headers: Column) -> Column:
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def _checked(found: DataFrame) -> DataFrame:
    own, old = F.col("headers"), F.col("original.headers")
    by_etag = _etag(own) == _etag(old)
    by_date = own["last-modified"] == old["last-modified"]
    status = (
        F.when(F.col("original").isNull(), "no_original")
        .when(by_etag.isNotNull(), F.when(by_etag, "resolved").otherwise("validator_mismatch"))
        .when(by_date.isNotNull(), F.when(by_date, "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )
    updates = F.map_filter(own, lambda k, _: k.isin(*MERGED))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(updates, k), F.lit(False)))
    out = found.withColumn("status", status)
    return out.select(
        "record_id",
        F.col("url").alias("canonical_url"),
        "date",
        F.when(F.col("status") == "resolved", F.col("original.record_id")).alias("response_id"),
        "status",
        F.when(F.col("status") == "resolved", F.map_concat(kept, updates)).otherwise(own).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """The resolved revisits with the payload of the response that each stands for; payloads move once."""
    return resolved.join(records.where("warc_type = 'response'").select(F.col("record_id").alias("response_id"), payload), "response_id", "left")


def header_text(headers: Column) -> Column:
    """Headers as lines "name: value" in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def pages_as_records(pages: DataFrame) -> DataFrame:
    """Pages as a crawl, one capture a minute in the order of page_id: captures whose URL has a fragment or the feed's marker repeat a request with
    validators and were answered 304, all others are full responses. A resource changes every 10,000 captures, which its entity tag tells; every
    seventh capture has no entity tag, only a date of change."""
    url, n = canonical_url(F.col("url")), F.floor(F.col("page_id") / 10_000)
    revisit = F.col("url").contains("#") | F.col("url").contains("utm_source=feed")
    tag = F.concat(F.when(F.col("page_id") % 3 == 0, 'W/"').otherwise('"'), F.substring(F.md5(F.concat_ws("/", url, n)), 1, 12), F.lit('"'))
    named = {
        "Content-Type": F.when(~revisit, "text/html"),
        "Content-Length": F.when(~revisit, F.octet_length("html").cast("string")),
        "Date": F.col("page_id").cast("string"),
        "ETag": F.when(F.col("page_id") % 7 != 0, tag),
        "Last-Modified": F.concat(F.lit("v"), n.cast("string")),
        "Server": F.concat(F.lit("s"), (F.col("page_id") % 5).cast("string")),
    }
    fields = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in named.items()]), lambda e: e["v"].isNotNull()))
    return pages.select(
        F.col("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60).alias("date"),
        fields.alias("headers"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest, page_id // 10000 AS n,
    contains(url, '#') OR contains(url, 'utm_source=feed') AS revisit FROM pages),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*(.*)$', 1),
      '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+$', '') AS cu FROM p),
c AS (
  SELECT *, CASE WHEN page_id % 7 <> 0 THEN '"' || substr(md5(cu || '/' || n), 1, 12) || '"' END AS tag,
    CASE WHEN page_id % 3 = 0 THEN 'W/' ELSE '' END AS weak FROM u),
j AS (
  SELECT v.page_id, v.cu, v.n, v.tag, v.weak, (SELECT max(r.page_id) FROM c r WHERE r.cu = v.cu AND NOT r.revisit AND r.page_id < v.page_id) AS o
  FROM c v WHERE v.revisit),
s AS (
  SELECT j.*, r.tag AS otag, r.weak AS oweak, r.n AS on_, strlen(r.html) AS len, r.page_id AS rid,
    CASE WHEN o IS NULL THEN 'no_original' WHEN j.tag = r.tag THEN 'resolved' WHEN j.tag <> r.tag THEN 'validator_mismatch'
      WHEN j.n = r.n THEN 'resolved' ELSE 'validator_mismatch' END AS status
  FROM j LEFT JOIN c r ON r.page_id = j.o)
SELECT page_id AS record_id, cu AS canonical_url, CASE WHEN status = 'resolved' THEN rid END AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'content-length: ' || len || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id || chr(10)
      || coalesce('etag: ' || coalesce(weak || tag, oweak || otag) || chr(10), '') || 'last-modified: v' || on_ || chr(10) || 'server: s' || (rid % 5)
    ELSE 'date: ' || page_id || chr(10) || coalesce('etag: ' || weak || tag || chr(10), '') || 'last-modified: v' || n || chr(10) || 'server: s' || (page_id % 5) END AS headers
FROM s
"""
