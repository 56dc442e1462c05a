"""WARC records, and the resolution of not-modified revisits.

A revisit stands for a capture whose server answered "not modified", so the
record has no payload.  It is resolved by an as-of join: to the latest earlier
full response of the same canonical URL.  Its validators must agree with that
response's, and the stored headers are then freshened by the revisit's, but for
those that describe the connection or the stored payload.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket of the as-of join.
BUCKET_SECONDS = 86_400
#: Header fields that a not-modified answer doesn't change in the stored response.
KEPT_FIELDS = [
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
]
RECORD_SCHEMA = "record_id string, kind string, url string, captured long, status int, headers map<string,string>, payload binary"


def _header_block(lines: list[bytes], joined: bool = False) -> dict[str, str]:
    """Fields by lower-case name; of a repeated one the last value, or all if ``joined``: after commas, cookies on lines of their own."""
    found: dict[str, str] = {}
    last = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            found[last] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            earlier = found[last] + ("\n" if last == "set-cookie" else ", ") if joined and last in found else ""
            found[last] = earlier + value.strip()
    return found


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzip (one member or many): a dict with RECORD_SCHEMA's names each.

    A record whose block is cut off, and anything after it, is left out.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        head = _header_block(data[at:stop].split(b"\r\n")[1:])
        size = int(head.get("content-length", "0") or 0)
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            return
        at = stop + 4 + size
        status, fields, payload = None, {}, block
        if "application/http" in head.get("content-type", "") and block[:5] == b"HTTP/":
            top, _, payload = block.partition(b"\r\n\r\n")
            lines = top.split(b"\r\n")
            words = lines[0].split()
            status, fields = int(words[1]) if len(words) > 1 and words[1].isdigit() else None, _header_block(lines[1:], joined=True)
        yield {"record_id": head.get("warc-record-id"), "kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "status": status, "headers": fields, "payload": payload}


def write_warc(records: list[dict]) -> bytes:
    """The inverse of parse_warc: one gzip member per record."""
    out = []
    for r in records:
        block = r["payload"] or b""
        if r.get("status") is not None:
            fields = "".join(f"{k}: {line}\r\n" for k, v in (r["headers"] or {}).items() for line in v.split("\n"))
            block = f"HTTP/1.1 {r['status']} -\r\n{fields}\r\n".encode() + block
        kind = "application/http; msgtype=response" if r.get("status") is not None else "application/octet-stream"
        head = f"WARC/1.1\r\nWARC-Type: {r['kind']}\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Target-URI: {r['url']}\r\nWARC-Date: {r['date']}\r\nContent-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n"
        out.append(gzip.compress(head.encode() + block + b"\r\n\r\n"))
    return b"".join(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files at ``path``, read by Spark's binary source."""

    def rows(parts: Iterator) -> Iterator:
        import pandas as pd

        for part in parts:
            for content in part["content"]:
                found = pd.DataFrame(list(parse_warc(content)), columns=["record_id", "kind", "url", "date", "status", "headers", "payload"])
                found["status"] = found["status"].astype("Int32")
                yield found

    raw = spark.read.format("binaryFile").load(path).select("content")
    made = raw.mapInPandas(rows, "record_id string, kind string, url string, date string, status int, headers map<string,string>, payload binary")
    return made.select("record_id", "kind", "url", F.try_to_timestamp("date").cast("long").alias("captured"), "status", "headers", "payload")


def canonical_url(url: Column) -> Column:
    """A URL's key: host in lower case without "www." and default port, path without its last slash, sorted query without tracking parameters.

    Scheme, user part and fragment don't count.  Null stays null; a text that isn't an absolute URL is its own key.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    pattern = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)[?]?(.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, pattern, 2)), "^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)?$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(plain, pattern, 3), "/$", "")
    kept = F.filter(F.split(F.regexp_extract(plain, pattern, 4), "&"), lambda x: (x != "") & ~x.rlike("^(utm_|fbclid=|gclid=|sessionid=)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(plain.rlike(pattern), F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).otherwise(plain)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: (record_id, canonical, captured, outcome, response_id, payload_digest, payload_bytes, merged_headers).

    ``records``: record_id, kind ('response' or 'revisit'), url, captured (seconds),
    status, headers (map, lower-case names), payload_digest, payload_bytes.  A full
    response is a 'response' with status 200.  "Earlier" is by (captured, record_id).

    outcome: 'resolved'; 'validator_mismatch' (the revisit's ETag, or lacking that
    its Last-Modified, differs from the response's); 'no_earlier_response', also
    for a null URL or time.  A revisit without validators takes the response.
    Unless resolved, the last four columns are null.

    The as-of join has two levels, so that one URL with a large share of all
    rows is dealt out by time: inside (URL, time bucket) a window looks back;
    the last response of each bucket, one row a bucket, is carried to later ones.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("captured").isNotNull()
    rows = records.select(
        "record_id", "kind", "captured", "headers",
        canonical_url(F.col("url")).alias("canonical"),
        F.floor(F.col("captured") / bucket_seconds).alias("bucket"),
        F.when(full, F.struct("captured", "record_id", "headers", "payload_digest", "payload_bytes")).alias("response"),
    ).filter((F.col("kind") == "revisit") | F.col("response").isNotNull())
    keyed = rows.filter(F.col("canonical").isNotNull() & F.col("captured").isNotNull())
    before = Window.partitionBy("canonical", "bucket").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("near", F.last("response", ignorenulls=True).over(before)).filter(F.col("kind") == "revisit").drop("response")

    responses = keyed.filter(F.col("response").isNotNull())
    lasts = responses.groupBy("canonical", "bucket").agg(F.max_by("response", F.struct("captured", "record_id")).alias("last"))
    asked = keyed.select("canonical", "bucket").distinct().join(lasts, ["canonical", "bucket"], "left")
    earlier = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.select("canonical", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("far"))

    met = near.join(carried, ["canonical", "bucket"], "left").withColumn("stored", F.coalesce("near", "far"))
    lost = rows.filter((F.col("kind") == "revisit") & (F.col("canonical").isNull() | F.col("captured").isNull()))
    lost = lost.select("canonical", "record_id", "captured", "headers", F.lit(None).cast(met.schema["stored"].dataType).alias("stored"))
    met = met.select("canonical", "record_id", "captured", "headers", "stored").unionByName(lost)

    own, theirs = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), F.coalesce(F.col("stored.headers"), F.create_map().cast("map<string,string>"))
    tag, date = own["etag"], own["last-modified"]
    agrees = F.when(tag.isNotNull(), F.coalesce(_weak(tag) == _weak(theirs["etag"]), F.lit(False))).when(date.isNotNull(), F.coalesce(date == theirs["last-modified"], F.lit(False))).otherwise(True)
    outcome = F.when(F.col("stored").isNull(), "no_earlier_response").when(agrees, "resolved").otherwise("validator_mismatch")
    fresh = F.map_filter(own, lambda k, _: ~k.isin(KEPT_FIELDS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    done = met.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return done.select(
        "record_id", "canonical", "captured", "outcome",
        F.when(ok, F.col("stored.record_id")).alias("response_id"),
        F.when(ok, F.col("stored.payload_digest")).alias("payload_digest"),
        F.when(ok, F.col("stored.payload_bytes")).alias("payload_bytes"),
        F.when(ok, merged).alias("merged_headers"),
    )


def header_text(headers: Column) -> Column:
    """A map of headers as sorted "name: value" lines."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def crawl_of(pages: DataFrame) -> DataFrame:
    """Records of a crawl of ``pages``: the full response of each page, a revisit a day later, and one an hour before for every third page.

    The later revisit asks for the URL in upper-case-host form with a fragment;
    its ETag is stale for every seventh page and missing for every fifth, which
    sends Last-Modified (none for every tenth).
    """
    k, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag, date = F.concat(F.lit('"'), F.md5(html), F.lit('"')), F.concat(F.lit("day "), (k % 1000).cast("string"))
    base = F.lit(1_700_000_000) + k * 60
    size = F.octet_length(html).cast("string")
    first = pages.select(
        (k * 4).alias("record_id"), F.lit("response").alias("kind"), "url", base.alias("captured"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        F.md5(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    sent = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("etag").alias("key"), F.when(k % 5 == 0, None).when(k % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag)).alias("value")),
        F.struct(F.lit("last-modified").alias("key"), F.when((k % 5 == 0) & (k % 10 != 0), date).alias("value")),
        F.struct(F.lit("cache-control").alias("key"), F.lit("max-age=120").alias("value")),
        F.struct(F.lit("content-length").alias("key"), F.lit("0").alias("value")),
        F.struct(F.lit("connection").alias("key"), F.lit("close").alias("value")),
    ), lambda e: e["value"].isNotNull()))
    none = [F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("long").alias("payload_bytes")]
    later = pages.select((k * 4 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), (base + 86_400).alias("captured"), F.lit(304).alias("status"), sent.alias("headers"), *none)
    sooner = pages.filter(k % 3 == 0).select((k * 4 + 2).alias("record_id"), F.lit("revisit").alias("kind"), "url", (base - 3600).alias("captured"), F.lit(304).alias("status"), F.create_map(F.lit("cache-control"), F.lit("no-cache")).alias("headers"), *none)
    return first.unionByName(later).unionByName(sooner)


def payload_digest(payload: bytes) -> str:
    """The digest that joins records to payloads."""
    return hashlib.md5(payload).hexdigest()


#: The revisits of crawl_of(pages), resolved, in DuckDB's SQL.
ORACLE = r"""
with p as (select page_id k, url, coalesce(html, '') html from pages),
u as (select k, html, regexp_replace(trim(url), '#.*$', '') plain from p),
c as (select k, html, case when regexp_matches(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*[^?]*[?]?.*$') then
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)[?]?(.*)$', 2)), '^.*@', ''), ':(80|443)?$', ''), '^www[.]', '')
    || regexp_replace(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)[?]?(.*)$', 3), '/$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)[?]?(.*)$', 4), '&'),
        lambda x: x <> '' and not regexp_matches(x, '^(utm_|fbclid=|gclid=|sessionid=)'))), '&'), ''), '') else plain end canonical from u),
full_ as (select k * 4 record_id, canonical, 1700000000 + k * 60 captured, '"' || md5(html) || '"' etag, 'day ' || (k % 1000) modified, md5(html) digest, strlen(html) size from c),
asked as (select k * 4 + 1 record_id, canonical, 1700000000 + k * 60 + 86400 captured,
    case when k % 5 = 0 then null when k % 7 = 0 then '"stale"' else 'W/"' || md5(html) || '"' end etag,
    case when k % 5 = 0 and k % 10 <> 0 then 'day ' || (k % 1000) end modified, 'max-age=120' cache from c
  union all select k * 4 + 2, canonical, 1700000000 + k * 60 - 3600, null, null, 'no-cache' from c where k % 3 = 0),
ranked as (select a.*, f.record_id r, f.etag f_etag, f.modified f_modified, f.digest, f.size,
    row_number() over (partition by a.record_id order by f.captured desc, f.record_id desc) n
  from asked a left join full_ f on f.canonical = a.canonical and (f.captured < a.captured or f.captured = a.captured and f.record_id < a.record_id)),
judged as (select *, case when r is null then 'no_earlier_response'
    when etag is not null then case when regexp_replace(etag, '^W/', '') = f_etag then 'resolved' else 'validator_mismatch' end
    when modified is not null then case when modified = f_modified then 'resolved' else 'validator_mismatch' end
    else 'resolved' end outcome from ranked where n = 1)
select record_id, canonical, captured, outcome,
  case when outcome = 'resolved' then r end response_id,
  case when outcome = 'resolved' then digest end payload_digest,
  case when outcome = 'resolved' then size end payload_bytes,
  case when outcome = 'resolved' then 'cache-control: ' || cache || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || coalesce(etag, f_etag) || chr(10) || 'last-modified: ' || coalesce(modified, f_modified) end merged_headers
from judged
"""
