"""Not-modified revisits in web archives: each is resolved to the latest earlier full response.

Records have a URL, a time, a type (`response` or `revisit`), validators (entity tag,
last-modified, payload digest) and a map of headers.  URLs are canonical first: lower-case
scheme and host, no default port, user or fragment, no `www.` in front, no tracking or session
parameters, the rest of the query in order, no trailing slash.  http and https are one.

For every revisit the latest response of that canonical URL with a time before it (at the
same time: one that stands before it, by record id) is found, and checked:

* `resolved`: entity tags agree (weak comparison), or, where a side has none, last-modified
  dates agree, or where those lack too, payload digests agree; nothing at all to compare is
  `unverified`, and the response is still named.
* `mismatch`: the first validator that both sides have differs.  The response is named; its
  body must not stand in for the revisit.
* `orphan`: there is no earlier response.

Headers of a resolved or unverified revisit are merged as a cache does on 304: those of the
response, with the permitted headers of the revisit over them.  Permitted are all but the
ones that describe the body or the connection (`FIXED`).

The as-of join is one pass over times, cut into spans: within a (URL, span) the latest
response is carried along by a window, and each span takes over the last response of the
spans before it from a table with one row for each (URL, span).  A URL with a third of all
records is thus as many groups as it has spans, and no task holds it whole.  Bodies don't
move; the result names the response's record id.

`read_warc` makes such records of WARC files, plain or compressed member by member; records of
other types and those that are broken off are passed over.  A file is one task's work.

Records with a null URL, time or type resolve as `orphan` if they are revisits and serve no
one if responses.  Repeated rows come out as often as they went in.  Extra columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of a span.
SPAN = 3_600
#: Headers that a 304 can't change.
FIXED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sid|sessionid|phpsessid|jsessionid)(=.*)?$"


def canonical(url: Column) -> Column:
    """The canonical form of a URL, by SQL functions alone."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.regexp_extract(u, r"^([^/?]*)", 1)
    tail = F.substring(u, F.length(head) + 1, F.length(u))
    host = F.lower(F.regexp_replace(head, r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"\.$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(tail, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(tail, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _tag(c: str) -> Column:
    """An entity tag as weak comparison sees it; empty ones are none."""
    return F.nullif(F.regexp_replace(F.trim(F.col(c)), r'^[Ww]/', ""), F.lit(""))


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """records: record_id, url, ts (timestamp), type, etag, last_modified, digest, headers map.

    One row for each revisit: record_id, url_key, ts, status, response_id, response_ts, headers.
    """
    r = records.select(
        "record_id", canonical(F.col("url")).alias("url_key"), F.col("ts").cast("timestamp").alias("ts"), F.lower("type").alias("type"),
        _tag("etag").alias("etag"), F.nullif(F.trim("last_modified"), F.lit("")).alias("modified"), F.nullif(F.trim("digest"), F.lit("")).alias("digest"), "headers",
    ).where("type in ('response', 'revisit')")
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = F.when((F.col("type") == "response") & usable, F.struct("ts", "record_id", "etag", "modified", "digest", "headers"))
    # a record without URL or time is a group of its own and meets nothing
    own = F.when(usable, F.lit(0)).otherwise(F.xxhash64("record_id"))
    r = r.withColumn("full", full).withColumn("own", own).withColumn("span", F.when(usable, F.floor(F.unix_timestamp("ts") / span)).otherwise(0))
    key = ["url_key", "own", "span"]
    within = Window.partitionBy(*key).orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = r.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("type = 'revisit'")

    lasts = r.where("full is not null").groupBy(*key).agg(F.max_by("full", F.struct("full.ts", "full.record_id")).alias("end"))
    # spans with a revisit and those with a response, one row each; each gets the last response before it
    spans = inside.select(*key).distinct().join(lasts, key, "full")
    before = Window.partitionBy("url_key", "own").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.last("end", ignorenulls=True).over(before)).select(*key, "far")

    null_safe = [inside[k].eqNullSafe(carried[k]) for k in key]
    j = inside.join(carried, null_safe[0] & null_safe[1] & null_safe[2], "left").select(
        inside.record_id, inside.url_key, inside.ts, inside.etag, inside.modified, inside.digest, inside.headers, F.coalesce(inside.near, carried.far).alias("res")
    )
    same = (
        F.when(F.col("etag").isNotNull() & F.col("res.etag").isNotNull(), F.col("etag") == F.col("res.etag"))
        .when(F.col("modified").isNotNull() & F.col("res.modified").isNotNull(), F.col("modified") == F.col("res.modified"))
        .when(F.col("digest").isNotNull() & F.col("res.digest").isNotNull(), F.col("digest") == F.col("res.digest"))
    )
    status = F.when(F.col("res").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    return j.withColumn("status", status).select(
        "record_id", "url_key", "ts", "status", F.col("res.record_id").alias("response_id"), F.col("res.ts").alias("response_ts"),
        F.when(F.col("status").isin("resolved", "unverified"), merged(F.col("res.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def merged(stored: Column, fresh: Column) -> Column:
    """The stored headers with the permitted ones of `fresh` over them; names in lower case, sorted."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    low = lambda m: F.transform(F.map_entries(F.coalesce(m, empty)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    new = F.filter(low(fresh), lambda e: ~e["key"].isin(*FIXED))
    # several spellings of one name: the last by value stands
    names = F.array_sort(F.array_distinct(F.concat(F.transform(low(stored), lambda e: e["key"]), F.transform(new, lambda e: e["key"]))))
    pick = lambda es, n: F.array_max(F.transform(F.filter(es, lambda e: e["key"] == n), lambda e: e["value"]))
    has = lambda es, n: F.exists(es, lambda e: e["key"] == n)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.when(has(new, n), pick(new, n)).otherwise(pick(low(stored), n))))


# --- WARC files -------------------------------------------------------------------------------


def _members(raw: bytes) -> Iterator[bytes]:
    """The plain text of a file, gzip member by member; what is broken off ends it."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out = d.decompress(raw) + d.flush()
        except zlib.error:
            return
        if not d.eof:
            return
        yield out
        raw = d.unused_data


def _fields(block: bytes) -> tuple[str, dict[str, str], int]:
    """(first line, headers by their own spelling, where the body begins); folded lines belong to the one before."""
    end = block.find(b"\r\n\r\n")
    head = (block if end < 0 else block[:end]).decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    last = None
    for line in head[1:]:
        if line[:1] in (" ", "\t") and last is not None:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip()
            out[last] = value.strip()
    return head[0], out, len(block) if end < 0 else end + 4


def warc_records(raw: bytes) -> Iterator[tuple]:
    """record_id, url, ts (text), type, etag, last_modified, digest, headers of the responses and revisits in a file."""
    kinds = {"response", "revisit"}
    for part in _members(raw):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            version, own, body = _fields(part[at : at + (1 << 16)])
            named = {k.lower(): v for k, v in own.items()}
            size = named.get("content-length", "")
            if not size.isdigit() or at + body + int(size) > len(part):
                at += 5
                continue
            block = part[at + body : at + body + int(size)]
            at += body + int(size)
            kind = named.get("warc-type", "").lower()
            if kind not in kinds:
                continue
            line, headers, _ = _fields(block)
            if kind == "response" and line.startswith("HTTP/") and line.split(" ")[1:2] != ["200"]:
                continue  # no full response
            http = {k.lower(): v for k, v in headers.items()}
            yield (
                named.get("warc-record-id"), named.get("warc-target-uri", "").strip("<>") or None, named.get("warc-date"), kind,
                http.get("etag"), http.get("last-modified"), named.get("warc-payload-digest"), headers,
            )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files as `resolve` takes them."""
    kinds = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string())]
    names = ["record_id", "url", "ts", "type", "etag", "last_modified", "digest", "headers"]

    def run(batches):
        for b in batches:
            for raw in b.column("content"):
                rows = list(warc_records(raw.as_py()))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                made = [list(c) if k != kinds[-1] else [list(m.items()) for m in c] for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names)

    schema = "record_id string, url string, ts string, type string, etag string, last_modified string, digest string, headers map<string,string>"
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema).withColumn("ts", F.try_to_timestamp("ts"))
