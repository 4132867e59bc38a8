import datetime as dt
import random

from pyspark.sql import functions as F

from cubeline.llm import revisit as R

SCHEMA = "record_id string, url string, ts timestamp, type string, etag string, last_modified string, digest string, headers map<string,string>, status string"
T0 = dt.datetime(2024, 1, 1)


def test_canonical(spark):
    same = ["http://Example.com/a/", "https://www.example.com:443/a", "https://user:pw@EXAMPLE.com./a/#top", "http://example.com:80/a?utm_source=x&ref=1", "example.com/a"]
    other = ["https://example.com/a?b=2&a=1", "https://example.com/A", "https://example.com/a/b", "https://example.com:8080/a", ""]
    df = spark.createDataFrame([(u,) for u in [*same, *other, "http://example.com/a/?a=1&b=2", None]], "u string")
    got = [r[0] for r in df.select(R.canonical(F.col("u"))).collect()]
    assert set(got[:5]) == {"example.com/a"} and len(set(got[:10])) == 6
    assert got[5] == got[10] == "example.com/a?a=1&b=2" and got[11] is None


def by_hand(rows):
    def key(u):
        return None if u is None else u.lower().split("://")[-1].split("#")[0].rstrip("/")

    out = {}
    full = [r for r in rows if r[3] == "response" and r[1] is not None and r[2] is not None]
    for r in rows:
        if r[3] != "revisit":
            continue
        known = [f for f in full if key(f[1]) == key(r[1]) and r[2] is not None and (f[2], f[0]) < (r[2], r[0])]
        if not known:
            out[r[0]] = ("orphan", None)
            continue
        f = max(known, key=lambda f: (f[2], f[0]))
        state = "unverified"
        for k in (4, 5, 6):
            a, b = (x[k].removeprefix("W/") if x[k] else None for x in (f, r))
            if a and b:
                state = "resolved" if a == b else "mismatch"
                break
        out[r[0]] = (state, f[0])
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(700):
        u = "http://hot.example/x" if rng.random() < 0.4 else rng.choice(("https://A.example/p/", "http://a.example/p#f", "http://b.example/q"))
        tag = rng.choice((None, "", '"1"', 'W/"1"', '"2"'))
        rows.append((f"r{i:04}", u, T0 + dt.timedelta(minutes=rng.randint(0, 3000)), rng.choice(("response", "revisit", "revisit")), tag, rng.choice((None, "m1", "m2")), rng.choice((None, "d1")), {"A": "1"}, "x"))
    rows += [("n1", None, T0, "revisit", None, None, None, None, "x"), ("n2", "http://b.example/q", None, "revisit", None, None, None, None, "x"), ("n3", None, T0, "response", None, None, None, None, "x"), ("n4", "http://b.example/q", None, "response", None, None, None, None, "x"), ("n5", "u", T0, None, None, None, None, None, "x"), ("n6", "http://new.example", T0, "revisit", None, None, None, None, "x")]
    got = R.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    want = by_hand(rows)
    assert len(got) == len(want)
    assert {r.record_id: (r.status, r.response_id) for r in got} == want


def test_headers_merge(spark):
    old = {"ETag": '"1"', "Content-Type": "text/html", "Cache-Control": "max-age=1", "Content-Length": "10"}
    new = {"cache-control": "max-age=9", "Content-Length": "0", "Date": "today", "Connection": "close"}
    rows = [("a", "http://x/1", T0, "response", '"1"', None, None, old, ""), ("b", "http://x/1", T0 + dt.timedelta(days=40), "revisit", '"1"', None, None, new, ""), ("c", "http://x/1", T0 + dt.timedelta(days=41), "revisit", '"9"', None, None, new, ""), ("b", "http://x/1", T0 + dt.timedelta(days=40), "revisit", '"1"', None, None, new, "")]
    got = sorted(R.resolve(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.record_id)
    assert len(got) == 3
    assert got[0].headers == {"etag": '"1"', "content-type": "text/html", "cache-control": "max-age=9", "content-length": "10", "date": "today"}
    assert got[2].status == "mismatch" and got[2].headers == new
    assert R.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def warc(kind, url, when, http, body=b"", more=()):
    block = http + b"\r\n\r\n" + body
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Target-URI: " + url, b"WARC-Date: " + when, b"WARC-Record-ID: <urn:" + url + when + b">", b"Content-Length: " + str(len(block)).encode(), *more]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    import gzip

    records = [
        warc(b"warcinfo", b"x", b"2024-01-01T00:00:00Z", b"software: y"),
        warc(b"response", b"http://a.org/p", b"2024-01-01T00:00:00Z", b'HTTP/1.1 200 OK\r\nETag: "1"\r\nX-Long: a\r\n b\r\nContent-Type: text/html', b"<p>WARC/1.1 in a body</p>", (b"WARC-Payload-Digest: sha1:AA",)),
        warc(b"response", b"http://a.org/p", b"2024-01-02T00:00:00Z", b"HTTP/1.1 404 Not Found", b"gone"),
        warc(b"revisit", b"http://www.a.org/p/", b"2024-01-03T00:00:00Z", b'HTTP/1.1 304 Not Modified\r\netag: W/"1"\r\nDate: now'),
        warc(b"revisit", b"http://a.org/p", b"2024-01-04T00:00:00Z", b"HTTP/1.1 304 Not Modified", b"", (b"WARC-Payload-Digest: sha1:BB",)),
        warc(b"revisit", b"http://b.org/", b"2024-01-04T00:00:00Z", b"HTTP/1.1 304 Not Modified"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[3:])) + gzip.compress(records[1])[:-9])  # the last is broken off
    (tmp_path / "c.warc").write_bytes(b"no records")
    r = R.read_warc(spark, str(tmp_path))
    assert r.count() == 4 and r.where("etag = '\"1\"'").first().headers["X-Long"] == "a b"
    got = {(x.url_key, x.ts.day): x for x in R.resolve(r).collect()}
    assert got["a.org/p", 3].status == "resolved" and got["a.org/p", 3].headers == {"etag": 'W/"1"', "x-long": "a b", "content-type": "text/html", "date": "now"}
    assert got["a.org/p", 4].status == "mismatch" and got["b.org", 4].status == "orphan"


def test_query_against_its_sql(spark):
    import duckdb

    from cubeline.llm.queries import OP4_SQL, op4_not_modified_revisits

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    rel = con.sql(OP4_SQL)
    got = op4_not_modified_revisits(spark, d)
    names = sorted(got.columns)
    want = sorted(tuple(map(str, r)) for r in rel.select(*names).fetchall())
    mine = sorted(tuple(map(str, r)) for r in got.select(*names).collect())
    assert mine == want
    status = {r.status: r["count"] for r in got.groupBy("status").count().collect()}
    assert set(status) == {"resolved", "mismatch", "unverified", "orphan"}
    later = {r.response_id[-1] for r in got.where("status = 'resolved'").collect()}
    assert later == {"a", "b"}  # the latest earlier of several responses
