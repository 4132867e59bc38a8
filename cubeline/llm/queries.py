"""The opN_ queries: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeline.llm import feature_digest, html_diff, mpeg_audio, packing, revisit, secrets, simhash, sp_viterbi, token_counts, toxicity
from cubeline.llm.common import importable


#: The byte-level vocabulary that texts are counted and packed with, and its end mark.
BYTE_BPE, END = "byte_bpe_50k.json", 50_256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call starts a cache of its own, so its figures are those of a cold cache."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.features(mpeg_audio.media(_table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), END)


def page_records(pages: DataFrame) -> DataFrame:
    """An archive made from pages: two responses of each, half a day apart and with other contents, and three revisits under
    another spelling of the URL, each with one validator: an entity tag, a last-modified date, a payload digest.

    Times follow from page_id, bodies and validators from the html.  By the first digit of the
    body's digest, the first revisit carries another tag (0), stands before its response (1) or
    has no validator (2), the second names the older date (3), the third the older digest (4).
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("d"), F.octet_length("html").alias("n"), (F.lit(1_704_067_200) + F.col("page_id") * 37).alias("t"))
    digit, number, none = F.substring("d", 1, 1), F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(None).cast("string")
    day = lambda t: F.date_format(F.timestamp_seconds(t), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    first, second, quarter = F.col("t"), F.col("t") + 43_200, 21_600
    again = F.concat(F.regexp_replace("url", r"^https?://(www\.)?", "HTTP://WWW."), F.lit("#again"))
    asked = F.create_map(F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"), F.lit("X-Cache"), F.lit("hit"))

    def record(name: str, url, t, kind: str, etag, modified, digest, headers):
        return F.struct(
            F.concat(F.lit(name[0]), number, F.lit(name[1])).alias("record_id"), url.alias("url"), F.timestamp_seconds(t).alias("ts"), F.lit(kind).alias("type"),
            etag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), headers.alias("headers"),
        )

    def response(name: str, t, tag, digest):
        quoted = F.concat(F.lit('"'), tag, F.lit('"'))
        held = F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), quoted, F.lit("Cache-Control"), F.lit("max-age=60"),
            F.lit("Content-Length"), F.col("n").cast("string"), F.lit("Last-Modified"), day(t),
        )
        return record(name, F.col("url"), t, "response", quoted, day(t), digest, held)

    tag = F.when(digit == "0", '"changed"').when(digit != "2", F.concat(F.lit('W/"'), F.col("d"), F.lit('"')))
    made = F.array(
        response("ra", first, F.col("d"), F.col("d")),
        response("rb", second, F.concat("d", F.lit("-2")), F.reverse("d")),
        record("v1", again, F.col("t") + F.when(digit == "1", -quarter).otherwise(quarter), "revisit", tag, none, none, asked),
        record("v2", again, second + quarter, "revisit", none, day(F.when(digit == "3", first).otherwise(second)), none, asked),
        record("v3", again, second + 2 * quarter, "revisit", none, none, F.when(digit == "4", F.col("d")).otherwise(F.reverse("d")), asked),
    )
    return p.select(F.inline(made))


def op4_not_modified_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = revisit.resolve(page_records(_table(spark, sf_dir, "pages")))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return r.select(
        F.substring("record_id", 2, 12).cast("long").alias("page_id"), "record_id", "url_key", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "response_id",
        F.col("response_ts").cast("timestamp_ntz").alias("response_ts"), flat.alias("headers"),
    )


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n, 1704067200 + page_id * 37 AS t,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^[^@]*@', '')), ':(80|443)?$', ''), '\.$', ''), '^www\d*\.', '')
            || regexp_replace(regexp_extract(regexp_replace(u, '^[^/?]*', ''), '^([^?]*)', 1), '/+$', '') AS base,
         list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|ref|sid|sessionid|phpsessid|jsessionid)(=.*)?$'))) AS kept
  FROM p
), k AS (
  SELECT *, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key, lpad(page_id::VARCHAR, 12, '0') AS num FROM q
), resp AS (
  SELECT url_key, 'r' || num || 'a' AS response_id, t, d AS tag, t AS lm, d AS dg, n FROM k
  UNION ALL SELECT url_key, 'r' || num || 'b', t + 43200, d || '-2', t + 43200, reverse(d), n FROM k
), rev AS (
  SELECT page_id, 'v' || num || '1' AS record_id, url_key, t + CASE WHEN d[1] = '1' THEN -21600 ELSE 21600 END AS t, CASE WHEN d[1] = '0' THEN 'changed' WHEN d[1] <> '2' THEN d END AS tag, NULL::BIGINT AS lm, NULL::VARCHAR AS dg FROM k
  UNION ALL SELECT page_id, 'v' || num || '2', url_key, t + 64800, NULL, CASE WHEN d[1] = '3' THEN t ELSE t + 43200 END, NULL FROM k
  UNION ALL SELECT page_id, 'v' || num || '3', url_key, t + 86400, NULL, NULL, CASE WHEN d[1] = '4' THEN d ELSE reverse(d) END FROM k
), j AS (
  SELECT rev.*, resp.response_id, resp.t AS rt, resp.tag AS rtag, resp.n AS rn,
         CASE WHEN resp.response_id IS NULL THEN 'orphan' WHEN rev.tag IS NOT NULL THEN if(rev.tag = resp.tag, 'resolved', 'mismatch')
              WHEN rev.lm IS NOT NULL THEN if(rev.lm = resp.lm, 'resolved', 'mismatch') WHEN rev.dg IS NOT NULL THEN if(rev.dg = resp.dg, 'resolved', 'mismatch') ELSE 'unverified' END AS status
  FROM rev ASOF LEFT JOIN resp ON rev.url_key = resp.url_key AND rev.t >= resp.t
)
SELECT page_id, record_id, url_key, make_timestamp(t * 1000000) AS ts, status, response_id, make_timestamp(rt * 1000000) AS response_ts,
       CASE WHEN status IN ('resolved', 'unverified')
            THEN 'cache-control=max-age=600|content-length=' || rn::VARCHAR || '|content-type=text/html|etag="' || rtag || '"|last-modified=' || strftime(make_timestamp(rt * 1000000), '%a, %d %b %Y %H:%M:%S GMT') || '|x-cache=hit'
            ELSE 'Cache-Control=max-age=600|Content-Length=0|X-Cache=hit' END AS headers
FROM j
"""


def op5_feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_digest.digests(_table(spark, sf_dir, "documents"))


def op6_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_viterbi.digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", toxicity.held_out(scored.doc_id).alias("held_out"), "score", "predicted")


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train_from(docs))


def op10_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mpeg_audio": op2_mpeg_audio,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_not_modified_revisits": op4_not_modified_revisits,
    "op5_feature_digest": op5_feature_digest,
    "op6_sentencepiece_viterbi": op6_sentencepiece_viterbi,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_components": op8_simhash_components,
    "op9_secret_scan": op9_secret_scan,
    "op10_page_differencing": op10_page_differencing,
}

#: The others can't be put in SQL that ends on whole tables.
ORACLE_SQL = {"op4_not_modified_revisits": OP4_SQL}
