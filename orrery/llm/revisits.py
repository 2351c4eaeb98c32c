"""Not-modified revisits of web archives, resolved to the response that they confirm.

A revisit (HTTP 304) takes its content from the latest full response of the same canonical URL with an earlier time, if
the validators agree: by entity tag, compared weakly, if the revisit has one, else by Last-Modified. Of responses of one
time the one with the greatest record id counts. The resolved record has the response's headers with those that a 304 may
renew taken from the revisit.

The as-of join works in spans of time, cut at quantiles: within a canonical URL and span by a window, between spans by the
last response of each span, so that a URL with a third of all records is spread over SPANS tasks or more. Contents don't take part.

Rows with a null kind or record id are left out. Rows of one record id are one record, the greatest by time, kind, URL,
validators, digest and headers, whatever the order of the rows. A null URL, or a null time, never has an earlier response.
Header names are compared in lower case; of a repeated header the last counts; null maps are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import left_join_split, materialize

#: Headers that a 304 response may renew (RFC 9110, section 15.4.5).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Spans of time that the records of a URL are dealt out over: at least so many, and one for so many records up to a bound; and
#: revisits of one response that meet in a task at most.
SPANS, SPAN_ROWS, MOST_SPANS, HOT = 128, 2_000_000, 16_384, 10_000


def canonical_url(url: Column) -> Column:
    """Host and path in a form that ignores scheme, www., default port, fragment, tracking parameters and a final slash."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^(?i)[a-z][a-z0-9+.-]*://(www\.)?", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.regexp_replace(path, r"(?i)([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    path = F.regexp_replace(F.regexp_replace(path, r"&+", "&"), r"\?&", "?")
    path = F.regexp_replace(F.regexp_replace(path, r"[?&]+$", ""), r"/$", "")
    return F.concat(F.regexp_replace(host, r":(80|443)$", ""), path)


def _headers(found: Column) -> Column:
    """Entries with lower-case names, of each name the last."""
    low = F.transform(
        F.coalesce(F.map_entries(found), F.array().cast("array<struct<key:string,value:string>>")),
        lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")),
    )
    def later(e: Column, x: Column, i: Column) -> Column:
        return F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])

    return F.element_at(F.transform(F.array(low), lambda e: F.filter(e, lambda x, i: ~later(e, x, i))), 1)


def merged_headers(stored: Column, renewed: Column) -> Column:
    """The stored headers, with those in RENEWED from the later response."""
    new = F.filter(_headers(renewed), lambda x: x["key"].isin(*RENEWED))
    kept = F.filter(_headers(stored), lambda x: ~F.exists(new, lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.concat(kept, new))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^(W/)", "")


def _one_each(rows: DataFrame) -> DataFrame:
    """Of the rows of each record id the greatest by time, kind, URL, validators, digest and headers, nulls least."""
    names = ["ts", "kind", "canonical_url", "etag", "last_modified", "digest"]
    sorted_headers = F.array_sort(F.map_entries("headers"))
    best = rows.groupBy("record_id").agg(F.max_by(F.struct(*names, "headers"), F.struct(*names, sorted_headers)).alias("r"))
    return best.select("record_id", "r.*")


def _span(cuts: list[int], ts: Column) -> Column:
    """How many of the sorted cuts are no later than ts, by halving them; 0 for a null."""
    if not cuts:
        return F.lit(0)
    listed = F.lit(cuts).cast("array<bigint>")

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.coalesce(F.get(listed, mid) <= ts, F.lit(False))
        step = F.when(above, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))
        return F.when(s["low"] < s["high"], step).otherwise(s)

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), begin, halved, lambda s: s["low"])


def resolve(records: DataFrame, spans: int | None = None, hot: int = HOT) -> DataFrame:
    """Revisits with the response that they refer to.

    records: record_id long, url string, ts long, kind string (response or revisit), etag, last_modified string,
    headers map<string,string>, digest string (of the content). Result: record_id, canonical_url, ts, status (resolved,
    no_earlier_response, validator_mismatch, no_validator), refers_to, headers, digest; the last three are null unless
    resolved. Other columns are left behind.
    """
    rows = records.where(F.col("kind").isin("response", "revisit") & F.col("record_id").isNotNull()).select(
        "record_id", "ts", "kind", "etag", "last_modified", "headers", "digest", canonical_url(F.col("url")).alias("canonical_url")
    )
    rows = materialize(_one_each(rows), "records")
    spans = spans or min(max(SPANS, -(-rows.count() // SPAN_ROWS)), MOST_SPANS)
    # Spans hold about as many records each, however the times are spread.
    found = rows.approxQuantile("ts", [k / spans for k in range(1, spans)], 1 / (4 * spans)) if spans > 1 else []
    cuts = sorted({min(int(x), (1 << 63) - 1) for x in found})
    full = F.when(
        (F.col("kind") == "response") & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(),
        F.struct("ts", "record_id", "etag", "last_modified", "digest"),
    )
    # Headers of responses come back by the record id afterwards: the window carries small rows.
    own = F.when(F.col("kind") == "revisit", F.col("headers")).alias("__new")
    span = _span(cuts, F.col("ts")).alias("span")
    slim = rows.select("canonical_url", span, "ts", "record_id", "kind", "etag", "last_modified", own, full.alias("full"))
    # Responses come after the revisits of their time, which they are too late for.
    later = F.col("kind") == "response"
    inside = Window.partitionBy("canonical_url", "span").orderBy("ts", later).rowsBetween(Window.unboundedPreceding, -1)
    seen = slim.withColumn("near", F.max("full").over(inside))
    carried = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        slim.groupBy("canonical_url", "span")
        .agg(F.max("full").alias("last"))
        .withColumn("far", F.max("last").over(carried))
        .select("canonical_url", "span", "far")
    )
    known = seen.where("kind = 'revisit' AND canonical_url IS NOT NULL AND ts IS NOT NULL").join(before, ["canonical_url", "span"], "left")
    by_tag = _tag(F.col("etag")) == _tag(F.col("to.etag"))
    by_time = F.trim("last_modified") == F.trim("to.last_modified")
    status = (
        F.when(F.col("to").isNull(), "no_earlier_response")
        .when(F.col("etag").isNull() & F.col("last_modified").isNull(), "no_validator")
        .when(F.coalesce(F.when(F.col("etag").isNotNull(), by_tag).otherwise(by_time), F.lit(False)), "resolved")
        .otherwise("validator_mismatch")
    )
    judged = known.withColumn("to", F.coalesce("near", "far")).withColumn("status", status)
    judged = materialize(
        judged.select("record_id", "canonical_url", "ts", "status", F.col("to.record_id").alias("refers_to"), "__new", F.col("to.digest").alias("digest")),
        "judged",
    )
    resolved = judged.where("status = 'resolved'")
    stored = rows.where("kind = 'response'").select(F.col("record_id").alias("__of"), F.col("headers").alias("__old"))
    merged = left_join_split(resolved, stored, [("refers_to", "__of")], hot).select(
        "record_id", "canonical_url", "ts", "status", "refers_to", merged_headers(F.col("__old"), F.col("__new")).alias("headers"), "digest"
    )
    # Rows without a URL or a time have no earlier response; all others that aren't resolved have nothing to join either.
    none = lambda c: F.lit(None).cast(merged.schema[c].dataType).alias(c)
    rest = judged.where("status <> 'resolved'").select("record_id", "canonical_url", "ts", "status")
    lost = rows.where("kind = 'revisit' AND (canonical_url IS NULL OR ts IS NULL)").select(
        "record_id", "canonical_url", "ts", F.lit("no_earlier_response").alias("status")
    )
    rest = rest.unionByName(lost).select("record_id", "canonical_url", "ts", "status", none("refers_to"), none("headers"), none("digest"))
    return merged.unionByName(rest)
