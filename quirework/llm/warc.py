"""Not-modified revisit records of web archives, resolved to the response they stand for (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.operators.ordered import Sequence, running

#: Headers that a 304 answer may renew in a stored response (fixed values of the HTTP standard).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name another resource.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www, default port, fragment and end slash; parameters sorted, tracking ones gone."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """The map with lower-case names; of names alike the first value, blanks at its ends gone."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(F.trim(e["key"]))))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == n), 1)["value"]
    made = F.map_from_arrays(names, F.transform(names, lambda n: F.trim(value(n))))
    return F.coalesce(made, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def resolve_revisits(records: DataFrame, *, chunk_seconds: int = 86_400) -> DataFrame:
    """One row per revisit record: record_id, canonical_url, outcome, original_id, payload_digest, headers.

    ``records`` has record_id, type ("response" or "revisit"), url, date (timestamp), status, headers (map of
    strings) and payload_digest. A revisit goes with the latest full response (status 200) of its canonical
    URL that is strictly earlier; of several at that time, the one of the largest record_id. outcome:
    "resolved" if the ETags agree, ignoring W/, or, where the revisit has none, the Last-Modified values;
    "changed" if they do not; "no_validator" if the revisit has neither; "no_earlier" without such a response.
    Only a resolved revisit has a payload_digest and the response's headers with the permitted ones of the
    revisit in place of theirs; else headers are the revisit's. original_id names the response that was compared.

    Revisits without URL or date are "no_earlier"; such responses, and those of null status, are no candidates.
    A null header map is empty, a null header value is no validator. Repeated revisits each get a row, repeated responses are one candidate.
    Other columns are ignored; an empty table gives an empty one. Header names are lower-cased. Windows run by URL and ``chunk_seconds`` of
    time, with one summary row per chunk passed on, so that one URL may hold most records.
    """
    low = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "date", (F.col("type") == "revisit").alias("again"),
        ((F.col("type") == "response") & (F.col("status") == 200)).alias("full"), _lowered(F.col("headers")).alias("headers"), "payload_digest",
    ).filter("again OR full")
    kept = F.col("canonical_url").isNotNull() & F.col("date").isNotNull()
    # At one time revisits come first, so that what precedes them is earlier.
    marked = low.filter(kept).withColumn("turn", F.when(F.col("again"), 0).otherwise(1))
    order = Sequence(("canonical_url",), ("date", "turn", "record_id"), f"floor(unix_timestamp(date) / {chunk_seconds})")
    stored = F.when(F.col("full"), F.struct("record_id", "headers", "payload_digest"))
    joined = running(marked, order, {"stored": ("last", stored)}).filter("again").drop("turn")
    lost = low.filter(F.col("again") & ~kept).withColumn("stored", F.lit(None).cast(joined.schema["stored"].dataType))
    both = joined.unionByName(lost)

    weak = lambda m: F.regexp_replace(F.element_at(m, "etag"), r"^W/", "")
    since = lambda m: F.element_at(m, "last-modified")
    old = F.col("stored.headers")
    same = F.when(weak(F.col("headers")).isNotNull(), weak(F.col("headers")) == weak(old)).otherwise(since(F.col("headers")) == since(old))
    bare = weak(F.col("headers")).isNull() & since(F.col("headers")).isNull()
    outcome = (
        F.when(F.col("stored").isNull(), "no_earlier").when(bare, "no_validator")
        .when(F.coalesce(same, F.lit(False)), "resolved").otherwise("changed"))
    renewed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key("renewed", k)), F.col("renewed"))
    done = F.col("outcome") == "resolved"
    return both.withColumns({"outcome": outcome, "renewed": renewed}).select(
        "record_id", "canonical_url", "outcome", F.col("stored.record_id").alias("original_id"),
        F.when(done, F.col("stored.payload_digest")).alias("payload_digest"),
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"))
