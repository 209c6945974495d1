"""Resolution of not-modified revisits in web archive records.

A revisit takes the content of the latest earlier full response with the same
canonical URL.  Its validators are checked against that response's, and those
of its headers that a not-modified answer may change replace the response's.

The as-of join is done in two levels.  Records are dealt to ranges of URL and
time, so that a URL with very many records is spread over as many ranges as it
fills: first within the ranges, then over one row for each URL and range, which
carries the last response of earlier ranges in.  Only records of one URL at one
time stay together.

Edge cases: a null URL or time leaves a record invalid.  A response at the same
time is not earlier.  Of several responses at the latest time, the one with the
largest record_id counts.  A revisit without any earlier response is an orphan;
one without validators is merged unchecked.  Null headers are no headers.
Records with a record_id that repeats give one result for each row; of responses
alike in record_id and time, that of the least payload counts.  Other columns are
not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import materialise

# Header fields that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that don't tell pages apart.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid)"


def canonical(url: Column) -> Column:
    """Host and path without scheme, www., default port, fragment, tracking parameters and last slash."""
    u = F.trim(url)
    u = F.regexp_replace(u, r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, rf"(?<=[?&]){TRACKING}=[^&]*(&|$)", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/$", ""))


def strong(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Each revisit with what it resolves to.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), etag,
    last_modified, headers (array of name, value), payload.  The result has
    record_id, canonical_url, response_id, status (merged, mismatch, orphan,
    invalid), headers and payload; the last two are null unless merged.
    """
    named = ["record_id", F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified"]
    lean = records.select(*named, canonical(F.col("url")).alias("key"), F.coalesce("headers", F.array()).alias("headers"))
    lean = materialise(lean, "records")
    lean = materialise(lean.repartitionByRange("key", "ts").withColumn("slice", F.spark_partition_id()), "ranges")

    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified"))
    last = lean.where("kind = 'response' and key is not null and ts is not null").groupBy("key", "slice").agg(F.max(F.struct("ts", "record_id", "etag", "last_modified")).alias("last"))
    # Slices of revisits need a row too, to be carried in to.
    asked = lean.where("kind = 'revisit'").select("key", "slice").distinct()
    steps = asked.join(last, ["key", "slice"], "full_outer")
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.max("last").over(earlier)).where("carried is not null").select("key", "slice", "carried")

    inside = Window.partitionBy("key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = lean.where("key is not null and ts is not null").withColumn("near", F.max(full).over(inside)).where("kind = 'revisit'")
    found = near.join(carried, ["key", "slice"], "left").withColumn("found", F.coalesce("near", "carried"))
    odd = lean.where("kind = 'revisit' and (key is null or ts is null)")
    found = found.select("record_id", "key", "ts", "etag", "last_modified", "headers", "found").unionByName(
        odd.select("record_id", "key", "ts", "etag", "last_modified", "headers"), allowMissingColumns=True
    )
    matches = F.when(F.col("etag").isNotNull(), F.coalesce(strong(F.col("etag")) == strong(F.col("found.etag")), F.lit(False)))
    matches = matches.when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False))).otherwise(True)
    status = F.when(F.col("key").isNull() | F.col("ts").isNull(), "invalid").when(F.col("found").isNull(), "orphan").when(matches, "merged").otherwise("mismatch")
    found = materialise(found.withColumn("status", status).withColumn("response_id", F.col("found.record_id")).withColumn("response_ts", F.col("found.ts")).drop("found"), "found")

    keys = ["response_id", "response_ts"]
    whole = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col("ts").cast("long").alias("response_ts"), F.coalesce("headers", F.array()).alias("first"), "payload")
    one = Window.partitionBy(*keys).orderBy("payload", "first")
    whole = whole.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    merged = found.where("status = 'merged'").join(whole, keys)
    allowed = F.filter("headers", lambda h: F.lower(h["name"]).isin(*PERMITTED))
    replaced = F.transform(allowed, lambda h: F.lower(h["name"]))
    kept = F.filter("first", lambda h: ~F.coalesce(F.array_contains(replaced, F.lower(h["name"])), F.lit(False)))
    merged = merged.withColumn("headers", F.concat(kept, allowed))
    columns = ["record_id", F.col("key").alias("canonical_url"), "response_id", "status"]
    rest = found.where("status <> 'merged'").select(*columns)
    return merged.select(*columns, "headers", "payload").unionByName(rest, allowMissingColumns=True)
