"""Revisit records answered "not modified", resolved to the response they refer to.

An as-of join by canonical URL: each revisit gets the latest earlier full response.
Time is cut into slices, so that a URL with a third of all records is many groups;
what a URL had before a slice comes from one summary row per URL and slice.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 32

# Headers that a "not modified" answer may renew.
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
# Query parameters that do not change the resource.
TRACKING = r"utm_[^=&]*|ref|fbclid|gclid"

RESOLVED = "resolved"
NO_RESPONSE = "no_earlier_response"
MISMATCH = "validator_mismatch"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without default port, no fragment or tracking
    parameters, parameters sorted, no slash at the end of a path."""
    plain = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    named = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})="))
    joined = F.array_join(F.array_sort(named), "&")
    return F.concat(head, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def _slice_of(time: Column, borders: list) -> Column:
    slices = F.lit(0)
    for border in borders:
        slices = slices + F.when(time >= border, 1).otherwise(0)
    return slices


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(responses: DataFrame, revisits: DataFrame, slices: int = SLICES) -> DataFrame:
    """``(revisit_id, url, response_id, status, headers, digest)`` for every revisit.

    Both tables have record_id (long), url, captured_at (long), headers (map with
    lower-case names) and digest (string, of the payload). The latest response
    captured strictly before a revisit under the same canonical URL is its
    candidate; of responses at one instant the one with the greatest record_id.
    It is accepted if the validators agree: etags by weak comparison if both have
    one, else last-modified if both have one, else equal digests. ``headers`` are
    then the response's with those that a "not modified" answer may renew.

    A null URL or time resolves to nothing (``no_earlier_response``); null headers
    count as none; with no validator in common the status is a mismatch. Repeated
    revisits are each resolved, repeated responses tie. Other columns are not
    read; without revisits there are no rows.
    """
    record = F.struct("captured_at", "record_id", "headers", "digest")

    def events(records: DataFrame, is_response: bool) -> DataFrame:
        empty = F.create_map().cast("map<string,string>")
        rows = records.select(
            F.col("record_id").cast("long"),
            canonical_url(F.col("url")).alias("url"),
            F.col("captured_at").cast("long"),
            F.coalesce("headers", empty).alias("headers"),
            "digest",
        )
        return rows.withColumn("is_response", F.lit(is_response))

    full = events(responses, True).filter("url is not null and captured_at is not null")
    asked = events(revisits, False)
    shares = [i / slices for i in range(1, slices)]
    borders = sorted(set(full.approxQuantile("captured_at", shares, 0.01)))  # at most ``slices`` numbers
    both = full.unionAll(asked).withColumn("slice", _slice_of(F.col("captured_at"), borders))

    # The last response is found by time and id alone; its headers follow by one join.
    key = F.struct("captured_at", "record_id")
    seen = F.when(F.col("is_response"), key)
    earlier = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        both.groupBy("url", "slice")
        .agg(F.max(seen).alias("latest"))
        .select("url", "slice", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
        .filter("carried is not null")
    )
    in_slice = (
        Window.partitionBy("url", "slice")
        .orderBy("captured_at", "is_response", "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = both.withColumn("near", F.last(seen, ignorenulls=True).over(in_slice)).filter("not is_response")
    placed = found.join(carried, ["url", "slice"], "left").select(
        F.col("record_id").alias("revisit_id"),
        "url",
        F.when(F.col("url").isNotNull() & F.col("captured_at").isNotNull(), F.coalesce("near", "carried")).alias("key"),
        F.col("headers").alias("new"),
        F.col("digest").alias("new_digest"),
    )
    # A null would not count as a greatest digest, and its headers would be lost.
    last = F.max_by(F.struct("headers", "digest"), F.coalesce("digest", F.lit("")))
    kept = full.groupBy("url", key.alias("key")).agg(last.alias("old"))
    joined = placed.join(kept, ["url", "key"], "left")
    return joined.select("revisit_id", "url", F.col("key.record_id").alias("response_id"), *_merged())


def _merged() -> list[Column]:
    old, new = F.col("old.headers"), F.col("new")

    def both(name: str) -> Column:
        return old[name].isNotNull() & new[name].isNotNull()

    agrees = (
        F.when(both("etag"), _weak(old["etag"]) == _weak(new["etag"]))
        .when(both("last-modified"), old["last-modified"] == new["last-modified"])
        .otherwise(F.coalesce(F.col("old.digest") == F.col("new_digest"), F.lit(False)))
    )
    status = F.when(F.col("key").isNull(), NO_RESPONSE).when(agrees, RESOLVED).otherwise(MISMATCH)
    renewed = F.map_filter(new, lambda name, _: name.isin(RENEWED))
    stays = F.map_filter(old, lambda name, _: ~F.map_contains_key(renewed, name))
    resolved = status == RESOLVED
    return [
        status.alias("status"),
        F.when(resolved, F.map_concat(stays, renewed)).alias("headers"),
        F.when(resolved, F.col("old.digest")).alias("digest"),
    ]
