"""URL filters by a temporal list join (native: DataFrame functions only).

Lists change over time: a dated entry adds or removes a pattern. Entries become
validity intervals ``[valid_from, valid_to)`` and every capture is judged by the
intervals that hold on the day it was fetched.

Entries: kind ('domain': the host or any parent of it; 'url': scheme-less URL
without query and fragment), pattern, category, action ('add' or 'remove'),
effective (date). Captures: page_id, url, fetch_day (date).

Plan: entries shrink to one row per key and day before any window, so a key's
window holds at most as many rows as there are days. Intervals are cut at month
buckets and meet the captures by equality on (kind, pattern, bucket, salt), so a
hot host spreads over buckets x salts and no key's captures meet all its
intervals.

Defined cases: null or unparseable URL: no host, nothing matches, not blocked;
null fetch_day: nothing matches; a null pattern, date or unknown action: entry
ignored; several entries of a key on one day: a removal wins; repeated adds or
removals change nothing; identical captures become one row with their number in
``captures``; empty lists block nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 8
BUCKET_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:.*@)?([^:@]*?)\.?(?::[0-9]*)?$", 1))
    return F.when(host != "", host)


def url_key(url: Column) -> Column:
    """host/path, without scheme, query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), path)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, category, valid_from, valid_to (null: still valid)."""
    key = ["kind", "pattern", "category"]
    daily = (entries.filter(F.col("pattern").isNotNull() & F.col("effective").isNotNull()
                            & F.col("action").isin("add", "remove"))
             .groupBy(*key, "effective").agg(F.max(F.col("action") == "remove").alias("removed")))
    by_day = Window.partitionBy(*key).orderBy("effective")
    turns = (daily.withColumn("before", F.lag("removed", 1, True).over(by_day))
             .filter(F.col("removed") != F.col("before"))
             .withColumn("valid_to", F.lead("effective").over(by_day)))
    return turns.filter(~F.col("removed")).select(*key, F.col("effective").alias("valid_from"), "valid_to")


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS).cast("int")


def filter_captures(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct capture: page_id, url, fetch_day, host, blocked, the most
    specific active pattern with its kind and category (a URL before a domain, a
    longer pattern first, then by text), n_active and captures."""
    caps = (captures.groupBy("page_id", "url", "fetch_day").agg(F.count(F.lit(1)).alias("captures"))
            .withColumn("host", host_of(F.col("url"))))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"),
                           F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    keys = F.concat(suffixes, F.array(F.struct(F.lit("url").alias("kind"), url_key(F.col("url")).alias("pattern"))))
    wanted = (caps.filter(F.col("host").isNotNull() & F.col("fetch_day").isNotNull())
              .select("page_id", "url", "fetch_day", F.explode(keys).alias("k"))
              .select("page_id", "url", "fetch_day", "k.kind", "k.pattern", _bucket(F.col("fetch_day")).alias("bucket"),
                      F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt")))
    last = captures.agg(F.max("fetch_day")).first()[0]
    held = (validity_intervals(entries).withColumn("until", F.least(
                F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast("date")), F.lit(last).cast("date")))
            .filter(F.col("valid_from") <= F.col("until"))
            .withColumn("bucket", F.explode(F.sequence(_bucket(F.col("valid_from")), _bucket(F.col("until")))))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    hits = (wanted.join(held, ["kind", "pattern", "bucket", "salt"])
            .filter((F.col("fetch_day") >= F.col("valid_from"))
                    & (F.col("valid_to").isNull() | (F.col("fetch_day") < F.col("valid_to")))))
    best = (hits.groupBy("page_id", "url", "fetch_day").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.min(F.struct((F.col("kind") != "url").alias("a"), (-F.length("pattern")).alias("b"),
                       F.col("pattern"), F.col("category"), F.col("kind"))).alias("m")))
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"b.{x}")) for x in ("page_id", "url", "fetch_day")]
    return caps.alias("c").join(best.alias("b"), same[0] & same[1] & same[2], "left").select(
        "c.page_id", "c.url", "c.fetch_day", "host", F.col("m").isNotNull().alias("blocked"),
        F.col("m.kind").alias("kind"), F.col("m.pattern").alias("pattern"), F.col("m.category").alias("category"),
        F.coalesce("n_active", F.lit(0).cast("bigint")).alias("n_active"), "captures")
