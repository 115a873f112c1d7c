"""URL lists that change over time: every capture against the entries active when it was fetched.

Dated entries (add or remove a domain) become validity intervals.  A capture
matches an interval if its host is the listed domain or lies below it and the
fetch time falls into the interval: an as-of join.  The intervals are cut at
month borders, so the join is an equi-join on (domain, month) with a residual
range test, and a domain with a long history or a third of all captures is
spread over its months.  Captures are reduced to distinct (host, fetch time)
before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.llm.common import ascii_lower


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dots; null if there is none. An address in brackets is taken whole, with them."""
    host = ascii_lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, domain, valid_from, valid_to) from dated entries (list_name, domain, action, at).

    An add opens an interval that the list's next entry for the domain closes;
    repeated adds extend it; of entries at one time a remove counts last.
    ``at`` may be a date (its first moment) or a time.  ``valid_to`` is
    exclusive, null while open.  Entries with a null domain, action or time are void.
    """
    order = Window.partitionBy("list_name", "domain").orderBy("at", "action")
    clean = entries.select("list_name", ascii_lower(F.col("domain")).alias("domain"), "action", F.col("at").cast("timestamp").alias("at")).where("domain is not null and at is not null and action in ('add', 'remove')").distinct()
    spans = clean.withColumn("valid_to", F.lead("at").over(order)).where("action = 'add'")
    return spans.where("valid_to is null or valid_to > at").select("list_name", "domain", F.col("at").alias("valid_from"), "valid_to")


def match_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_on") -> DataFrame:
    """(page_id, host, fetched_on, blocked, n_active, domain, list_name) of every capture.

    ``n_active`` counts the distinct (list, domain) pairs that hold for the
    capture, ``domain`` and ``list_name`` are the most specific one's (longest
    domain, then first by names), null if none holds.  Fetch times are compared
    as they are, dates as their first moment; an interval is inclusive at the
    start and exclusive at the end.  A capture without a host or time is not
    blocked.  Repeated captures each get a row; an empty list blocks nothing;
    an empty table gives no rows.  Other columns are ignored.
    """
    own = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(at_col).alias("fetched_on"), F.col(at_col).cast("timestamp").alias("_at"))
    asked = own.where("host is not null and _at is not null").select("host", "_at").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    month = lambda c: F.date_trunc("month", c)
    asked = asked.select("host", "_at", F.explode(above).alias("domain"), month(F.col("_at")).alias("_month"))
    # an open interval is followed up to the last fetch
    last = own.agg(F.unix_micros(F.max("_at"))).first()[0]
    spans = validity_intervals(entries).select("list_name", F.col("domain").alias("_domain"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    spans = spans.withColumn("_end", F.least(F.col("_to"), F.timestamp_micros(F.lit(last).cast("long"))))
    spans = spans.where(F.col("_from") <= F.col("_end")).withColumn("_in", F.explode(F.sequence(month(F.col("_from")), month(F.col("_end")), F.expr("interval 1 month"))))
    hits = asked.join(
        spans,
        (F.col("domain") == F.col("_domain")) & (F.col("_month") == F.col("_in")) & (F.col("_at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to"))),
    )
    best = F.min(F.struct((-F.length("domain")).alias("k"), F.col("domain").alias("domain"), F.col("list_name").alias("list_name")))
    found = hits.groupBy(F.col("host").alias("_host"), F.col("_at").alias("_on")).agg(F.count("*").alias("_n"), best.alias("_best"))
    return own.join(found, (F.col("host") == F.col("_host")) & (F.col("_at") == F.col("_on")), "left").select(
        "page_id", "host", "fetched_on", F.col("_n").isNotNull().alias("blocked"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_active"), "_best.domain", "_best.list_name"
    )
