"""Point lookups, optional filters, resolution of references and aliases, ordered first rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(table: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the keys; the filter reaches the scan."""
    for name, value in keys.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def resolve_optional(requests: DataFrame, table: DataFrame, request_id: str, key: str, pairs: Mapping[str, str]) -> DataFrame:
    """Match requests whose null fields stand for "any": (request id, n_matches, status, key).

    ``pairs`` names the table column of each request column.  Status is none,
    ok or ambiguous, and the key is given where it is ok.
    """
    match = None
    for asked, column in pairs.items():
        test = requests[asked].isNull() | (requests[asked] == table[column])
        match = test if match is None else match & test
    joined = requests.join(table, match, "left")
    counted = joined.groupBy(requests[request_id].alias(request_id)).agg(F.count(table[key]).alias("n_matches"), F.min(table[key]).alias("_one"))
    n = F.col("n_matches")
    status = F.when(n == 0, "none").when(n == 1, "ok").otherwise("ambiguous")
    return counted.select(request_id, "n_matches", status.alias("status"), F.when(n == 1, F.col("_one")).alias(key))


def first_by(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def prefer(rows: DataFrame, key: str, priority: Column, ordinal: Column) -> DataFrame:
    """One row for each key: the highest priority, then the latest ordinal (later overrides earlier)."""
    return first_by(rows, [key], [priority.desc(), ordinal.desc()])


def resolve_alias(requests: DataFrame, names: DataFrame, request: str, id_col: str, request_tokens: Column, name_tokens: Column, order: Sequence[str]) -> DataFrame:
    """Entity of each requested name: the exact id first, else the first by ``order`` that shares a token, else the request itself."""
    asked = requests.select(F.col(request).alias("_request"), F.explode_outer(request_tokens).alias("_token")).distinct()
    known = names.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.explode(name_tokens).alias("_known"))
    exact = names.select(F.col(id_col).alias("_exact"))
    hits = asked.join(known, F.col("_token") == F.col("_known"))
    best = hits.groupBy("_request").agg(F.min(F.struct(*[f"_o{k}" for k in range(len(order))], "_id"))["_id"].alias("_best"))
    return (
        requests.select(F.col(request).alias("_asked")).distinct()
        .join(exact, F.col("_asked") == F.col("_exact"), "left")
        .join(best, F.col("_asked") == F.col("_request"), "left")
        .select(F.col("_asked").alias(request), F.coalesce("_exact", "_best", "_asked").alias("resolved"), F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_best").isNotNull(), "token").otherwise("echo").alias("how"))
    )


def resolve_nodes(requests: DataFrame, nodes: DataFrame, request: str, id_col: str, number_col: str, key_col: str) -> DataFrame:
    """Node of each reference: by id, else by number, else by key text; null where none fits."""
    by = lambda col, name: nodes.select(F.col(col).cast("string").alias(f"_{name}"), F.col(id_col).alias(f"_id_{name}"))
    out = requests
    for col, name in ((id_col, "a"), (number_col, "b"), (key_col, "c")):
        out = out.join(by(col, name), F.col(request) == F.col(f"_{name}"), "left")
    return out.select(*requests.columns, F.coalesce("_id_a", "_id_b", "_id_c").alias("node_id"))


def with_fallback_key(left: DataFrame, right: DataFrame, first: Column, second: Column, right_key: str, value: str) -> DataFrame:
    """Left rows with the right's ``value`` by the first key, else by the second; ``found_by`` says which."""
    a = right.select(F.col(right_key).alias("_ka"), F.col(value).alias("_va"), F.lit(True).alias("_fa"))
    b = right.select(F.col(right_key).alias("_kb"), F.col(value).alias("_vb"), F.lit(True).alias("_fb"))
    out = left.join(a, first == F.col("_ka"), "left").join(b, second == F.col("_kb"), "left")
    by = F.when(F.col("_fa"), "directed").when(F.col("_fb"), "sorted").otherwise("missing")
    return out.select(*left.columns, F.coalesce("_va", "_vb").alias(value), by.alias("found_by"))


def missing_rows(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(previous.select(*keys), list(keys), "left_anti")


def union_visible(originals: DataFrame, hidden: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Originals that are not hidden, and the manual rows whose key is not among them."""
    shown = originals.join(hidden.select(key), key, "left_anti")
    return shown.unionByName(manual.join(shown.select(key), key, "left_anti"), allowMissingColumns=True)


def free_ids(existing: DataFrame, key: str, prefix: str, n: int, width: int = 3) -> DataFrame:
    """The first ``n`` ids ``prefix_001``, ``prefix_002``, … that are not in use.

    Only the ids in use below the largest candidate matter, so the candidates
    are n more than there are ids of that prefix.
    """
    used = existing.where(F.col(key).startswith(f"{prefix}_")).select(F.col(key).alias("_used")).distinct()
    most = used.agg((F.count("*") + n).alias("m"))
    candidates = most.select(F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("number"))
    candidates = candidates.withColumn("id", F.format_string(f"{prefix}_%0{width}d", "number"))
    free = candidates.join(used, F.col("id") == F.col("_used"), "left_anti")
    return free.orderBy("number").limit(n)


def next_number(rows: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """One more than the largest trailing number in ``col``, by group; 1 without any."""
    number = F.nullif(F.regexp_extract(F.col(col), r"(\d+)$", 1), F.lit("")).cast("long")
    return rows.groupBy(*by).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))
