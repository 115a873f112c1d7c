"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to the same number of bits, every
row gets its index on the Hilbert curve through that grid, the rows are put in
curve order, and the order is cut into runs.  Each run covers a compact region
of the metadata space, so the per-shard minima and maxima that
:func:`write_shards` keeps let a reader skip most files for a predicate on
*any* of the dimensions (:func:`prune`), not just on the leading sort column.

Everything but the two tiny tables of per-partition totals is row-local or one
range exchange over narrow rows (no text): the order's keys end in the row's
own id, so a hot cell, source or text is cut like any other range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.llm.common import utf8_bytes, written

LAWS = ("rows", "bytes")


def quantise(col: Column, bits: int, low: float, high: float) -> Column:
    """Cell 0 to 2**bits - 1 of a number; nulls and what lies below go to 0."""
    cells, span = 1 << bits, max(high - low, 1e-12)
    cell = F.floor((col.cast("double") - F.lit(float(low))) / F.lit(span) * cells)
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(cells - 1), cell)), F.lit(0)).cast("int")


def quantise_hash(col: Column, bits: int) -> Column:
    """Cell of a category: the same value always falls in the same cell; null in 0."""
    return F.when(col.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(col), F.lit(1 << bits))).cast("int")


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a grid point, as a long.

    The transposed form of the curve is reached by Skilling's in-place
    exchange and Gray-code steps, unrolled to one SQL expression per bit level;
    ``transform`` binds each level's result so that the expression stays linear.
    """
    n = len(cells)
    if n * bits > 62:
        raise ValueError("dimensions times bits must be at most 62")
    state = F.array(*[c.cast("long") for c in cells])

    def bound(value: Column, f) -> Column:
        return F.element_at(F.transform(F.array(value), f), 1)

    def exchange(q: int, i: int):
        p = q - 1

        def step(x: Column) -> Column:
            first, own = x[0], x[i]
            swap = first.bitwiseXOR(own).bitwiseAND(F.lit(p))
            set_ = own.bitwiseAND(F.lit(q)) != 0
            new_first = F.when(set_, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap))
            new_own = own if i else new_first
            if i:
                new_own = F.when(set_, own).otherwise(own.bitwiseXOR(swap))
            return F.array(*[new_first if k == 0 else new_own if k == i else x[k] for k in range(n)])

        return step

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            state = bound(state, exchange(1 << level, i))

    def gray(x: Column) -> Column:
        out = [x[0]]
        for k in range(1, n):
            out.append(x[k].bitwiseXOR(out[-1]))
        return F.array(*out)

    state = bound(state, gray)

    def flip(x: Column) -> Column:
        t = F.lit(0).cast("long")
        for level in range(bits - 1, 0, -1):
            q = 1 << level
            t = F.when(x[n - 1].bitwiseAND(F.lit(q)) != 0, t.bitwiseXOR(F.lit(q - 1))).otherwise(t)
        return F.array(*[x[k].bitwiseXOR(t) for k in range(n)])

    state = bound(state, flip)

    def interleave(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for level in range(bits - 1, -1, -1):
            for k in range(n):
                bit = F.shiftright(x[k], level).bitwiseAND(F.lit(1))
                out = F.shiftleft(out, 1).bitwiseOR(bit)
        return out

    return bound(state, interleave)


def curve_order(rows: DataFrame, order: Sequence[str], size: str, with_bytes: bool = False) -> DataFrame:
    """``rows`` plus their place in the total order: ``_before_rows`` (and ``_before_bytes``) and the totals.

    One range exchange; the ordered rows are written to the shared folder, as a
    second evaluation could draw other range bounds.  Only one total per range
    partition is gathered.  Running bytes cost an exchange of their own and are
    added on request only.
    """
    ordered = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "curve",
    )
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(size).alias("_b"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"),
        F.sum("_n").over(every).alias("_total"),
        F.sum("_b").over(every).alias("_all_bytes"),
    )
    if with_bytes:
        own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        ordered = ordered.withColumn("_bytes_at", F.coalesce(F.sum(size).over(own), F.lit(0)))
    placed = ordered.join(F.broadcast(starts), "_part")  # one row for each range partition
    placed = placed.withColumn("_before_rows", F.col("_n0") + F.col("_at"))
    return placed.withColumn("_before_bytes", F.col("_b0") + F.col("_bytes_at")) if with_bytes else placed


def hilbert_shards(
    docs: DataFrame,
    n_shards: int,
    law: str = "rows",
    bits: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    size_overhead: int = 16,
    max_log_size: float = 40.0,
) -> DataFrame:
    """Shard, slot and curve index of every document.

    Dimensions: log2 of the size, a hash cell of ``lang`` and a hash cell of
    ``source``, each of ``bits`` bits; a column that the table lacks counts as
    null.  The id is none, so zone maps do not prune on it.  ``law`` "rows" cuts the order into runs
    whose counts differ by one at most; "bytes" cuts at equal shares of the
    summed size, so that a shard is off by at most one document.

    Order: curve index, CRC-32 of the text, size, id; equal rows are
    interchangeable, so repeats of a row get neighbouring slots.  Null texts
    have size ``size_overhead`` and the CRC of the empty text; null ids sort
    first.  An empty table gives no rows.  Other columns are ignored, so their
    names cannot clash.  Groups (equal texts) are not kept together across a
    cut: under these laws a group of a third of all rows has to span shards.
    """
    placed = _cut(docs, n_shards, law, bits, id_col, text_col, size_overhead, max_log_size)
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "curve_index")


def _cut(docs: DataFrame, n_shards: int, law: str, bits: int, id_col: str, text_col: str, size_overhead: int, max_log_size: float, whole: bool = False) -> DataFrame:
    """Every row's place on the curve and in its shard; with ``whole`` the row itself, as ``_row``."""
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    have = set(docs.columns)
    meta = lambda name: F.col(name).cast("string") if name in have else F.lit(None).cast("string")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (utf8_bytes(F.col(text_col)) + size_overhead).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        meta("lang").alias("_lang"),
        meta("source").alias("_source"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []),
    )
    cells = [
        quantise(F.log2(F.col("size")), bits, 0.0, max_log_size),
        quantise_hash(F.col("_lang"), bits),
        quantise_hash(F.col("_source"), bits),
    ]
    rows = narrow.withColumn("curve_index", hilbert_index(cells, bits)).drop("_lang", "_source")
    placed = curve_order(rows, ["curve_index", "text_crc32", "size", "doc_id"], "size", with_bytes=law == "bytes")
    if law == "rows":
        # shard s holds places ceil(s*N/n) up to ceil((s+1)*N/n) - 1
        return placed.withColumn("shard", F.expr(f"_before_rows * {n_shards} div _total").cast("int")).withColumn(
            "slot", F.expr(f"_before_rows - (shard * _total + {n_shards - 1}) div {n_shards}").cast("long")
        )
    middle = F.expr(f"(_before_bytes * 2 + size) * {n_shards} div (_all_bytes * 2)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("_before_rows").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_before_rows") - F.col("_first"))


def _fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with as many underscores behind it as tell it from the columns there are, in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def write_shards(
    docs: DataFrame,
    n_shards: int,
    path: str,
    dims: Sequence[str],
    law: str = "rows",
    bits: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_file: int = 1_000_000,
) -> DataFrame:
    """Write ``docs`` as a folder for each shard and return the zone map: shard, n_rows, and per dimension least, greatest and number of nulls.

    The shards are those of :func:`hilbert_shards`.  The rows themselves go
    along the curve, so each is stored once, whatever ids repeat.  The folder
    column is ``shard``, the place in the shard ``slot``; if ``docs`` has a
    column of such a name, underscores are put behind the new one.  A shard is
    dealt to tasks by runs of ``rows_per_file`` slots.  An empty table writes
    no shard and gives no rows.
    """
    shard, slot = _fresh("shard", docs.columns), _fresh("slot", docs.columns)
    placed = _cut(docs, n_shards, law, bits, id_col, text_col, 16, 40.0, whole=True)
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    run = F.floor(F.col(slot) / rows_per_file)
    rows = placed.select(*columns, F.col("shard").alias(shard), F.col("slot").alias(slot))
    runs = max(n_shards, -(-docs.count() // rows_per_file) + n_shards)
    rows.repartition(runs, shard, run).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    schema = rows.select(*[c for c in rows.columns if c != shard], shard).schema
    stored = docs.sparkSession.read.schema(schema).parquet(path)
    bounds = [f(F.col(f"`{c}`")).alias(f"{c}_{name}") for c in dims for name, f in (("min", F.min), ("max", F.max))]
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}_nulls") for c in dims]
    return stored.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("n_rows"), *bounds, *nulls)


def prune(zones: DataFrame, **ranges: tuple) -> DataFrame:
    """Shards that can hold rows whose every named dimension lies within its inclusive range.

    A null is in no range, so a shard whose rows have only nulls there is left
    out; a bound of None is open.  No range: all shards.
    """
    for name, (low, high) in ranges.items():
        zones = zones.where(F.col(f"{name}_max").isNotNull())
        if low is not None:
            zones = zones.where(F.col(f"{name}_max") >= F.lit(low))
        if high is not None:
            zones = zones.where(F.col(f"{name}_min") <= F.lit(high))
    return zones.select("shard")
