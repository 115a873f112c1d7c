"""The k highest rows of every group by radix selection.

Instead of sorting groups, histograms over the bits of the value find each
group's k-th value: the highest 16 bits first, then, among the rows that share
the digit in which the k-th falls, the next 16, and so on.  A histogram is an
aggregate with map-side sums, so a group of any share of all rows is no task's
alone.  Ties at the k-th value are refined in the same way over the UTF-8 bytes
of the item, two at a time, each round starting behind what all remaining ties
of the group have in common.  Only the rows selected, k and a bounded number
of ties a group, are ranked by a sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.llm.common import written

DIGIT_BITS, TIE_ROWS = 16, 1000


def common_bytes(a: Column, b: Column) -> Column:
    """Number of leading bytes that two binaries share, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def further(at: Column, step: Column) -> Column:
        fits = (at + step <= F.octet_length(a)) & (at + step <= F.octet_length(b))
        return F.when(fits & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def _with_state(rows: DataFrame, state: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` next to their group's state; Spark sends the state to all tasks only if it is small enough."""
    named = state.withColumnsRenamed({g: f"_g{k}" for k, g in enumerate(group)})
    return rows.join(named, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)])).drop(*[f"_g{k}" for k in range(len(group))])


def _kth_digit(counts: DataFrame, group: Sequence[str], digit: Column) -> DataFrame:
    """The digit of each group, in the order of ``digit``, in which the ``_need``-th row falls, or the last one, and what then is needed of it."""
    w = Window.partitionBy(*group).orderBy(digit)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = counts.withColumn("_before", before).withColumn("_last", F.lead("_n").over(w).isNull())
    return marked.where((F.col("_before") < F.col("_need")) & (F.col("_last") | (F.col("_before") + F.col("_n") >= F.col("_need"))))


def top_ranked(rows: DataFrame, group: Sequence[str], value: str, item: str, k: int, tie_rows: int = TIE_ROWS) -> DataFrame:
    """``rows`` of rank ``k`` at most in their group, with a column ``rank`` from 1: ``value`` descending, then ``item`` by its UTF-8 bytes.

    ``value`` is a long of at least zero, ``item`` a string; rows with a null in
    either take no part, null groups are groups.  Rows equal in both are
    interchangeable.  A group of fewer than ``k`` rows is returned whole, an
    empty table gives no rows.  ``rows`` is read once a round, so it should be a
    written table; it must have no columns whose names begin with ``_``.
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(item).isNotNull())
    highest = rows.agg(F.max(value)).first()[0]
    if highest is None:
        return rows.withColumn("rank", F.lit(0))
    names = list(group)
    digits = max(1, -(-max(1, highest.bit_length()) // DIGIT_BITS))
    state = None
    for shift in range((digits - 1) * DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright(value, shift)
        if state is None:
            counts = rows.groupBy(*names, digit.alias("_digit")).agg(F.count("*").alias("_n")).withColumn("_need", F.lit(k).cast("long"))
        else:  # the rows that share the digits found so far
            left = _with_state(rows, state, names).where(F.shiftright(value, shift + DIGIT_BITS) == F.col("_digit"))
            counts = left.groupBy(*names, digit.alias("_digit"), "_need").agg(F.count("*").alias("_n"))
        found = _kth_digit(counts, names, F.desc("_digit"))
        state = written(found.select(*names, "_digit", (F.col("_need") - F.col("_before")).alias("_need"), F.col("_n").alias("_open")), "radix")
    # the k-th value itself; of its ties those below ``_bound`` are in, those that begin with it (are it, if ``_whole``) are open
    state = state.withColumnRenamed("_digit", "_kth").withColumn("_bound", F.lit(b"")).withColumn("_whole", F.lit(False))
    key = F.col(item).cast("binary")
    crowd = F.col("_open") > F.greatest("_need", F.lit(tie_rows))
    while state.where(crowd).limit(1).count():
        ties = _with_state(rows.select(*names, value, key.alias("_key")), state.where(crowd), names).where((F.col(value) == F.col("_kth")) & F.startswith("_key", "_bound"))
        ends = ties.groupBy(*names).agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
        shared = written(ends.select(*names, common_bytes(F.col("_least"), F.col("_most")).alias("_at")), "radix")
        digit = F.substring(F.col("_key"), F.lit(1), F.col("_at") + 2)
        counts = _with_state(ties, shared, names).groupBy(*names, digit.alias("_digit"), "_need", "_kth", "_at").agg(F.count("*").alias("_n"))
        found = _kth_digit(counts, names, F.asc("_digit"))
        # ties of one and the same item cannot be told apart: as many as are needed are open
        need, whole = F.col("_need") - F.col("_before"), F.octet_length("_digit") < F.col("_at") + 2
        moved = found.select(*names, "_kth", need.alias("_need"), F.when(whole, need).otherwise(F.col("_n")).alias("_open"), F.col("_digit").alias("_bound"), whole.alias("_whole"))
        state = written(state.where(~crowd).select(*moved.columns).unionByName(moved), "radix")
    open_ = F.when(F.col("_whole"), key == F.col("_bound")).otherwise(F.startswith(key, F.col("_bound")))
    tie = (F.col(value) == F.col("_kth")) & ((key < F.col("_bound")) | open_)
    chosen = _with_state(rows, state, names).where((F.col(value) > F.col("_kth")) | tie).select(*rows.columns)
    w = Window.partitionBy(*names).orderBy(F.desc(value), key)
    return chosen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
