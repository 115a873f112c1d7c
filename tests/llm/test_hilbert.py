import zlib

import pytest
from pyspark.sql import functions as F

from floorgraph.llm import hilbert


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(spark, n, bits):
    side = 1 << bits
    grid = spark.range(side**n).select(*[(F.floor(F.col("id") / side**k) % side).cast("int").alias(f"c{k}") for k in range(n)])
    rows = grid.withColumn("h", hilbert.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).collect()
    by = {r["h"]: tuple(r[f"c{k}"] for k in range(n)) for r in rows}
    assert sorted(by) == list(range(side**n))
    assert all(sum(abs(a - b) for a, b in zip(by[i], by[i + 1], strict=True)) == 1 for i in range(side**n - 1))


def check(rows, pairs, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs)
    slots = {}
    for r in rows:
        assert 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return {k: len(v) for k, v in slots.items()}


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_rows_law(make_docs, odd_pairs, shards):
    counts = check(hilbert.hilbert_shards(make_docs(odd_pairs), shards).collect(), odd_pairs, shards)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_bytes_law(make_docs):
    pairs = [(i, "abc " * (i % 50)) for i in range(800)]
    rows = hilbert.hilbert_shards(make_docs(pairs), 6, law="bytes").collect()
    check(rows, pairs, 6)
    totals = {}
    for r in rows:
        totals[r.shard] = totals.get(r.shard, 0) + r.size
    assert max(totals.values()) - min(totals.values()) <= 2 * max(r.size for r in rows)


def test_order_follows_the_curve(make_docs):
    rows = hilbert.hilbert_shards(make_docs([(i, "ab " * (i % 90)) for i in range(500)]), 7).collect()
    rows.sort(key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in rows] == sorted(r.curve_index for r in rows)


def test_hot_group_and_empty_table(make_docs):
    hot = [(i, "one text for all") for i in range(300)]
    counts = check(hilbert.hilbert_shards(make_docs(hot), 40).collect(), hot, 40)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert hilbert.hilbert_shards(make_docs([]), 40).count() == 0


def test_unknown_law(make_docs):
    with pytest.raises(ValueError):
        hilbert.hilbert_shards(make_docs([]), 4, law="luck")


def test_files_are_pruned_by_any_dimension(spark, make_docs, tmp_path):
    docs = make_docs([(i, "ab " * (i % 400)) for i in range(2000)]).drop("shard", "size").withColumn("size", F.octet_length("text"))
    zones = hilbert.write_shards(docs, 16, str(tmp_path / "shards"), ["size", "source"]).cache()
    assert zones.agg(F.sum("n_rows")).first()[0] == 2000
    for ranges in ({"size": (1000, 1200)}, {"source": ("src2", "src2")}):
        name, (low, high) = next(iter(ranges.items()))
        kept = [r.shard for r in hilbert.prune(zones, **ranges).collect()]
        stored = spark.read.parquet(str(tmp_path / "shards"))
        hits = stored.where(F.col(name).between(low, high))
        assert hits.where(~F.col("shard").isin(kept)).count() == 0
        assert len(kept) < 16 or name == "source"


def test_written_rows_are_the_rows(spark, make_docs, odd_pairs, tmp_path):
    pairs = [*odd_pairs, (1, "one"), (1, "two"), (1, "one"), (1, None)]
    docs = make_docs(pairs).withColumn("Slot", F.lit("s")).withColumn("shard_", F.lit(1))
    for law in hilbert.LAWS:
        zones = hilbert.write_shards(docs, 3, str(tmp_path / law), ["size", "lang"], law=law, rows_per_file=4)
        stored = spark.read.parquet(str(tmp_path / law))
        key = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
        assert key(stored) == key(docs)
        assert {"shard__", "slot_"} <= set(stored.columns) and zones.agg(F.sum("n_rows")).first()[0] == len(pairs)
        want = hilbert.hilbert_shards(docs, 3, law=law).groupBy("shard").count()
        assert {(r.shard, r["count"]) for r in want.collect()} == {(r.shard, r.n_rows) for r in zones.collect()}
        slots = stored.groupBy("shard__").agg(F.array_sort(F.collect_list("slot_")).alias("s")).collect()
        assert all(r.s == list(range(len(r.s))) for r in slots)


def test_shards_of_nothing_and_of_nulls(spark, make_docs, tmp_path):
    zones = hilbert.write_shards(make_docs([]), 4, str(tmp_path / "none"), ["size"])
    assert zones.count() == 0 and hilbert.prune(zones, size=(0, 9)).count() == 0
    docs = make_docs([(i, None) for i in range(8)])
    zones = hilbert.write_shards(docs, 4, str(tmp_path / "nulls"), ["n_chars", "size"])
    assert [r.n_chars_nulls for r in zones.collect()] == [2] * 4
    assert hilbert.prune(zones, n_chars=(0, 9)).count() == 0 and hilbert.prune(zones).count() == 4
    assert hilbert.prune(zones, size=(7, None)).count() == 4 and hilbert.prune(zones, size=(None, 6)).count() == 0
