"""A sharded count index in the shared folder: built by executors, probed by documents' tasks.

Keys are dealt by hash into shards of bounded size; a task per shard lays a
minimal perfect hash and its arrays into one file.  Tasks open the shards that
their keys need and hold at most ``CACHE_BYTES`` of them, so the index is never
broadcast and never on the driver, which sees one file name per shard.

An index that fits this cache is probed by the tasks that read the documents.
For a larger one the probes are exchanged to the shards (:meth:`ShardIndex.routed`),
so that a shard is read by a few tasks however many documents there are.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorgraph.llm.common import open_fs, shared_path
from floorgraph.llm.mph import CountShard

KEYS_PER_SHARD = 250_000
#: Tasks that the probes of a shard are dealt to, so that a hot key is not one task's.
SPREAD = 8
#: Bytes of shards that a worker process keeps.
CACHE_BYTES = 160 << 20
_cache: OrderedDict[str, CountShard] = OrderedDict()


def _load(uri: str, keep: bool = True) -> CountShard:
    shard = _cache.pop(uri, None)
    if shard is None:
        fs, path = open_fs(uri)
        with fs.open_input_stream(path) as f:
            shard = CountShard.load(f.read())
        if not keep:
            return shard
        while _cache and sum(s.nbytes for s in _cache.values()) + shard.nbytes > CACHE_BYTES:
            _cache.popitem(last=False)
    _cache[uri] = shard
    return shard


def fits_a_task(*tables: tuple[DataFrame, int], narrow: bool = False) -> bool:
    """Whether indexes over the distinct keys of written tables, each with so many counts, fit a task's cache together.

    Then tasks probe them as they read.  Beyond that every block of rows would
    read the whole indexes anew, and probes go to the shards or a join instead.
    """
    return sum(rows.count() * ((5 if narrow else 9) + 2 * width) for rows, width in tables) <= CACHE_BYTES


def released(rows: Iterator) -> Iterator:
    """``rows``, and then the task's shards are let go, as the worker lives on."""
    try:
        yield from rows
    finally:
        _cache.clear()


class ShardIndex:
    def __init__(self, files: list[str | None], width: int):
        self.files, self.width = files, width

    def counts(self, keys: np.ndarray, marks: np.ndarray, keep: bool = True) -> np.ndarray:
        """A row of counts for each key, zeros for keys that the index lacks; shards are held for the next call if ``keep``."""
        out = np.zeros((len(keys), self.width), np.int64)
        shard = (keys % np.uint64(len(self.files))).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for places in np.split(order, cuts):
            if len(places) and (uri := self.files[shard[places[0]]]):
                out[places] = _load(uri, keep).lookup(keys[places], marks[places])
        return out

    def routed(self, probes: DataFrame, spread_by: str) -> DataFrame:
        """``probes``, which has longs ``key`` and ``mark``, plus ``counts``; answered at the shards, dealt further by ``spread_by``."""
        shard = _shard_of(len(self.files)).alias("_shard")
        dealt = probes.select("*", shard).repartition("_shard", F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))).sortWithinPartitions("_shard")
        schema = T.StructType([*probes.schema, T.StructField("counts", T.ArrayType(T.LongType()))])
        key, mark = (probes.columns.index(c) for c in ("key", "mark"))

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [np.ascontiguousarray(batch.column(k).to_numpy()).view(np.uint64) for k in (key, mark)]
                counts = pa.array(list(self.counts(*at)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=schema.names)

        return dealt.mapInArrow(lambda batches: released(answer(batches)), schema)


def _shard_of(n: int) -> Column:
    """Shard of a ``key``: the unsigned remainder, as the probes take it."""
    high, low = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(high, F.lit(n)) * F.lit((1 << 32) % n) + low, F.lit(n))


def build_index(rows: DataFrame, counts: list[str], keys_per_shard: int = KEYS_PER_SHARD, narrow: bool = False) -> ShardIndex:
    """Index of ``rows``: distinct longs ``key`` with a long ``mark`` and the named counts.

    ``rows`` is read twice (to count and to build), so it should be a written
    table.  A ``narrow`` index keeps 32 bits of the marks: a key that it lacks is
    taken for one that it has once in four billion probes.
    """
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // keys_per_shard))
    base = shared_path(spark, "index")

    def build(shard: tuple, group: pd.DataFrame) -> pd.DataFrame:
        made = CountShard.build(
            group["key"].to_numpy(np.int64).view(np.uint64), group["mark"].to_numpy(np.int64).view(np.uint64), group[counts].to_numpy(np.int64), narrow
        )
        uri = f"{base}/{shard[0]}-{uuid.uuid4().hex}.npz"  # an attempt's own name
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(made.dump())
        return pd.DataFrame({"shard": [shard[0]], "uri": [uri]})

    dealt = rows.select("key", "mark", *counts, _shard_of(n).alias("shard"))
    files: list[str | None] = [None] * n
    for r in dealt.groupBy("shard").applyInPandas(build, "shard long, uri string").collect():  # a name per shard
        files[r.shard] = r.uri
    return ShardIndex(files, len(counts))


def batches_of(values: Iterator, limit: int) -> Iterator[list]:
    """Runs of (value, weight) pairs of about ``limit`` weight."""
    held, total = [], 0
    for value, weight in values:
        held.append(value)
        total += weight
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
