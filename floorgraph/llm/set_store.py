"""Sets of 64-bit hashes in the shared folder: written by executors, fetched set by set by tasks.

Sets are dealt by number into files of bounded size, each with a directory.  A
task reads the directories and the byte ranges that it asks for and holds at
most ``CACHE_BYTES`` of them; the driver sees one file name per file.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorgraph.llm.common import open_fs, shared_path

FILE_BYTES, CACHE_BYTES = 8 << 20, 32 << 20
_cache: OrderedDict[tuple, np.ndarray] = OrderedDict()
_held = 0


def _keep(key: tuple, value: np.ndarray) -> np.ndarray:
    global _held
    _cache[key] = value
    _held += value.nbytes
    while _held > CACHE_BYTES and len(_cache) > 1:
        _held -= _cache.popitem(last=False)[1].nbytes
    return value


class SetStore:
    def __init__(self, files: list[str | None]):
        self.files = files

    def get(self, nodes: np.ndarray) -> dict[int, np.ndarray]:
        """The sorted hashes of each of the distinct ``nodes``, all of which the store has."""
        out: dict[int, np.ndarray] = {}
        missing: dict[int, list[int]] = {}
        for node in nodes.tolist():
            key = (self.files[node % len(self.files)], node)
            if key in _cache:
                _cache.move_to_end(key)
                out[node] = _cache[key]
            else:
                missing.setdefault(node % len(self.files), []).append(node)
        for place, wanted in missing.items():
            uri = self.files[place]
            fs, path = open_fs(uri)
            with fs.open_input_file(path) as f:
                directory = _cache.get((uri,))
                if directory is None:
                    n = int(np.frombuffer(f.read_at(8, 0), np.int64)[0])
                    directory = _keep((uri,), np.frombuffer(f.read_at(8 * (2 * n + 1), 8), np.int64))
                n = len(directory) // 2
                at = np.searchsorted(directory[:n], wanted)
                base = 8 * (2 * n + 2)
                for node, k in zip(wanted, at.tolist(), strict=True):
                    a, b = directory[n + k : n + k + 2].tolist()
                    out[node] = _keep((uri, node), np.frombuffer(f.read_at(8 * (b - a), base + 8 * a), np.uint64))
        return out


def build_store(rows: DataFrame, file_bytes: int = FILE_BYTES) -> SetStore:
    """Store of ``rows``, a written table of longs ``node`` (not negative) and binaries ``hashes``; repeated nodes have equal sets."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("hashes").cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-total // file_bytes))
    base = shared_path(rows.sparkSession, "sets")

    def build(file: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        ends = np.cumsum([0, *(len(h) // 8 for h in group["hashes"])], dtype=np.int64)
        uri = f"{base}/{file[0]}-{uuid.uuid4().hex}.sets"  # an attempt's own name
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(np.array([len(group)], np.int64).tobytes() + group["node"].to_numpy(np.int64).tobytes() + ends.tobytes())
            for h in group["hashes"]:
                f.write(h)
        return pd.DataFrame({"file": [file[0]], "uri": [uri]})

    files: list[str | None] = [None] * n
    dealt = rows.select("node", "hashes", F.pmod("node", F.lit(n)).alias("file"))
    for r in dealt.groupBy("file").applyInPandas(build, "file long, uri string").collect():  # a name per file
        files[r.file] = r.uri
    return SetStore(files)
