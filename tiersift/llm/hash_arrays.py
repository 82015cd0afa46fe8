"""Sorted hash arrays: 64-bit keys in ascending order with a 32-bit value each, cut into shards in the shared folder.

A worker maps a shard into memory where the folder is a file system's, so the pages are shared by all workers of a
machine and nothing of it is private. From other stores it loads a shard when keys fall into it, and keeps LOADED
shards at most, so its memory does not grow with the arrays.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame

#: Entries of a shard; shards that a worker holds of stores that can't be mapped.
SHARD, LOADED = 1 << 22, 4


def store(folder: str, keys: np.ndarray, values: np.ndarray) -> tuple[str, str, int]:
    """Writes one shard; returns its manifest row (path, low, n). keys: ascending, at least one."""
    path = f"{folder}/{uuid.uuid4().hex}"
    where, at = fs.FileSystem.from_uri(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    for end, data in ((".keys", keys.astype("<u8")), (".values", values.astype("<f4"))):
        with where.open_output_stream(at + end) as f:
            f.write(data.tobytes())
    return path, format(int(keys[0]), "016x"), len(keys)


def shards_of(manifest: DataFrame) -> list[tuple[str, str, int]]:
    """The manifest's rows: one for SHARD entries, which a worker names to open them."""
    return sorted((r.path, r.low, r.n) for r in manifest.collect())


class Arrays:
    def __init__(self, shards: list[tuple[str, str, int]]):
        self.shards = sorted(shards, key=lambda s: s[1])
        self.lows = np.array([int(low, 16) for _, low, _ in self.shards], np.uint64)
        self.open: OrderedDict[int, tuple[np.ndarray, np.ndarray, bool]] = OrderedDict()

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            where, at = fs.FileSystem.from_uri(self.shards[k][0])
            if mapped := isinstance(where, fs.LocalFileSystem):
                found = [np.asarray(np.memmap(at + end, kind, "r")) for end, kind in ((".keys", "<u8"), (".values", "<f4"))]
            else:
                if len(self.open) >= LOADED:
                    self.open.popitem(last=False)
                found = [np.frombuffer(where.open_input_stream(at + end).read(), kind) for end, kind in ((".keys", "<u8"), (".values", "<f4"))]
            self.open[k] = (*found, mapped)
        self.open.move_to_end(k)
        return self.open[k][:2]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The values of hashes; nan where there is none. They are looked up in ascending order, a shard at a time."""
        out = np.full(len(h), np.nan, np.float32)
        if not len(self.shards) or not len(h):
            return out
        order = np.argsort(h)
        sorted_h = h[order]
        cuts = np.searchsorted(sorted_h, self.lows).tolist() + [len(h)]
        for k in range(len(self.shards)):
            some = sorted_h[cuts[k] : cuts[k + 1]]
            if len(some):
                keys, values = self._shard(k)
                at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
                out[order[cuts[k] : cuts[k + 1]]] = np.where(keys[at] == some, values[at], np.float32(np.nan))
        return out


_opened: dict[tuple, Arrays] = {}


def opened(shards: list[tuple[str, str, int]]) -> Arrays:
    """The worker's arrays; one manifest's are kept."""
    if tuple(shards) not in _opened:
        _opened.clear()
        _opened[tuple(shards)] = Arrays(shards)
    return _opened[tuple(shards)]
