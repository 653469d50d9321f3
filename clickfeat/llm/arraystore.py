"""Sorted arrays in shared storage, memory-mapped by tasks.

A store is a folder with one file per (name, shard). Tasks write shards through
``pyarrow.fs`` (local mounts, HDFS, S3, ...): first under a name of their own, then
moved to the final name, so a task that runs twice leaves one whole file. Readers map
files of a mounted path directly; from any other file system a shard is copied to an
unnamed temporary file first. The pages that a lookup touches are the only part that a
task holds in memory.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlsplit

import numpy as np
from pyarrow import fs as pafs


def _open(uri: str):
    if not urlsplit(uri).scheme:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlsplit(uri).path
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, name: str, shard: int, a: np.ndarray) -> None:
    fs, path = _open(uri)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{shard}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(a).tobytes())
    fs.move(own, f"{path}/{name}-{shard}")


def get(uri: str, name: str, shard: int, kind) -> np.ndarray:
    """The array of a shard (empty if it was never written)."""
    fs, path = _open(uri)
    path = f"{path}/{name}-{shard}"
    if isinstance(fs, pafs.LocalFileSystem):
        if not os.path.exists(path) or not os.path.getsize(path):
            return np.zeros(0, kind)
        return np.memmap(path, kind, "r")
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File or not info.size:
        return np.zeros(0, kind)
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as src:
        while block := src.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, kind, "r")


#: Shards that a lookup holds mapped (each array of a shard takes a file descriptor and a map).
OPEN_SHARDS = 48


class Lookup:
    """Values of sorted keys that are dealt to shards by ``shard_of``; shards are mapped when asked for, in their order,
    and at most ``OPEN_SHARDS`` stay mapped (those asked for last), however many the store has.

    ``starts``: the number of keys in the shards before each one; with it, ``id`` is a key's place among all.
    """

    def __init__(self, uri: str, key: str, values: dict[str, object], shards: int, shard_of, starts=None):
        self.uri, self.key, self.values, self.shards, self.shard_of, self.starts = uri, key, values, shards, shard_of, starts
        self._open: dict[int, tuple] = {}

    def shard(self, s: int):
        arrays = self._open.pop(s, None) or (get(self.uri, self.key, s, np.uint64), {n: get(self.uri, n, s, k) for n, k in self.values.items()})
        while len(self._open) >= OPEN_SHARDS:
            del self._open[next(iter(self._open))]
        self._open[s] = arrays
        return arrays

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(found mask, values by name, 0 where not found) of each key; distinct keys are looked up once, in order."""
        asked, back = np.unique(keys, return_inverse=True)
        found = np.zeros(len(asked), bool)
        out = {n: np.zeros(len(asked), k) for n, k in self.values.items()}
        if self.starts is not None:
            out["id"] = np.zeros(len(asked), np.int64)
        sh = self.shard_of(asked)
        for s in np.unique(sh):
            at = np.flatnonzero(sh == s)
            have, vals = self.shard(int(s))
            if not len(have):
                continue
            pos = np.minimum(np.searchsorted(have, asked[at]), len(have) - 1)
            ok = have[pos] == asked[at]
            found[at] = ok
            for n, v in vals.items():
                out[n][at[ok]] = v[pos[ok]]
            if self.starts is not None:
                out["id"][at[ok]] = pos[ok] + self.starts[s]
        return found[back], {n: v[back] for n, v in out.items()}
