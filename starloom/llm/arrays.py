"""Sorted arrays in shared files, cut into shards by the keys' first bits, mapped into memory by workers."""

from __future__ import annotations

import os
import tempfile
import urllib.parse
import uuid

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def cut(data: bytes, offsets: np.ndarray) -> pa.Array:
    """Joined bytes as one row from each offset to the next."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, an index of each, and its summed weight (or number)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(k))) if weights is None else np.add.reduceat(weights[order], first) if len(k) else np.zeros(0, np.int64)
    return k[first], order[first], n


def shard_edges(keys: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    """Where each shard begins in ascending `bits`-bit keys, and the end. shards: a power of two."""
    firsts = np.arange(shards, dtype=np.uint64) << np.uint64(bits - (shards.bit_length() - 1)) if shards > 1 else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def local_path(uri: str) -> str | None:
    """A mounted folder's path, or None if the uri is of another store."""
    at = urllib.parse.urlparse(uri)
    return urllib.parse.unquote(at.path) if at.scheme in ("", "file") else None


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Writes an array whole or not at all, so a task that runs twice does no harm."""
    data = np.ascontiguousarray(values)
    if (at := local_path(folder)) is not None:
        os.makedirs(at, exist_ok=True)
        own = f"{at}/.{name}.{uuid.uuid4().hex}"
        data.tofile(own)
        os.replace(own, f"{at}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(memoryview(data).cast("B"))


def mapped(folder: str, name: str, kind: str, held: dict[str, str]) -> np.ndarray:
    """The array, mapped into memory; empty if there is none. held: remembers the folder of local copies, where the store is not mounted."""
    at = local_path(folder)
    if at is None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        if "dir" not in held:
            held["dir"] = tempfile.mkdtemp()
        at = held["dir"]
        if not os.path.exists(f"{at}/{name}") and store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            fs.copy_files(f"{root}/{name}", f"{at}/{name}", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
    path = f"{at}/{name}"
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.zeros(0, kind)
    return np.memmap(path, kind, "r")


class Lookup:
    """Sorted arrays of keys, each with arrays of values."""

    def __init__(self, folder: str, stem: str, shards: int, bits: int = 64, values: dict[str, str] | None = None) -> None:
        held: dict[str, str] = {}
        self.keys = [mapped(folder, f"{stem}.{s}.key", "<u8", held) for s in range(shards)]
        self.values = {v: [mapped(folder, f"{stem}.{s}.{v}", kind, held) for s in range(shards)] for v, kind in (values or {}).items()}
        self.shards, self.bits = shards, bits

    def _find(self, distinct: np.ndarray):
        edges = shard_edges(distinct, self.shards, self.bits)
        for s, own in enumerate(self.keys):
            i, j = edges[s], edges[s + 1]
            if i < j and len(own):
                at = np.minimum(np.searchsorted(own, distinct[i:j]), len(own) - 1)
                yield s, i, j, at, own[at] == distinct[i:j]

    def __call__(self, keys: np.ndarray, default: dict[str, float]) -> dict[str, np.ndarray]:
        """The values of each key, or the defaults where it is missing."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        out = {v: np.full(len(distinct), default[v], np.float64) for v in self.values}
        for s, i, j, at, hit in self._find(distinct):
            for v, arrays in self.values.items():
                out[v][i:j][hit] = arrays[s][at[hit]]
        return {v: x[inverse] for v, x in out.items()}

    def has(self, keys: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(keys, return_inverse=True)
        found = np.zeros(len(distinct), bool)
        for _, i, j, _, hit in self._find(distinct):
            found[i:j] = hit
        return found[inverse]
