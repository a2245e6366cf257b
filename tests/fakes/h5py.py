"""Stands for h5py in tests: a file is a pickled tree of groups (dict), datasets (numpy arrays) and attributes (under ATTRS)."""

from __future__ import annotations

import pickle

import numpy as np

ATTRS = "\0attrs"


def check_vlen_dtype(dtype):
    return (dtype.metadata or {}).get("vlen")


class Dataset:
    def __init__(self, data, attrs, ragged):
        self._data, self.attrs = data, attrs
        self.dtype = np.dtype(object, metadata={"vlen": ragged}) if ragged is not None else data.dtype
        self.shape, self.ndim = data.shape, data.ndim

    def __len__(self):
        return len(self._data)

    def __getitem__(self, key):
        return self._data[key]


class Group:
    def __init__(self, tree):
        self._tree = tree
        self.attrs = tree.get(ATTRS, {})

    def _wrapped(self, node):
        if isinstance(node, dict):
            return Group(node)
        data, attrs, ragged = node
        return Dataset(data, attrs, ragged)

    def __iter__(self):
        return iter(sorted(k for k in self._tree if k != ATTRS))

    def __getitem__(self, path):
        node = self._tree
        for step in path.strip("/").split("/"):
            node = node[step]
        return self._wrapped(node)

    def __contains__(self, path):
        try:
            self[path]
        except KeyError:
            return False
        return True

    def get(self, path, default=None):
        return self[path] if path in self else default

    def visititems(self, visit, prefix=""):
        for name in self:
            visit(f"{prefix}{name}", self[name])
            if isinstance(self[name], Group):
                self[name].visititems(visit, f"{prefix}{name}/")


class File(Group):
    def __init__(self, path, mode="r"):
        with open(path, "rb") as f:
            super().__init__(pickle.load(f))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def write(path, tree):
    with open(path, "wb") as f:
        pickle.dump(tree, f)
