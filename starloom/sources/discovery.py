"""Which files belong to what is opened. File names may hold a colon, which Spark's own globbing cannot read: names are listed here, by Python."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

#: Fixed value: how the files of a run's ranks are told apart.
RANK = re.compile(r":MPI\d{4}(?=$|\.)")


def model_label(path: str | Path) -> str:
    """The file's stem without its rank."""
    return re.sub(r":MPI\d{4}$", "", Path(path).stem)


def rank_files(path: str) -> list[str]:
    """All rank files of the run that a file belongs to, in order; the file alone if there are none."""
    p = Path(path)
    base = p.with_name(model_label(p))
    peers = sorted(glob.glob(f"{glob.escape(str(base))}:MPI????{glob.escape(p.suffix)}"))
    return peers or [path]


def resolve(path: str | Path | list) -> list[str]:
    """A list is taken as it is; a name or pattern is looked up, and a single match brings its rank files with it."""
    if isinstance(path, list):
        if not path:
            raise FileNotFoundError("the list of files is empty")
        return [str(p) for p in path]
    if not isinstance(path, (str, Path)):
        raise TypeError(f"expected a path, a list of paths or a mapping; got {type(path).__name__}")
    found = sorted(glob.glob(str(path)))
    if not found and os.path.exists(str(path)):
        found = [str(path)]
    if not found:
        raise FileNotFoundError(f"nothing matches {path}")
    return rank_files(found[0]) if len(found) == 1 else found


def labelled(models: Mapping | Sequence) -> dict[str, list[str]]:
    """Labels and their files. Without labels the file stems serve, which must differ."""
    if isinstance(models, Mapping):
        return {str(k): resolve(v if not isinstance(v, tuple) else list(v)) for k, v in models.items()}
    if isinstance(models, (str, bytes, Path)) or not isinstance(models, Sequence):
        raise TypeError(f"expected a mapping or a sequence of paths; got {type(models).__name__}")
    out: dict[str, list[str]] = {}
    for item in models:
        files = resolve(list(item) if isinstance(item, tuple) else item)
        label = model_label(files[0])
        if label in out:
            raise ValueError(f"two models have the label {label!r}; pass a mapping to name them")
        out[label] = files
    return out


def output_name(output: str | int) -> str:
    """An integer n means Output{n}: a name, not a position."""
    import numbers

    return f"Output{int(output)}" if isinstance(output, numbers.Integral) and not isinstance(output, bool) else str(output)
