"""Parameter files: reading, addressing elements by path, setting values from a state, writing one file per likelihood."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path
from xml.etree import ElementTree as ET

import numpy as np

from ..sources.config import Likelihood, MCMCConfig, ModelParameter

#: Fixed value: a step of a path is a name, and perhaps [number] or [@value='text'].
STEP = re.compile(r"""([A-Za-z_]\w*)(?:\[(?:(\d+)|@value\s*=\s*(?:'([^']*)'|"([^"]*)"))\])?""", re.ASCII)


def steps_of(path: str) -> Iterator[tuple[str, int | None, str | None]]:
    found = [s for s in path.replace("::", "/").split("/") if s]
    if not found:
        raise ValueError(f"the parameter path {path!r} is empty")
    for step in found:
        m = STEP.fullmatch(step)
        if m is None:
            raise ValueError(f"{step!r} in {path!r} is no step of a parameter path")
        yield m[1], int(m[2]) if m[2] else None, m[3] if m[3] is not None else m[4]


def resolve_parameter_path(root: ET.Element, path: str) -> ET.Element:
    """The first element that the path leads to. Numbers count from 1."""
    at = root
    for name, number, value in steps_of(path):
        same = [c for c in at if c.tag == name and (value is None or c.get("value") == value)]
        place = (number or 1) - 1 if number != 0 else -1
        if not 0 <= place < len(same):
            raise KeyError(f"{path!r}: no such {name!r}" + (f" with value {value!r}" if value is not None else ""))
        at = same[place]
    return at


def apply_state(tree: ET.ElementTree, parameters: Sequence[ModelParameter], state: Sequence[float], *, parameter_map: Iterable[str] | None = None) -> None:
    """Sets the elements' values in place; with a map only those parameters that it names."""
    values = np.asarray(state, float)
    if values.shape != (len(parameters),):
        raise ValueError(f"the state has shape {values.shape} for {len(parameters)} parameters")
    by_name = {p.name: float(x) for p, x in zip(parameters, values, strict=True)}
    names = list(by_name) if parameter_map is None else list(parameter_map)
    if unknown := [n for n in names if n not in by_name]:
        raise KeyError(f"no active parameter {unknown[0]!r}")
    for name in names:
        resolve_parameter_path(tree.getroot(), name).set("value", repr(by_name[name]))


def read_parameter_file(path: str | Path) -> ET.ElementTree:
    if not Path(path).exists():
        raise FileNotFoundError(f"no parameter file {path}")
    return ET.parse(path)


def write_parameter_file_to(tree: ET.ElementTree, path: str | Path) -> Path:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    tree.write(out, encoding="utf-8", xml_declaration=True)
    return out.resolve()


def filled(config: MCMCConfig, leaf: Likelihood, state: Sequence[float]) -> ET.ElementTree:
    """The leaf's base file with the state in it."""
    if leaf.base_parameters_file is None:
        raise ValueError("the likelihood names no base parameter file")
    tree = copy.deepcopy(read_parameter_file(leaf.base_parameters_file))
    apply_state(tree, config.parameters, state, parameter_map=leaf.parameter_map)
    return tree


def leaves(config: MCMCConfig) -> tuple[Likelihood, ...]:
    if config.likelihood is None:
        raise ValueError("the configuration has no likelihood")
    return config.likelihood.leaves()


def emit_parameter_files(state: Sequence[float], config: MCMCConfig, out_dir: str | Path, *, name_format: str | None = None) -> list[tuple[int, Path]]:
    """A file per likelihood, named by {stem} and {leaf_index}; none may land outside out_dir."""
    all_leaves = leaves(config)
    pattern = name_format or ("{stem}.xml" if len(all_leaves) == 1 else "{leaf_index:02d}_{stem}.xml")
    folder = Path(out_dir).resolve()
    folder.mkdir(parents=True, exist_ok=True)
    written = []
    for i, leaf in enumerate(all_leaves):
        tree = filled(config, leaf, state)
        path = (folder / pattern.format(stem=leaf.base_parameters_file.stem, leaf_index=i)).resolve()
        if not path.is_relative_to(folder):
            raise ValueError(f"{path} lies outside {folder}")
        written.append((i, write_parameter_file_to(tree, path)))
    return written
