"""The XML configuration of a Markov-chain run."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree as ET

from ..functions.text import last_component


@dataclass(frozen=True)
class PriorSpec:
    kind: str
    params: dict


@dataclass(frozen=True)
class PerturberSpec:
    kind: str
    params: dict


@dataclass(frozen=True)
class ModelParameter:
    name: str
    label: str | None = None
    prior: PriorSpec | None = None
    mapper: str = "identity"
    perturber: PerturberSpec | None = None

    @property
    def display_label(self) -> str:
        return self.label or last_component(self.name)


@dataclass(frozen=True)
class Likelihood:
    kind: str
    base_parameters_file: Path | None = None
    parameter_map: tuple[str, ...] | None = None
    children: tuple[Likelihood, ...] = field(default_factory=tuple)

    def leaves(self) -> tuple[Likelihood, ...]:
        """Depth first."""
        return tuple(leaf for c in self.children for leaf in c.leaves()) if self.children else (self,)


@dataclass(frozen=True)
class MCMCConfig:
    config_path: Path
    log_file_root: Path
    simulation_kind: str
    parameters: tuple[ModelParameter, ...]
    likelihood: Likelihood | None = None

    @property
    def parameter_names(self) -> tuple[str, ...]:
        return tuple(p.name for p in self.parameters)

    @property
    def state_columns(self) -> int:
        """Columns of a log line after the six leading ones: values, and velocities of a particle swarm."""
        return len(self.parameters) * (2 if self.simulation_kind == "particleSwarm" else 1)

    def state_indices_for(self, leaf: Likelihood) -> tuple[int, ...]:
        names = self.parameter_names
        if leaf.parameter_map is None:
            return tuple(range(len(names)))
        unknown = [n for n in leaf.parameter_map if n not in names]
        if unknown:
            raise KeyError(f"the parameter map names {unknown[0]!r}, which is no active parameter")
        return tuple(names.index(n) for n in leaf.parameter_map)


def _value(parent: ET.Element, tag: str) -> str | None:
    child = parent.find(tag)
    return None if child is None else child.get("value")


def _number(raw: str | None) -> float | str | None:
    if raw is None:
        return None
    try:
        return float(raw)
    except ValueError:
        return raw.strip()


def _path(raw: str, folder: Path) -> Path:
    return Path(raw) if Path(raw).is_absolute() else folder / raw


def _distribution(node: ET.Element | None, kind: type):
    return None if node is None else kind(node.get("value") or "", {c.tag: _number(c.get("value")) for c in node if c.get("value") is not None})


def _parameter(node: ET.Element) -> ModelParameter:
    name = _value(node, "name")
    if not name:
        raise ValueError("an active modelParameter has no name")
    return ModelParameter(name, _value(node, "label"), _distribution(node.find("distributionFunction1DPrior"), PriorSpec), _value(node, "operatorUnaryMapper") or "identity", _distribution(node.find("distributionFunction1DPerturber"), PerturberSpec))


def _likelihood(node: ET.Element, folder: Path) -> Likelihood:
    """A parameterMap belongs to the next likelihood beside it."""
    children: list[Likelihood] = []
    names: tuple[str, ...] | None = None
    for child in node:
        if child.tag == "parameterMap":
            names = tuple((child.get("value") or "").split())
        elif child.tag == "posteriorSampleLikelihood":
            own = _likelihood(child, folder)
            children.append(own if names is None else Likelihood(own.kind, own.base_parameters_file, names, own.children))
            names = None
    base = _value(node, "baseParametersFileName")
    return Likelihood(node.get("value") or "", None if base is None else _path(base, folder), None, tuple(children))


def parse_mcmc_config(path: str | Path) -> MCMCConfig:
    at = Path(path).resolve()
    if not at.exists():
        raise FileNotFoundError(f"no configuration at {path}")
    root = ET.parse(at).getroot()
    if root.tag != "parameters":
        raise ValueError(f"the root element must be <parameters>; got <{root.tag}>")
    simulation = root.find("posteriorSampleSimulation")
    if simulation is None:
        raise ValueError("no <posteriorSampleSimulation> in the configuration")
    log_root = _value(simulation, "logFileRoot")
    if not log_root:
        raise ValueError("no <logFileRoot value> in <posteriorSampleSimulation>")
    active = tuple(_parameter(p) for p in simulation.findall("modelParameter") if p.get("value") == "active")
    likelihood = root.find("posteriorSampleLikelihood")
    return MCMCConfig(at, _path(log_root, at.parent), simulation.get("value") or "", active, None if likelihood is None else _likelihood(likelihood, at.parent))
