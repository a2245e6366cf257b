"""Summaries of the posterior: best states, draws, projection pursuit, a normal fit, points for corner plots."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.chains import ChainSet
from ..sources.config import ModelParameter, PriorSpec
from .convergence import resolve_post_burn


@dataclass(frozen=True)
class MaxResult:
    state: np.ndarray
    log_posterior: float
    log_likelihood: float
    chain_index: int
    step: int
    parameter_names: tuple[str, ...]


def best_row(rows: DataFrame, column: str) -> DataFrame:
    """The row with the largest value; ties go to the first chain, then the first row. Chains with a NaN are left out, and so are rows at minus infinity."""
    spoilt = rows.where(F.isnan(column)).select("chain_pos").distinct()
    good = rows.join(F.broadcast(spoilt), "chain_pos", "left_anti").where(F.col(column) > float("-inf"))
    return good.orderBy(F.desc(column), "chain_pos", "row_idx").limit(1)


def _maximum(chains: ChainSet, column: str, drop_chains: Sequence[int]) -> MaxResult:
    best = best_row(chains.without(drop_chains).rows, column).first()
    if best is None:
        raise ValueError(f"no chain has a finite {column}")
    return MaxResult(np.array(best["state"], float), best["log_posterior"], best["log_likelihood"], best["chain_index"], best["step"], chains.config.parameter_names)


def maximum_posterior(chains: ChainSet, *, drop_chains: Sequence[int] = ()) -> MaxResult:
    return _maximum(chains, "log_posterior", drop_chains)


def maximum_likelihood(chains: ChainSet, *, drop_chains: Sequence[int] = ()) -> MaxResult:
    return _maximum(chains, "log_likelihood", drop_chains)


def pooled(chains: ChainSet, post_burn: int | None, drop_chains: Sequence[int]) -> tuple[DataFrame, int]:
    """The rows after the burn-in with pool_row, their number in chain order, and how many there are.

    A chain's offset comes from the chains' own table, so nothing is sorted as a whole.
    """
    kept = chains.without(drop_chains).post_burn(resolve_post_burn(chains, post_burn))
    offsets, total = [], 0
    for pos, _, _, n in kept.table:
        offsets.append((pos, total))
        total += n
    table = chains.rows.sparkSession.createDataFrame(offsets, "chain_pos int, offset long")
    return kept.rows.join(F.broadcast(table), "chain_pos").withColumn("pool_row", F.col("offset") + F.col("row_idx")).drop("offset"), total


@dataclass(frozen=True)
class PosteriorSamples:
    state: np.ndarray
    log_posterior: np.ndarray
    log_likelihood: np.ndarray
    chain_index: np.ndarray
    step: np.ndarray
    parameter_names: tuple[str, ...]


def drawn(pool: DataFrame, picks: Sequence[int]) -> DataFrame:
    """The pool's rows by number, in the order drawn, with repeats."""
    wanted = pool.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(picks)], "draw_pos long, pool_row long")
    return pool.join(F.broadcast(wanted) if len(picks) <= 1_000_000 else wanted, "pool_row")


def posterior_samples(chains: ChainSet, n: int, *, post_burn: int | None = None, drop_chains: Sequence[int] = (), rng: np.random.Generator | None = None, replace: bool | None = None) -> PosteriorSamples:
    """Rows drawn evenly from all chains; with repeats if there are fewer than asked for. The row numbers are drawn on the driver by the generator."""
    if n <= 0:
        raise ValueError(f"n must be positive; got {n}")
    pool, total = pooled(chains, post_burn, drop_chains)
    if not total:
        raise ValueError("there are no rows to draw from")
    again = n > total if replace is None else replace
    if n > total and not again:
        raise ValueError(f"{n} rows cannot be drawn from {total} without repeats")
    picks = (np.random.default_rng() if rng is None else rng).choice(total, size=n, replace=again)
    rows = drawn(pool, picks.tolist()).orderBy("draw_pos").select("state", "log_posterior", "log_likelihood", "chain_index", "step").toPandas()
    return PosteriorSamples(np.array(rows["state"].tolist(), float), rows["log_posterior"].to_numpy(float), rows["log_likelihood"].to_numpy(float), rows["chain_index"].to_numpy(np.int64), rows["step"].to_numpy(np.int64), chains.config.parameter_names)


def moments(rows: DataFrame, n_params: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and sample covariance of the states, by built-in aggregates."""
    x = [F.element_at("state", i + 1) for i in range(n_params)]
    pairs = [(i, j) for i in range(n_params) for j in range(i, n_params)]
    r = rows.agg(F.count("*"), *[F.avg(v) for v in x], *[F.covar_samp(x[i], x[j]) for i, j in pairs]).first()
    cov = np.full((n_params, n_params), np.nan)
    for (i, j), v in zip(pairs, r[1 + n_params :], strict=True):
        cov[i, j] = cov[j, i] = np.nan if v is None else v
    return r[0], np.array([np.nan if v is None else v for v in r[1 : 1 + n_params]], float), cov


def prior_variance(prior: PriorSpec | None, name: str) -> float:
    if prior is not None and prior.kind == "uniform":
        return (float(prior.params["limitUpper"]) - float(prior.params["limitLower"])) ** 2 / 12
    if prior is not None and prior.kind == "normal" and not {"limitLower", "limitUpper"} & set(prior.params):
        return float(prior.params["variance"])
    raise NotImplementedError(f"the variance of the prior of {name!r} is not known")


def _scales(parameters: Sequence[ModelParameter]) -> np.ndarray:
    out = []
    for p in parameters:
        if p.mapper != "identity":
            raise NotImplementedError(f"mapper {p.mapper!r} of {p.name!r} is not supported")
        v = prior_variance(p.prior, p.name)
        if not v > 0:
            raise ValueError(f"the prior of {p.name!r} has variance {v}")
        out.append(math.sqrt(v))
    return np.array(out)


@dataclass(frozen=True)
class ProjectionPursuitResult:
    """Directions in units of the priors' widths, the best constrained first; a direction's sign has no meaning."""

    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    parameter_names: tuple[str, ...]
    parameter_labels: tuple[str, ...]
    prior_sigma: np.ndarray

    def direction(self, index: int, *, contribution_minimum: float = 0.05) -> list[tuple[str, float]]:
        v = self.eigenvectors[:, index]
        return sorted(((label, float(x)) for label, x in zip(self.parameter_labels, v, strict=True) if x * x >= contribution_minimum), key=lambda t: -abs(t[1]))

    def latex_summary(self, index: int, *, contribution_minimum: float = 0.05, precision: int = 3) -> str:
        text = ""
        for label, x in self.direction(index, contribution_minimum=contribution_minimum):
            sign = "- " if x < 0 else "+ " if text else ""
            text += f"{' ' if text else ''}{sign}{abs(x):.{precision}f}\\,{label}"
        return text


def projection_pursuit(chains: ChainSet, *, post_burn: int | None = None, drop_chains: Sequence[int] = ()) -> ProjectionPursuitResult:
    parameters = chains.config.parameters
    sigma = _scales(parameters)
    rows, total = pooled(chains, post_burn, drop_chains)
    if total < 2:
        raise ValueError(f"two rows are needed at least; got {total}")
    _, _, cov = moments(rows, len(parameters))
    values, vectors = np.linalg.eigh(cov / np.outer(sigma, sigma))
    return ProjectionPursuitResult(values, vectors, chains.config.parameter_names, tuple(p.display_label for p in parameters), sigma)


@dataclass(frozen=True)
class MVNFit:
    mean: np.ndarray
    covariance: np.ndarray
    cholesky: np.ndarray
    parameter_names: tuple[str, ...]

    def write_reparameterization_config(self, out_path: str | Path, *, n_sigma: float = 5.0, perturber_scale: float = 1.0e-5) -> Path:
        """XML in which independent unit-normal parameters are active and the original ones derive from them."""
        if n_sigma <= 0 or perturber_scale <= 0:
            raise ValueError("n_sigma and perturber_scale must be positive")
        if not self.parameter_names:
            raise ValueError("the fit has no parameters")
        meta = [f"metaParameter{i}" for i in range(len(self.parameter_names))]
        root = ET.Element("parameters")

        def tree(parent: ET.Element, nodes: list) -> None:
            for tag, value, below in nodes:
                tree(ET.SubElement(parent, tag, value=value), below)

        for name in meta:
            prior = [("mean", "0.0", []), ("variance", "1.0", []), ("limitLower", f"{-n_sigma:.6g}", []), ("limitUpper", f"{n_sigma:.6g}", [])]
            step = [("median", "0.0", []), ("scale", f"{perturber_scale:.6g}", [])]
            tree(root, [("modelParameter", "active", [("name", name, []), ("distributionFunction1DPrior", "normal", prior), ("operatorUnaryMapper", "identity", []), ("distributionFunction1DPerturber", "cauchy", step)])])
        for name, mean, row in zip(self.parameter_names, self.mean, self.cholesky, strict=True):
            terms = "".join(f"{x:+.16g}*%[{m}]" for x, m in zip(row.tolist(), meta, strict=True) if x != 0)
            tree(root, [("modelParameter", "derived", [("name", name, []), ("definition", f"{mean:.16g}{terms}", [])])])
        ET.indent(root)
        out = Path(out_path)
        out.parent.mkdir(parents=True, exist_ok=True)
        ET.ElementTree(root).write(out, encoding="utf-8", xml_declaration=True)
        return out.resolve()


def multivariate_normal_fit(chains: ChainSet, *, post_burn: int | None = None, drop_chains: Sequence[int] = ()) -> MVNFit:
    rows, total = pooled(chains, post_burn, drop_chains)
    p = chains.n_params
    if total < p + 1:
        raise ValueError(f"{p + 1} rows are needed at least; got {total}")
    _, mean, cov = moments(rows, p)
    return MVNFit(mean, cov, np.linalg.cholesky(cov), chains.config.parameter_names)


def corner_data(chains: ChainSet, parameters: Iterable[str] | None = None, post_burn: int | None = None, drop_chains: Sequence[int] = ()) -> DataFrame:
    """The pooled rows, one column per chosen parameter."""
    names = list(chains.config.parameter_names)
    wanted = names if parameters is None else list(parameters)
    if unknown := [p for p in wanted if p not in names]:
        raise KeyError(f"no parameter {unknown[0]!r}")
    rows, _ = pooled(chains, post_burn, drop_chains)
    return rows.select("pool_row", *[F.element_at("state", names.index(p) + 1).alias(p) for p in wanted])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0), n of the values in [low, high)."""
    inside = df.where((F.col(f"`{column}`") >= low) & (F.col(f"`{column}`") < high))
    return inside.groupBy((F.width_bucket(F.col(f"`{column}`"), F.lit(low), F.lit(high), F.lit(bins)) - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def corner_plot(chains: ChainSet, *, parameters: Iterable[str] | None = None, post_burn: int | None = None, drop_chains: Sequence[int] = (), labels: Sequence[str] | None = None, **options):
    """Drawn by the corner package if it is there."""
    try:
        import corner
    except ImportError as e:
        raise ImportError("corner plots need the corner package; corner_data() gives the points without it") from e
    wanted = list(chains.config.parameter_names if parameters is None else parameters)
    by_name = {p.name: p.display_label for p in chains.config.parameters}
    shown = [f"${by_name[p]}$" for p in wanted] if labels is None else list(labels)
    if len(shown) != len(wanted):
        raise ValueError(f"{len(shown)} labels for {len(wanted)} parameters")
    return corner.corner(corner_data(chains, wanted, post_burn, drop_chains).drop("pool_row").toPandas().to_numpy(float), labels=shown, **options)
