"""A Markov-chain run: its configuration, its chains, and the operators on them."""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.chains import ChainSet, read_chains
from ..sources.config import MCMCConfig, ModelParameter, parse_mcmc_config
from . import convergence, mixing, parameters, summaries


class MCMCRun:
    def __init__(self, spark: SparkSession, config: MCMCConfig) -> None:
        self.spark, self.config = spark, config

    @property
    def parameters(self) -> tuple[ModelParameter, ...]:
        return self.config.parameters

    @functools.cached_property
    def chains(self) -> ChainSet:
        """Read when first asked for, and kept."""
        return read_chains(self.spark, self.config)

    def _on_chains(self, f, *args, **options):
        return f(self.chains, *args, **options)

    def convergence_step(self, *, threshold: float = 1.1, sustained_for: int = 1, **options) -> int | None:
        """The number of steps after which the chains have converged."""
        result = self.gelman_rubin(**options)
        at = convergence.convergence_step(result.Rhat_c_max(), threshold=threshold, sustained_for=sustained_for)
        return None if at is None else result.steps[at]

    def write_parameter_file(self, state, path: str | Path, *, likelihood_index: int = 0) -> Path:
        all_leaves = parameters.leaves(self.config)
        if not 0 <= likelihood_index < len(all_leaves):
            raise IndexError(f"likelihood {likelihood_index} of {len(all_leaves)}")
        return parameters.write_parameter_file_to(parameters.filled(self.config, all_leaves[likelihood_index], state), path)

    def write_parameter_files(self, state, out_dir: str | Path, *, name_format: str | None = None) -> list[tuple[int, Path]]:
        return parameters.emit_parameter_files(state, self.config, out_dir, name_format=name_format)

    def __repr__(self) -> str:
        return f"MCMCRun({self.config.config_path.name}, {len(self.config.parameters)} parameters)"

    def __enter__(self) -> MCMCRun:
        return self

    def __exit__(self, *_: object) -> None:
        if "chains" in self.__dict__:
            self.chains.rows.unpersist()


def _method(f):
    @functools.wraps(f)
    def call(self, *args, **options):
        return self._on_chains(f, *args, **options)

    return call


for _f in (
    convergence.gelman_rubin, convergence.geweke, convergence.outlier_chains, mixing.acceptance_rate, mixing.acceptance_rate_trace, mixing.autocorrelation_time, mixing.effective_sample_size,
    mixing.autocorrelation_function, summaries.maximum_posterior, summaries.maximum_likelihood, summaries.posterior_samples, summaries.projection_pursuit, summaries.multivariate_normal_fit, summaries.corner_plot,
):
    setattr(MCMCRun, _f.__name__, _method(_f))


def open_mcmc(spark: SparkSession, config_path: str | Path) -> MCMCRun:
    return MCMCRun(spark, parse_mcmc_config(config_path))
