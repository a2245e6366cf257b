"""Convergence of Markov chains: corrected potential scale reduction, interval ratio, Geweke, outlying chains.

Chain rows hold chain_pos, chain_index, row_idx and state. Moments of all prefixes come from one pass: each row
belongs to the first grid step that holds it, segments are summed about a shift (the chain's first value, against
cancellation), and running sums over segments give every prefix. Quantiles do not merge; they are taken per
parameter by numpy over the chains' values, in memory of chains x rows x 8 bytes.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import NAN, or_nan, ratio, step_of
from ..sources.chains import ChainSet
from .grubbs import iterative_grubbs


def long_form(rows: DataFrame) -> DataFrame:
    """One row per chain row and parameter."""
    return rows.select("chain_pos", "chain_index", "row_idx", F.posexplode("state").alias("param_idx", "value"))


def grid_of(n_min: int, n_grid: int = 200, min_steps: int = 10, step_grid: Sequence[int] | None = None) -> list[int]:
    """The prefix lengths to look at: those given, or evenly spread ones, cut to whole numbers."""
    if min_steps < 2:
        raise ValueError(f"min_steps must be 2 at least; got {min_steps}")
    if n_min < min_steps:
        raise ValueError(f"the shortest chain has {n_min} rows, fewer than min_steps={min_steps}")
    if step_grid is not None:
        steps = [int(s) for s in step_grid]
        if any(not 2 <= s <= n_min for s in steps):
            raise ValueError(f"grid steps must lie between 2 and {n_min}")
        return steps
    return [int(s) for s in np.unique(np.linspace(min_steps, n_min, min(n_grid, n_min - min_steps + 1), dtype=int))]


def prefix_moments(rows: DataFrame, steps: Sequence[int]) -> DataFrame:
    """grid, param_idx, chain_pos with the mean and variance of the chain's first `step` values."""
    ordered = sorted(set(steps))
    values = long_form(rows.where(F.col("row_idx") < ordered[-1]))
    shift = values.where("row_idx = 0").select("chain_pos", "param_idx", F.col("value").alias("shift"))
    moved = values.join(F.broadcast(shift), ["chain_pos", "param_idx"]).withColumn("d", F.col("value") - F.col("shift")).withColumn("segment", step_of(F.col("row_idx") + 1, ordered))
    sums = moved.groupBy("chain_pos", "param_idx", "segment", "shift").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    running = Window.partitionBy("chain_pos", "param_idx").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    total = sums.select("chain_pos", "param_idx", "segment", "shift", *[F.sum(c).over(running).alias(c) for c in ("n", "s", "q")])
    grid = rows.sparkSession.createDataFrame([(g, s, ordered.index(s)) for g, s in enumerate(steps)], "grid int, step long, segment int")
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0)) / (F.col("n") - 1)
    return total.join(F.broadcast(grid), "segment").select("grid", "step", "param_idx", "chain_pos", (F.col("shift") + mean).alias("mean"), var.alias("var"))


def corrected_rhat(moments: DataFrame) -> DataFrame:
    """grid, step, param_idx, rhat from the chains' means and variances.

    The sampling variance of V carries m squared below the covariance term, and where it is not positive the
    factor (d + 3) / (d + 1) is 3: both as users of this statistic in this field are used to.
    """
    centre = Window.partitionBy("grid", "param_idx")
    x = F.col("mean")
    # about the chains' common mean, cov(s2, x^2) - 2 X cov(s2, x) is cov(s2, (x - X)^2)
    rows = moments.withColumn("grand", F.avg("mean").over(centre)).withColumn("off", (x - F.col("grand")) * (x - F.col("grand")))
    g = rows.groupBy("grid", "step", "param_idx").agg(F.count("*").cast("double").alias("m"), F.var_samp("mean").alias("vx"), F.avg("var").alias("w"), F.var_samp("var").alias("vs"), F.covar_samp("var", "off").alias("cov"))
    n, m, w = F.col("step").cast("double"), F.col("m"), F.col("w")
    b = n * F.col("vx")
    v = (n - 1) / n * w + (m + 1) / (m * n) * b
    spread = F.pow((n - 1) / n, 2) / m * F.col("vs") + F.pow((m + 1) / (m * n), 2) * 2 * b * b / (m - 1) + 2 * (m + 1) * (n - 1) / (m * m * n * n) * (n / m) * F.col("cov")
    d = F.when(spread > 0, ratio(2 * v * v, spread)).otherwise(F.lit(0.0))
    square = F.when(w > 0, (m + 1) / m * ratio(v, w) - (n - 1) / (n * m)).otherwise(F.lit(NAN))
    factor = F.when(d == float("inf"), F.lit(1.0)).otherwise((d + 3) / (d + 1))
    return g.select("grid", "step", "param_idx", F.when(square > 0, factor * F.sqrt(square)).otherwise(F.lit(NAN)).alias("rhat"))


def interval_ratio(rows: DataFrame, steps: Sequence[int], alpha: float = 0.15) -> DataFrame:
    """grid, step, param_idx, r_interval: the pooled quantile span over the mean of the chains' own."""
    low, high = alpha / 2, 1 - alpha / 2
    steps = list(steps)

    def per_parameter(group: pd.DataFrame) -> pd.DataFrame:
        chains = [part.sort_values("row_idx")["value"].to_numpy() for _, part in group.groupby("chain_pos")]
        out = []
        for g, s in enumerate(steps):
            heads = np.stack([c[:s] for c in chains])
            pooled = np.diff(np.quantile(heads, [low, high]))[0]
            own = float(np.mean(np.diff(np.quantile(heads, [low, high], axis=1), axis=0)))
            out.append((g, s, int(group["param_idx"].iloc[0]), pooled / own if own > 0 else NAN))
        return pd.DataFrame(out, columns=["grid", "step", "param_idx", "r_interval"])

    values = long_form(rows.where(F.col("row_idx") < max(steps))).select("chain_pos", "param_idx", "row_idx", "value")
    return values.groupBy("param_idx").applyInPandas(per_parameter, "grid int, step long, param_idx int, r_interval double")


@dataclass(frozen=True)
class RhatResult:
    """rows: grid, step, param_idx, param, rhat, r_interval."""

    rows: DataFrame
    steps: tuple[int, ...]
    parameter_names: tuple[str, ...]
    alpha_interval: float
    chains_used: tuple[int, ...]

    def _matrix(self, column: str) -> np.ndarray:
        out = np.full((len(self.steps), len(self.parameter_names)), NAN)
        for r in self.rows.select("grid", "param_idx", column).collect():
            out[r[0], r[1]] = NAN if r[2] is None else r[2]
        return out

    @property
    def Rhat_c(self) -> np.ndarray:
        return self._matrix("rhat")

    @property
    def R_interval(self) -> np.ndarray:
        return self._matrix("r_interval")

    def maxima(self) -> DataFrame:
        """grid, step and the largest rhat of all parameters; NaN is larger than any."""
        return self.rows.groupBy("grid", "step").agg(F.max("rhat").alias("rhat_max"))

    def Rhat_c_max(self) -> np.ndarray:
        return np.max(self.Rhat_c, axis=1)


def gelman_rubin(chains: ChainSet, *, drop_chains: Sequence[int] = (), step_grid: Sequence[int] | None = None, n_grid: int = 200, min_steps: int = 10, alpha_interval: float = 0.15) -> RhatResult:
    used = chains.without(drop_chains)
    if len(used) < 2:
        raise ValueError(f"two chains are needed at least; got {len(used)}")
    steps = grid_of(used.shortest, n_grid, min_steps, step_grid)
    rows = used.rows.where(F.col("row_idx") < used.shortest)
    both = corrected_rhat(prefix_moments(rows, steps)).join(interval_ratio(rows, steps, alpha_interval), ["grid", "step", "param_idx"])
    names = used.config.parameter_names
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("param_idx") + 1)
    return RhatResult(both.withColumn("param", label), tuple(steps), names, alpha_interval, tuple(t[1] for t in used.table))


def first_sustained(maxima: DataFrame, threshold: float = 1.1, sustained_for: int = 1) -> DataFrame:
    """From grid and rhat_max the first grid index from which so many in a row are at most the threshold; null if there is none. NaN is not."""
    if sustained_for < 1:
        raise ValueError(f"sustained_for must be 1 at least; got {sustained_for}")
    below = F.when(~F.isnan("rhat_max") & (F.col("rhat_max") <= threshold), 1).otherwise(0)
    ahead = Window.orderBy("grid").rowsBetween(0, sustained_for - 1)  # a grid has few hundred rows
    marked = maxima.select("grid", F.min(below).over(ahead).alias("all_below"), F.count("*").over(ahead).alias("n"))
    return marked.agg(F.min(F.when((F.col("all_below") == 1) & (F.col("n") == sustained_for), F.col("grid"))).alias("first_grid"))


def convergence_step(rhat_max: Sequence[float], *, threshold: float = 1.1, sustained_for: int = 1) -> int | None:
    values = np.asarray(rhat_max, float)
    if values.ndim != 1:
        raise ValueError("one value per grid step is needed")
    if sustained_for < 1:
        raise ValueError(f"sustained_for must be 1 at least; got {sustained_for}")
    good = np.concatenate([[0], np.cumsum(values <= threshold)])
    hit = np.flatnonzero(good[sustained_for:] - good[:-sustained_for] == sustained_for) if len(values) >= sustained_for else []
    return int(hit[0]) if len(hit) else None


def geweke_rows(rows: DataFrame, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """chain_pos, chain_index, param_idx, z: the means of a chain's beginning and end in units of their spread."""
    if not 0 < first < 1 or not 0 < last < 1 or first + last > 1:
        raise ValueError("first and last must lie between 0 and 1 and not overlap")
    size = rows.groupBy("chain_pos").agg(F.count("*").alias("n"))
    values = long_form(rows).join(F.broadcast(size), "chain_pos")
    n1, n2 = F.floor(F.col("n") * first), F.floor(F.col("n") * last)
    head, tail = F.when(F.col("row_idx") < n1, F.col("value")), F.when(F.col("row_idx") >= F.col("n") - n2, F.col("value"))
    g = values.groupBy("chain_pos", "chain_index", "param_idx", "n").agg(F.avg(head).alias("a1"), F.avg(tail).alias("a2"), F.var_samp(head).alias("v1"), F.var_samp(tail).alias("v2"))
    width = F.sqrt(F.col("v1") / F.greatest(n1, F.lit(1)) + F.col("v2") / F.greatest(n2, F.lit(1)))
    z = F.when((n1 >= 2) & (n2 >= 2) & (width > 0), F.try_divide(F.col("a1") - F.col("a2"), width)).otherwise(F.lit(NAN))
    return g.select("chain_pos", "chain_index", "param_idx", or_nan(z).alias("z"))


def geweke(chains: ChainSet, *, first: float = 0.1, last: float = 0.5) -> np.ndarray:
    out = np.full((len(chains), chains.n_params), NAN)
    place = {t[0]: i for i, t in enumerate(chains.table)}
    for r in geweke_rows(chains.rows, first, last).collect():
        out[place[r["chain_pos"]], r["param_idx"]] = r["z"]
    return out


def last_states(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain_pos", "chain_index").agg(F.max_by("state", "row_idx").alias("state"))


def outlier_chains(chains: ChainSet, *, alpha: float = 0.05, max_outliers: int = 10, parameters: Iterable[str] | None = None) -> tuple[int, ...]:
    """Indices of chains whose last state stands out, in the order of removal. One row per chain reaches the driver."""
    names = list(chains.config.parameter_names)
    wanted = names if parameters is None else list(parameters)
    if unknown := [p for p in wanted if p not in names]:
        raise KeyError(f"no parameter {unknown[0]!r}")
    if len(chains) < 3:
        return ()
    if empty := [t[1] for t in chains.table if t[3] == 0]:
        raise IndexError(f"chain {empty[0]} has no rows")
    rows = last_states(chains.rows).orderBy("chain_pos").collect()
    points = np.array([[r["state"][names.index(p)] for p in wanted] for r in rows], float)
    return tuple(int(rows[i]["chain_index"]) for i in iterative_grubbs(points, alpha=alpha, max_outliers=max_outliers))


def resolve_post_burn(chains: ChainSet, post_burn: int | None) -> int:
    """The rows to leave out: as given, or up to where all chains together have converged. Not converged: none, with a warning."""
    if post_burn is not None:
        if post_burn < 0:
            raise ValueError(f"post_burn must not be negative; got {post_burn}")
        return int(post_burn)
    try:
        used = len(chains) >= 2 and gelman_rubin(chains)
        if not used:
            raise ValueError("two chains are needed at least")
        maxima = corrected_rhat(prefix_moments(chains.rows.where(F.col("row_idx") < chains.shortest), used.steps)).groupBy("grid").agg(F.max("rhat").alias("rhat_max"))
        at = first_sustained(maxima).first()[0]
    except ValueError as e:
        warnings.warn(f"no burn-in can be found ({e}); all rows are used", UserWarning, stacklevel=3)
        return 0
    if at is None:
        warnings.warn("the chains have not converged; all rows are used", UserWarning, stacklevel=3)
        return 0
    return used.steps[at]
