"""Mixing of Markov chains: acceptance, autocorrelation, effective sample size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import NAN, differs, or_nan
from ..sources.chains import ChainSet
from .convergence import long_form, resolve_post_burn


def state_differs(a: Column, b: Column) -> Column:
    """Whether any component differs; NaN differs from NaN."""
    return F.exists(F.zip_with(a, b, lambda x, y: differs(x, y)), lambda x: x)


#: Rows of a chain that one task puts in order.
BLOCK = 1 << 16


def in_blocks(rows: DataFrame, reach: int, size: int = BLOCK) -> DataFrame:
    """The rows by blocks of a chain, each led by copies of the `reach` rows before it, so that windows need not span a chain. Columns __block and __copy are added."""
    size = max(size, reach)
    own = rows.withColumn("__block", F.floor(F.col("row_idx") / size)).withColumn("__copy", F.lit(False))
    ends = own.where(F.col("row_idx") % size >= size - reach).withColumn("__block", F.col("__block") + 1).withColumn("__copy", F.lit(True))
    return own.unionAll(ends)


def _marked(rows: DataFrame, changed: Column | None, reach: int, size: int) -> DataFrame:
    before = Window.partitionBy("chain_pos", "__block").orderBy("row_idx")
    what = F.col("state") if changed is None else changed
    last = F.lag(what).over(before)
    differ = state_differs(what, last) if changed is None else what != last
    return in_blocks(rows, reach, size).withColumn("changed", F.when(last.isNotNull(), differ))


def with_change(rows: DataFrame, changed: Column | None = None, size: int = BLOCK) -> DataFrame:
    """Adds `changed`: whether the row's state differs from the one before in its chain (null for the first)."""
    return _marked(rows, changed, 1, size).where("not __copy").drop("__block", "__copy")


def acceptance_rows(rows: DataFrame, changed: Column | None = None) -> DataFrame:
    """chain_pos, chain_index, rate: the share of transitions that change the state; null with fewer than two rows."""
    return with_change(rows, changed).groupBy("chain_pos", "chain_index").agg(F.avg(F.col("changed").cast("double")).alias("rate"))


def acceptance_rate(chains: ChainSet, *, post_burn: int | None = None) -> np.ndarray:
    kept = chains.post_burn(resolve_post_burn(chains, post_burn))
    rates = {r[0]: r[2] for r in acceptance_rows(kept.rows).collect()}
    return np.array([NAN if rates.get(t[0]) is None else rates[t[0]] for t in kept.table])


def acceptance_trace_rows(rows: DataFrame, window: int = 30, changed: Column | None = None, size: int = BLOCK) -> DataFrame:
    """The rows with `rate`: changes among the last `window` transitions over window; null before there are so many."""
    if window < 1:
        raise ValueError(f"window must be 1 at least; got {window}")
    recent = Window.partitionBy("chain_pos", "__block").orderBy("row_idx").rowsBetween(-(window - 1), 0)
    rate = F.when(F.col("row_idx") >= window, F.avg(F.col("changed").cast("double")).over(recent))
    return _marked(rows, changed, window, size).withColumn("rate", rate).where("not __copy").drop("__block", "__copy")


def acceptance_rate_trace(chains: ChainSet, *, window: int = 30, post_burn: int = 0) -> DataFrame:
    """chain_pos, chain_index, row_idx, rate (NaN at first) of all chains after the burn-in, which is not looked for."""
    rows = acceptance_trace_rows(chains.post_burn(post_burn).rows, window)
    return rows.select("chain_pos", "chain_index", "row_idx", or_nan(F.col("rate")).alias("rate"))


def autocovariance(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Biased autocovariances up to a lag, by a padded Fourier transform."""
    n = len(x)
    x = x - x.mean()
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x, size)
    return np.fft.irfft(f * np.conj(f), size)[: max_lag + 1] / n


def normalised(c: np.ndarray) -> np.ndarray:
    """By the value at lag 0; a constant series has 1, then zeros."""
    return c / c[0] if c[0] > 0 else np.concatenate([[1.0], np.zeros(len(c) - 1)])


def _series(chains: ChainSet, post_burn: int) -> tuple[DataFrame, int]:
    """Values of all chains cut to the shortest."""
    kept = chains.post_burn(post_burn)
    n = kept.shortest
    if n < 2:
        raise ValueError(f"two rows are needed at least after the burn-in; got {n}")
    return long_form(kept.rows.where(F.col("row_idx") < n)).select("chain_pos", "param_idx", "row_idx", "value"), n


def acf_rows(values: DataFrame, max_lag: int) -> DataFrame:
    """chain_pos, param_idx, lag, acf, acov. One task holds a chain's values of one parameter."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("row_idx")["value"].to_numpy(float)
        c = autocovariance(x, max_lag)
        return pd.DataFrame({"chain_pos": int(group["chain_pos"].iloc[0]), "param_idx": int(group["param_idx"].iloc[0]), "lag": np.arange(max_lag + 1), "acf": normalised(c), "acov": c})

    return values.groupBy("chain_pos", "param_idx").applyInPandas(run, "chain_pos int, param_idx int, lag int, acf double, acov double")


def acf_by_join(values: DataFrame, max_lag: int) -> DataFrame:
    """The same for few lags by equi-joins alone: chain_pos, param_idx, lag, acf (null for constant series)."""
    per = Window.partitionBy("chain_pos", "param_idx")
    c = values.withColumn("d", F.col("value") - F.avg("value").over(per))
    ahead = c.select("chain_pos", "param_idx", F.col("d").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "row_idx")
    pairs = ahead.select("chain_pos", "param_idx", "e", "lag", (F.col("row_idx") - F.col("lag")).alias("row_idx")).join(c.select("chain_pos", "param_idx", "row_idx", "d"), ["chain_pos", "param_idx", "row_idx"])
    sums = pairs.groupBy("chain_pos", "param_idx", "lag").agg(F.sum(F.col("d") * F.col("e")).alias("s"))
    zero = F.first(F.when(F.col("lag") == 0, F.col("s")), True).over(per)
    return sums.withColumn("zero", zero).select("chain_pos", "param_idx", "lag", F.try_divide("s", "zero").alias("acf"))


def autocorrelation_function(chains: ChainSet, *, post_burn: int = 0, max_lag: int | None = None) -> DataFrame:
    values, n = _series(chains, post_burn)
    lag = n - 1 if max_lag is None else int(max_lag)
    if not 0 <= lag < n:
        raise ValueError(f"max_lag must lie between 0 and {n - 1}; got {max_lag}")
    return acf_rows(values, lag).drop("acov")


def auto_window(taus: np.ndarray, c: float) -> int:
    """The first lag M that is at least c tau(M), else the last."""
    hit = np.flatnonzero(np.arange(len(taus)) >= c * np.asarray(taus))
    return int(hit[0]) if len(hit) else len(taus) - 1


def tau_rows(covariances: DataFrame, c: float = 5.0) -> DataFrame:
    """param_idx, tau from the autocovariances of all chains: the sums over chains, cumulated to the window that Sokal's rule picks."""
    pooled = covariances.groupBy("param_idx", "lag").agg(F.sum("acov").alias("s"))
    zero = F.first(F.when(F.col("lag") == 0, F.col("s")), True).over(Window.partitionBy("param_idx"))
    rho = F.when(F.col("zero") > 0, F.try_divide("s", "zero")).otherwise(F.lit(NAN))
    running = Window.partitionBy("param_idx").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    taus = pooled.withColumn("zero", zero).withColumn("tau", 2 * F.sum(rho).over(running) - 1)
    good = ~F.isnan("tau") & (F.col("lag") >= c * F.col("tau"))
    picked = taus.groupBy("param_idx").agg(F.min(F.when(good, F.struct("lag", "tau"))).alias("w"), F.max(F.struct("lag", "tau")).alias("l"), F.max(F.isnan("tau").cast("int")).alias("bad"))
    return picked.select("param_idx", F.when(F.col("bad") == 1, F.lit(NAN)).otherwise(F.coalesce("w.tau", "l.tau")).alias("tau"))


def autocorrelation_time(chains: ChainSet, *, post_burn: int | None = None, c: float = 5.0) -> np.ndarray:
    values, n = _series(chains, resolve_post_burn(chains, post_burn))
    out = np.full(chains.n_params, NAN)
    for r in tau_rows(acf_rows(values, n - 1), c).collect():
        out[r["param_idx"]] = r["tau"]
    return out


def effective_sample_size(chains: ChainSet, *, post_burn: int | None = None, c: float = 5.0) -> np.ndarray:
    """Rows of the shortest chain times chains, over tau; NaN where tau is not positive."""
    burn = resolve_post_burn(chains, post_burn)
    tau = autocorrelation_time(chains, post_burn=burn, c=c)
    total = chains.post_burn(burn).shortest * len(chains)
    return np.where(tau > 0, total / np.where(tau > 0, tau, 1), NAN)
