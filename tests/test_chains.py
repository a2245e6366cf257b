from __future__ import annotations

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom import open_mcmc, parse_mcmc_config
from starloom.operators import convergence, mixing, parameters, summaries
from starloom.sources import chains as source
from starloom.sources.config import MCMCConfig, ModelParameter, PriorSpec

CONFIG = """<parameters>
 <posteriorSampleLikelihood value="{kind}"><baseParametersFileName value="base.xml"/>{more}</posteriorSampleLikelihood>
 <posteriorSampleSimulation value="{sim}"><logFileRoot value="logs/chain"/>
  <modelParameter value="active"><name value="p/a"/><label value="a"/>
   <distributionFunction1DPrior value="uniform"><limitLower value="0"/><limitUpper value="12"/></distributionFunction1DPrior>
   <distributionFunction1DPerturber value="cauchy"><median value="0.0"/><scale value="1e-3"/></distributionFunction1DPerturber></modelParameter>
  <modelParameter value="active"><name value="p/b"/>
   <distributionFunction1DPrior value="uniform"><limitLower value="0"/><limitUpper value="12"/></distributionFunction1DPrior></modelParameter>
  <modelParameter value="inactive"><name value="p/c"/></modelParameter>
 </posteriorSampleSimulation></parameters>"""


@pytest.fixture
def run_dir(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "config.xml").write_text(CONFIG.format(kind="gaussian", sim="differentialEvolution", more=""))
    (tmp_path / "base.xml").write_text("<x><p><a value='0.0'/><b value='0.0'/></p></x>")
    return tmp_path


def log(path, chain, rows, header=""):
    path.write_text(header + "\n".join(f" {i + 1} {chain} 0.1 {'T' if i % 2 else '.FALSE.'} {lp} {ll} {' '.join(map(repr, s))}" for i, (lp, ll, *s) in enumerate(rows)) + "\n")


def chain_set(spark, *arrays, priors=True):
    """Chains from arrays (rows, parameters); log posterior is minus the row's distance from 0."""
    rows = [(c, c, i, i + 1, -float(np.abs(r).sum()), -1.0, [float(x) for x in r]) for c, a in enumerate(arrays) for i, r in enumerate(a)]
    df = spark.createDataFrame(rows, "chain_pos int, chain_index long, row_idx long, step long, log_posterior double, log_likelihood double, state array<double>")
    prior = PriorSpec("uniform", {"limitLower": 0.0, "limitUpper": 12**0.5}) if priors else None
    from pathlib import Path

    names = tuple(ModelParameter(f"p/{k}", None, prior) for k in "abcd"[: arrays[0].shape[1]])
    return source.ChainSet(MCMCConfig(Path("c"), Path("l"), "differentialEvolution", names), df.cache(), tuple((c, c, "", len(a)) for c, a in enumerate(arrays)))


def test_config(run_dir):
    c = parse_mcmc_config(run_dir / "config.xml")
    assert c.parameter_names == ("p/a", "p/b") and c.parameters[0].display_label == "a" and c.parameters[1].display_label == "b"
    assert c.parameters[0].prior.params == {"limitLower": 0.0, "limitUpper": 12.0} and c.parameters[0].mapper == "identity"
    assert c.log_file_root == run_dir.resolve() / "logs/chain" and c.likelihood.base_parameters_file == run_dir.resolve() / "base.xml"
    (run_dir / "bad.xml").write_text("<other/>")
    with pytest.raises(ValueError, match="root element"):
        parse_mcmc_config(run_dir / "bad.xml")


def test_likelihood_tree(run_dir):
    more = "<parameterMap value='p/b'/><posteriorSampleLikelihood value='l1'><baseParametersFileName value='base.xml'/></posteriorSampleLikelihood><posteriorSampleLikelihood value='l2'><baseParametersFileName value='base.xml'/></posteriorSampleLikelihood>"
    (run_dir / "tree.xml").write_text(CONFIG.format(kind="independent", sim="differentialEvolution", more=more))
    c = parse_mcmc_config(run_dir / "tree.xml")
    leaves = c.likelihood.leaves()
    assert [leaf.parameter_map for leaf in leaves] == [("p/b",), None]
    assert [c.state_indices_for(leaf) for leaf in leaves] == [(1,), (0, 1)]
    written = parameters.emit_parameter_files([1.5, 2.5], c, run_dir / "out")
    assert [p.name for _, p in written] == ["00_base.xml", "01_base.xml"]
    first = parameters.read_parameter_file(written[0][1]).getroot()
    assert first.find("p/a").get("value") == "0.0" and first.find("p/b").get("value") == "2.5"


def test_chain_logs(spark, run_dir):
    log(run_dir / "logs/chain_0000.log", 7, [(-1.0, -2.0, 0.5, 0.25), (-3.0, -4.0, 0.5, 0.75)], "# header\n#    7 = Parameter `p/a`\n#    8 = Parameter `p/b`\n\n\"quoted\n")
    (run_dir / "logs/chain_0001.log").write_text("")
    (run_dir / "logs/chain_001.log").write_text("not a log")
    with open_mcmc(spark, run_dir / "config.xml") as run:
        c = run.chains
        assert [(t[0], t[1], t[3]) for t in c.table] == [(0, 7, 2), (1, 1, 0)]
        rows = c.rows.orderBy("row_idx").collect()
        assert [r["state"] for r in rows] == [[0.5, 0.25], [0.5, 0.75]] and [r["converged"] for r in rows] == [False, True] and rows[0]["velocity"] is None
        assert run.write_parameter_file([1.0, 2.0], run_dir / "o" / "x.xml").exists()
        with pytest.raises(IndexError):
            run.write_parameter_file([1.0, 2.0], run_dir / "y.xml", likelihood_index=1)


def test_bad_chain_logs(spark, run_dir):
    config = parse_mcmc_config(run_dir / "config.xml")
    with pytest.raises(FileNotFoundError):
        source.read_chains(spark, config)
    (run_dir / "logs/chain_0000.log").write_text("1 0 0.1 T -1 -2 0.5\n")
    with pytest.raises(Exception, match="fewer than 8 columns"):
        source.read_chains(spark, config, cache=False)
    (run_dir / "logs/chain_0000.log").write_text("1 0 0.1 maybe -1 -2 0.5 0.5\n")
    with pytest.raises(Exception, match="not a logical"):
        source.read_chains(spark, config, cache=False).rows.collect()
    (run_dir / "logs/chain_0000.log").write_text("1 0 0.1 T -1 -2 0.5 0.5\n2 1 0.1 T -1 -2 0.5 0.5\n")
    with pytest.raises(ValueError, match="several chains"):
        source.read_chains(spark, config, cache=False)
    log(run_dir / "logs/chain_0000.log", 0, [(-1.0, -2.0, 0.5, 0.25)], "# 7 = Parameter `p/b`\n# 8 = Parameter `p/a`\n")
    with pytest.raises(ValueError, match="names the parameters"):
        source.read_chains(spark, config, cache=False)


def test_particle_swarm_has_velocities(spark, run_dir):
    (run_dir / "ps.xml").write_text(CONFIG.format(kind="gaussian", sim="particleSwarm", more=""))
    log(run_dir / "logs/chain_0000.log", 0, [(-1.0, -2.0, 0.5, 0.25, 9.0, 8.0)])
    assert source.read_chains(spark, parse_mcmc_config(run_dir / "ps.xml")).rows.first()["velocity"] == [9.0, 8.0]


def numpy_rhat(x):
    """The statistic written out for (chains, steps, parameters)."""
    m, n, _ = x.shape
    means, var = x.mean(1), x.var(1, ddof=1)
    cov = lambda a, b: ((a - a.mean(0)) * (b - b.mean(0))).sum(0) / (m - 1)
    b, w = n * means.var(0, ddof=1), var.mean(0)
    v = (n - 1) / n * w + (m + 1) / (m * n) * b
    vv = ((n - 1) / n) ** 2 / m * var.var(0, ddof=1) + ((m + 1) / (m * n)) ** 2 * 2 * b * b / (m - 1) + 2 * (m + 1) * (n - 1) / (m * m * n * n) * n / m * (cov(var, means**2) - 2 * means.mean(0) * cov(var, means))
    d = 2 * v * v / np.where(vv > 0, vv, np.inf)
    return (d + 3) / (d + 1) * np.sqrt((m + 1) / m * v / w - (n - 1) / (n * m))


def test_rhat_matches_numpy_on_every_prefix(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, 60, 2)) + np.array([1e6, 0.0])
    x[0, :20] += 2
    c = chain_set(spark, *x)
    r = convergence.gelman_rubin(c, step_grid=[10, 25, 60])
    want = np.stack([numpy_rhat(x[:, :s]) for s in (10, 25, 60)])
    assert np.allclose(r.Rhat_c, want, rtol=1e-6)
    span = lambda v, axis=None: np.subtract(*np.quantile(v, [0.925, 0.075], axis=axis))
    own = [[span(x[:, :s, p]) / span(x[:, :s, p], 1).mean() for p in range(2)] for s in (10, 25, 60)]
    assert np.allclose(r.R_interval, own)
    assert np.allclose(r.Rhat_c_max(), want.max(1), rtol=1e-6) and r.steps == (10, 25, 60)


def test_rhat_of_stuck_and_constant_chains(spark):
    rng = np.random.default_rng(4)
    stuck = chain_set(spark, *[rng.normal(size=(50, 1)) + 20 * k for k in range(3)])
    assert convergence.gelman_rubin(stuck).Rhat_c_max()[-1] > 5
    flat = chain_set(spark, *[np.ones((20, 1))] * 2)
    assert np.isnan(convergence.gelman_rubin(flat).Rhat_c).all()
    with pytest.raises(ValueError, match="two chains"):
        convergence.gelman_rubin(flat, drop_chains=[1])
    with pytest.raises(ValueError, match="fewer than"):
        convergence.gelman_rubin(flat, min_steps=30)


def test_convergence_step(spark):
    assert convergence.convergence_step([2, 1.5, 1.2, 1.05, 1.02]) == 3
    wavy = [1.5, 1.3, 1.05, 1.4, 1.05, 1.05, 1.02]
    assert convergence.convergence_step(wavy) == 2 and convergence.convergence_step(wavy, sustained_for=2) == 4
    assert convergence.convergence_step([float("nan"), 2.0]) is None
    df = spark.createDataFrame(list(enumerate(wavy)), "grid int, rhat_max double")
    assert convergence.first_sustained(df, 1.1, 2).first()[0] == 4 and convergence.first_sustained(df, 1.0, 1).first()[0] is None
    with pytest.raises(ValueError):
        convergence.convergence_step([[1.0]])


def test_geweke_and_outliers(spark):
    rng = np.random.default_rng(5)
    arrays = [rng.normal(size=(100, 1)) for _ in range(6)]
    arrays[4] = arrays[4] * 0.01 + 500
    c = chain_set(spark, *arrays, np.zeros((3, 1)))
    z = convergence.geweke(c)
    a = arrays[0][:, 0]
    assert z[0, 0] == pytest.approx((a[:10].mean() - a[-50:].mean()) / np.sqrt(a[:10].var(ddof=1) / 10 + a[-50:].var(ddof=1) / 50))
    assert np.isnan(z[6, 0])
    assert convergence.outlier_chains(c) == (4,)
    with pytest.raises(KeyError):
        convergence.outlier_chains(c, parameters=["p/z"])


def test_acceptance(spark):
    a = np.r_[np.zeros(50), np.arange(50)][:, None]
    c = chain_set(spark, a, np.full((1, 1), 3.0), np.full((4, 1), np.nan))
    rate = mixing.acceptance_rate(c, post_burn=0)
    assert rate[0] == pytest.approx(49 / 99) and np.isnan(rate[1]) and rate[2] == 1.0  # NaN differs from NaN
    trace = [r["rate"] for r in mixing.acceptance_rate_trace(c, window=10).where("chain_pos = 0").orderBy("row_idx").collect()]
    assert np.isnan(trace[:10]).all() and trace[10] == 0 and trace[60] == 1.0
    with pytest.raises(ValueError):
        mixing.acceptance_rate_trace(c, window=0)


def test_autocorrelation(spark):
    rng = np.random.default_rng(6)
    x = np.zeros((2, 4000))
    e = rng.normal(size=x.shape)
    for i in range(1, x.shape[1]):
        x[:, i] = 0.9 * x[:, i - 1] + e[:, i]
    c = chain_set(spark, x[0][:, None], x[1][:3000, None])
    acf = {(r[0], r[2]): r[3] for r in mixing.autocorrelation_function(c, max_lag=5).collect()}
    d = x[0][:3000] - x[0][:3000].mean()
    assert acf[0, 3] == pytest.approx((d[:-3] * d[3:]).sum() / (d * d).sum()) and acf[0, 0] == 1
    tau = mixing.autocorrelation_time(c, post_burn=0)[0]
    assert 14 < tau < 24
    assert mixing.effective_sample_size(c, post_burn=0)[0] == pytest.approx(6000 / tau)
    assert mixing.normalised(mixing.autocovariance(np.ones(50), 3)).tolist() == [1, 0, 0, 0]
    assert mixing.auto_window(np.ones(10), 2) == 2 and mixing.auto_window(np.full(5, 1000.0), 2) == 4
    assert np.isnan(mixing.autocorrelation_time(chain_set(spark, np.ones((9, 1)), np.ones((9, 1))), post_burn=0)).all()


def test_burn_in_is_found_or_warned_of(spark):
    rng = np.random.default_rng(8)
    mixed = chain_set(spark, *[rng.normal(size=(400, 1)) for _ in range(4)])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert 0 < convergence.resolve_post_burn(mixed, None) <= 400
    with pytest.warns(UserWarning, match="no burn-in"):
        assert convergence.resolve_post_burn(mixed.without([1, 2, 3]), None) == 0
    with pytest.raises(ValueError):
        convergence.resolve_post_burn(mixed, -1)


def test_maxima(spark):
    a = np.full((20, 2), 5.0)
    b = a.copy()
    b[17] = [0.42, -0.13]
    nan = np.array([[np.nan, 0.0]] * 2)
    best = summaries.maximum_posterior(chain_set(spark, a, b, nan))
    assert (best.chain_index, best.step) == (1, 18) and np.allclose(best.state, [0.42, -0.13])
    assert summaries.maximum_posterior(chain_set(spark, a, a)).step == 1
    with pytest.raises(ValueError):
        summaries.maximum_posterior(chain_set(spark, nan))


def test_draws_follow_the_generator(spark):
    arrays = [np.arange(10.0)[:, None], 100 + np.arange(7.0)[:, None]]
    c = chain_set(spark, *arrays)
    s = summaries.posterior_samples(c, 6, post_burn=2, rng=np.random.default_rng(1))
    pool = np.r_[arrays[0][2:], arrays[1][2:]][:, 0]
    assert s.state[:, 0].tolist() == pool[np.random.default_rng(1).choice(13, 6, replace=False)].tolist()
    assert len(summaries.posterior_samples(c, 40, post_burn=0).state) == 40
    for bad in ({"n": 0}, {"n": 99, "replace": False}):
        with pytest.raises(ValueError):
            summaries.posterior_samples(c, post_burn=0, **bad)


def test_normal_fit_and_projection(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.multivariate_normal([1, -2], [[2, 0.9], [0.9, 1]], size=500)
    c = chain_set(spark, x[:200], x[200:])
    fit = summaries.multivariate_normal_fit(c, post_burn=0)
    assert np.allclose(fit.covariance, np.cov(x.T)) and np.allclose(fit.cholesky @ fit.cholesky.T, fit.covariance) and np.allclose(fit.mean, x.mean(0))
    text = fit.write_reparameterization_config(tmp_path / "r.xml").read_text()
    assert text.count("metaParameter0") == 3 and 'value="derived"' in text
    r = summaries.projection_pursuit(c, post_burn=0)
    assert np.allclose(r.eigenvalues, np.linalg.eigvalsh(np.cov(x.T)))
    assert len(r.direction(0)) == 2 and r.latex_summary(0).count("\\,") == 2
    assert summaries.multivariate_normal_fit(chain_set(spark, x[:, :1]), post_burn=0).cholesky.shape == (1, 1)
    with pytest.raises(NotImplementedError):
        summaries.projection_pursuit(chain_set(spark, x, priors=False), post_burn=0)
    data = summaries.corner_data(c, ["p/b"], 0)
    assert data.count() == 500 and summaries.histogram(data, "p/b", -5.0, 5.0, 4).agg(F.sum("n")).first()[0] <= 500


def test_parameter_paths():
    from xml.etree import ElementTree as ET

    root = ET.fromstring("<x><s value='a'/><s value='b'><t value='1'/></s><s value='c'/></x>")
    find = lambda p: parameters.resolve_parameter_path(root, p)
    assert find("s").get("value") == "a" and find("s[3]").get("value") == "c" and find("s[@value='b']/t").get("value") == "1" and find("s[2]::t").get("value") == "1"
    for bad in ("s[9]", "s[0]", "u", "s[@value='z']"):
        with pytest.raises(KeyError):
            find(bad)
    for bad in ("", "s[x]", "1s"):
        with pytest.raises(ValueError):
            find(bad)


def test_files_stay_in_their_folder(run_dir):
    c = parse_mcmc_config(run_dir / "config.xml")
    with pytest.raises(ValueError, match="outside"):
        parameters.emit_parameter_files([1.0, 2.0], c, run_dir / "o", name_format="../{stem}.xml")
    tree = parameters.read_parameter_file(run_dir / "base.xml")
    with pytest.raises(ValueError):
        parameters.apply_state(tree, c.parameters, [1.0])
    with pytest.raises(KeyError):
        parameters.apply_state(tree, c.parameters, [1.0, 2.0], parameter_map=["p/z"])


def test_autocorrelation_time_query_of_slow_chains(spark, tmp_path):
    """Chains whose window closes far beyond lag 200, against sums over all lags."""
    from starloom.plans import queries

    rng = np.random.default_rng(11)
    x = np.zeros((4, 3000))
    for t in range(1, x.shape[1]):
        x[:, t] = 0.99 * x[:, t - 1] + rng.normal(size=4)
    rows = [(int(t * 4 + c), c, "view", float(x[c, t]), f'{{"k": {t % 7}}}') for t in range(x.shape[1]) for c in range(4)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    d = x - x.mean(axis=1, keepdims=True)
    s = np.array([(d[:, : x.shape[1] - k] * d[:, k:]).sum() for k in range(x.shape[1])])
    tau = 2 * np.cumsum(s / s[0]) - 1
    window = int(np.flatnonzero(np.arange(len(tau)) >= 5 * tau)[0])
    got = {r["param_idx"]: r["tau"] for r in queries.QUERIES["autocorr_time"](spark, str(tmp_path)).collect()}
    assert window > 200 and got[0] == pytest.approx(tau[window], abs=1e-4)


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 16])
def test_changes_do_not_depend_on_blocks(spark, size):
    rng = np.random.default_rng(11)
    states = {c: rng.integers(0, 3, n).astype(float) for c, n in ((0, 40), (1, 7), (2, 1))}
    rows = spark.createDataFrame([(c, c, i, [x, 1.0]) for c, v in states.items() for i, x in enumerate(v.tolist())], "chain_pos int, chain_index long, row_idx long, state array<double>")
    got = {(r["chain_pos"], r["row_idx"]): r["changed"] for r in mixing.with_change(rows, size=size).collect()}
    assert got == {(c, i): None if not i else bool(v[i] != v[i - 1]) for c, v in states.items() for i in range(len(v))}
    rates = {(r["chain_pos"], r["row_idx"]): r["rate"] for r in mixing.acceptance_trace_rows(rows, 5, size=size).collect()}
    for (c, i), rate in rates.items():
        want = None if i < 5 else np.mean(states[c][i - 4 : i + 1] != states[c][i - 5 : i])
        assert rate is None if want is None else rate == pytest.approx(want)
    assert len(rates) == 48


def test_rows_are_numbered_over_splits(spark, tmp_path):
    lines = "".join(f"{k + 1} 3 0.1 T -1.0 -2.0 {k}.5\n" for k in range(400))
    (tmp_path / "log_0000.log").write_text("# head\n" + lines)
    config = MCMCConfig(tmp_path / "c.xml", tmp_path / "log", "differentialEvolution", (ModelParameter("a"),))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        rows = source.read_chains(spark, config, cache=False).rows.select("row_idx", "step").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["row_idx"], r["step"]) for r in rows) == [(k, k + 1) for k in range(400)]
