"""Figures, by stand-ins for the drawing packages that keep what they are told."""

from __future__ import annotations

import sys
from types import ModuleType

import numpy as np
import pytest

import starloom
from starloom.operators.collection import Collection
from starloom.plans import facade_queries, queries

DATA = "/root/testdata/sf0.001"


class Recorder:
    def __init__(self, *args, **options):
        self.calls = [("made", args, options)]

    def __getattr__(self, name):
        def call(*args, **options):
            self.calls.append((name, args, options))
            if name == "add_subplot":
                self.axes = Recorder()
                return self.axes
            if name == "savefig":
                args[0].write_text("figure")
            return None

        return call

    def of(self, name):
        return [(a, o) for n, a, o in self.calls if n == name]


@pytest.fixture
def drawing(monkeypatch):
    for name in ("matplotlib", "matplotlib.figure", "corner"):
        monkeypatch.setitem(sys.modules, name, ModuleType(name))
    sys.modules["matplotlib.figure"].Figure = Recorder
    sys.modules["corner"].corner = lambda data, **options: (data, options)


def test_a_figure_per_analysis(spark, drawing, tmp_path):
    models = starloom.open_models(spark, {k: [f] for k, f in zip("FO", facade_queries._stores(spark, DATA), strict=True)})
    figures = models.plot_analyses(["N", "A"], tmp_path / "figures", dpi=50, file_format="svg")
    assert list(figures) == ["N", "A"] and sorted(p.name for p in (tmp_path / "figures").iterdir()) == ["A.svg", "N.svg"]
    ax = figures["A"].axes
    labels = [o["label"] for _, o in ax.of("errorbar")]
    assert sorted(labels) == ["F", "O", "all"] and labels.count("all") == 1  # the target once
    assert all(len(a[0]) == len(a[1]) == len(o["yerr"][0]) for a, o in ax.of("errorbar") if o["label"] != "all")
    assert ax.of("set_xlabel")[0][0] == ("line",) and ax.of("set_xscale")[0][0] == ("linear",) and ax.of("set_title")[0][0] == ("A",)
    alone = starloom.plot_analyses(models["F"], "R", show_target=False)
    assert [o["label"] for _, o in alone["R"].axes.of("errorbar")] == ["Model"]
    with pytest.raises(KeyError):
        models["F"].plot_analyses("none")


def test_nothing_to_draw(spark, drawing):
    c = Collection(spark, facade_queries._stores(spark, DATA)[:1])
    c.__dict__["analyses"] = c.analyses.limit(0)
    with pytest.warns(UserWarning, match="no one-dimensional"):
        assert starloom.plot_analyses(c) == {}


def test_corner_plot(spark, drawing):
    chains = queries.chain_set(spark, DATA)
    data, options = starloom.corner_plot(chains, post_burn=5, bins=7)
    assert data.shape == (sum(t[3] - 5 for t in chains.table), 2) and options == {"labels": ["$v$", "$k$"], "bins": 7} and not np.isnan(data).any()
    data, options = starloom.corner_plot(chains, parameters=["node/k"], post_burn=0, labels=["other"])
    assert data.shape[1] == 1 and options["labels"] == ["other"]
    with pytest.raises(ValueError, match="labels"):
        starloom.corner_plot(chains, labels=["one"], post_burn=0)
    with pytest.raises(KeyError):
        starloom.corner_plot(chains, parameters=["none"], post_burn=0)
