"""The HDF5 source, by a stand-in for h5py that holds the same kinds of groups, datasets and attributes."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

import starloom
from starloom.sources import hdf5, store

FAKES = Path(__file__).parent / "fakes"
UNITS = np.dtype([("unitsInSI", "f8"), ("description", "S512"), ("quantity", "S512"), ("isComoving", "i4")])


@pytest.fixture(scope="module")
def h5(spark):
    spark.sparkContext.addPyFile(str(FAKES / "h5py.py"))
    sys.path.insert(0, str(FAKES))
    import h5py

    yield h5py
    sys.path.remove(str(FAKES))
    sys.modules.pop("h5py")


def dataset(values, attrs=None, ragged=None):
    return values if ragged is None and not isinstance(values, (list, np.ndarray)) else (np.asarray(values) if ragged is None else values, attrs or {}, ragged)


def simulation(h5, masses, spins, status=0, analyses=True):
    solar = {"units": np.array((1.98892e30, b"solar masses", b"solMass", 0), UNITS), "comment": b"Test dataset"}
    output = lambda m, s, attrs: {h5.ATTRS: attrs, "nodeData": {"basicMass": dataset(np.array(m), solar), "spin": dataset(np.array(s), {"comment": "a spin"}), "nodeIndex": dataset(np.arange(len(m), dtype="i8")), "flux": dataset(np.arange(2.0 * len(m)).reshape(-1, 2), {"unitsInSI": np.float64(3.0)})}}
    tree = {h5.ATTRS: {"statusCompletion": np.int32(status)}, "Outputs": {"Output1": output(masses, spins, {"outputTime": 13.8, "outputExpansionFactor": 1.0, "outputType": b"snapshot"}), "Output2": output(masses[:1], spins[:1], {"outputTime": np.float64(6.0), "outputExpansionFactor": 0.5}), "other": {}}, "Parameters": {"x": {h5.ATTRS: {"value": b"1"}}}}
    if analyses:
        axes = {"type": b"function1D", "description": b"a mass function", "xAxisLabel": b"M", "yAxisLabel": b"n", "targetLabel": b"Foo+24", "xAxisIsLog": np.int32(1), "yAxisIsLog": np.int32(0), "xDataset": b"x", "yDataset": b"y"}
        x, y = dataset([1.0, 2.0, 3.0]), dataset([5.0, 6.0, 7.0])
        tree["analyses"] = {
            "plain": {h5.ATTRS: axes, "x": x, "y": y},
            "full": {h5.ATTRS: axes | {"yDatasetTarget": b"t", "yErrorLower": b"low", "yErrorUpper": b"high", "yCovarianceTarget": b"cov"}, "x": x, "y": y, "t": dataset([4.0, 5.0, 6.0]), "low": dataset([4.0, 4.0, 4.0]), "high": dataset([7.0, 8.0, 9.0]), "cov": dataset(np.diag([0.01, 0.04, 0.09]))},
            "flat": {h5.ATTRS: {"type": b"function2D"}},
            "step1:chain1": {"inner": {h5.ATTRS: axes, "x": x, "y": y}},
            "loose": dataset([1.0]),
        }
    return tree


@pytest.fixture
def ranks(h5, tmp_path):
    for k, (m, s) in enumerate((([1e12, 2e12], [0.1, 0.2]), ([3e12, 4e12], [0.3, 0.4]))):
        h5.write(tmp_path / f"run:MPI000{k}.hdf5", simulation(h5, m, s, status=k, analyses=k == 0))
    return str(tmp_path / "run:MPI0001.hdf5")


def test_rank_files_read_as_one(spark, ranks):
    c = starloom.open_outputs(spark, ranks)
    assert len(c.files) == 2 and [(m.name, m.time, m.redshift, m.output_type) for m in c.outputs] == [("Output1", 13.8, 0.0, "snapshot"), ("Output2", 6.0, 1.0, None)]
    rows = c.read(1, {"m": "nodeData/basicMass", "f": "nodeData/flux"}).orderBy("file_ord", "row_in_file").collect()
    assert [r["m"] for r in rows] == [1e12, 2e12, 3e12, 4e12] and rows[3]["f"] == [2.0, 3.0] and [r["row_in_file"] for r in rows] == [0, 1, 0, 1]
    assert [r["m"] for r in c.read(1, {"m": "nodeData/basicMass"}, [2, 0]).collect()] == [3e12, 1e12]
    assert c.read(1, {"m": "nodeData/basicMass"}, "spin > 0.15").count() == 3 and c.read(2, ["spin"]).count() == 2
    d = c["Outputs/Output1/nodeData/basicMass"]
    assert d.units.quantity == "solMass" and d.units.in_si == 1.98892e30 and d.attrs["comment"] == "Test dataset" and d.shape == (4,) and d.dtype == "double"
    assert c["Outputs/Output1/nodeData/flux"].units.in_si == 3.0 and c["Outputs/Output1/nodeData/flux"].shape == (4, 2)
    assert c.attributes("Parameters/x") == {"value": "1"} and "Parameters" in c.keys()
    table = {r["name"]: r for r in c.list_properties(1, "rows")}
    assert table["basicMass"]["units"] == "solar masses" and table["nodeIndex"]["dtype"] == "int64" and table["spin"]["description"] == "a spin"
    with pytest.raises(RuntimeError, match="MPI0001"):
        c.validate_completion()


def test_analyses_of_a_file(spark, ranks):
    c = starloom.open_outputs(spark, ranks)
    assert [(r["name"], r["xAxisIsLog"], r["hasTarget"]) for r in c.list_analyses("rows")] == [("full", True, True), ("plain", True, False), ("step1:chain1/inner", True, False)]
    rows = starloom.plot_data(c.analyses, "full").orderBy("i").collect()
    assert [r["y_err_lower"] for r in rows] == [1, 2, 3] and [r["y_err_upper"] for r in rows] == [2, 2, 2] and [r["target_err_upper"] for r in rows] == pytest.approx([0.1, 0.2, 0.3])
    with pytest.raises(KeyError, match="analyses"):
        starloom.open_outputs(spark, [c.files[1]]).list_analyses()


def test_files_turn_into_the_native_layout(spark, ranks, tmp_path):
    source = starloom.open_outputs(spark, ranks).files[0]
    store.ingest(spark, source, str(tmp_path / "run.store"))
    c = starloom.open_outputs(spark, str(tmp_path / "run.store"))
    assert [r["m"] for r in c.read(1, {"m": "nodeData/basicMass"}).orderBy("row_in_file").collect()] == [1e12, 2e12]
    assert c["Outputs/Output1/nodeData/basicMass"].units.quantity == "solMass" and len(c.list_analyses("rows")) == 3 and c.outputs["Output2"].time == 6.0


def test_types_parts_and_what_is_missing(spark, h5, tmp_path):
    at = str(tmp_path / "odd.hdf5")
    ragged = np.empty(3, object)
    ragged[:] = [np.arange(n, dtype="f8") for n in (1, 0, 2)]
    group = {"a": dataset(np.array([1, 2, 3], "u8")), "b": dataset(np.array([1, 0, 1], bool)), "r": dataset(ragged, None, np.dtype("f8")), "s": dataset(np.array([b"x", b"y", b"z"])), "t": dataset(np.arange(12, dtype="f4").reshape(3, 2, 2))}
    h5.write(at, {"g": group})
    kinds = dict(hdf5.scan(spark, [at], "g").dtypes)
    assert (kinds["a"], kinds["b"], kinds["r"], kinds["t"]) == ("decimal(20,0)", "boolean", "array<double>", "array<array<float>>")
    rows = spark.read.format("simulation_hdf5").option("files", at).option("group", "g").option("columns", "r\nt\nb").option("rows", 2).load()
    assert rows.rdd.getNumPartitions() == 2 and [(r["row_in_file"], r["r"], r["b"]) for r in rows.orderBy("row_in_file").collect()] == [(0, [0.0], True), (1, [], False), (2, [0.0, 1.0], True)]
    h5.write(tmp_path / "less.hdf5", {"g": {"a": group["a"]}})
    with pytest.raises(Exception, match="is missing"):
        hdf5.scan(spark, [at, str(tmp_path / "less.hdf5")], "g", ["a", "b"]).collect()
    with pytest.raises(KeyError, match="Outputs"):
        hdf5.describe(at)
    h5.write(tmp_path / "group.hdf5", {"Outputs": {}, "analyses": {"x": {h5.ATTRS: {"type": b"function1D", "yDataset": b"y"}, "y": {}}}})
    with pytest.raises(TypeError, match="names a group"):
        hdf5.describe(str(tmp_path / "group.hdf5"))
    sys.modules["h5py"] = None
    try:
        with pytest.raises(ImportError, match="h5py"):
            hdf5.describe(at)
    finally:
        sys.modules["h5py"] = h5
