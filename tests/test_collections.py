from __future__ import annotations

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import starloom
from starloom.operators import analyses as an
from starloom.operators import star_formation
from starloom.operators.outputs import index_outputs
from starloom.operators.tables import make_table
from starloom.plans import adapters
from starloom.sources import discovery, store

OUTPUTS = "name string, time double, scale_factor double, output_type string"


def make_store(spark, path, nodes, groups, analyses=None, status=0, attributes=None, properties=None):
    rows = spark.createDataFrame(*nodes)
    outputs = index_outputs(spark.createDataFrame(groups, OUTPUTS))
    store.write(str(path), rows, outputs, status, None if properties is None else spark.createDataFrame(properties, store.PROPERTIES), None if attributes is None else spark.createDataFrame(attributes, store.ATTRIBUTES), analyses)
    return str(path)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stores")
    schema = "output_name string, row_in_file long, basicMass double, spin double"
    groups = [("Output2", 6.0, 0.5, "snapshot"), ("Output1", 13.8, 1.0, None)]
    props = [("Output1", "basicMass", "float64", "(2,)", "mass", 1.98892e30, "solar", "solMass", 0)]
    one = make_store(spark, at / "g.store", ([("Output1", 0, 1e12, 0.1), ("Output1", 1, 2e12, 0.2), ("Output2", 0, 5e11, 0.15)], schema), groups, properties=props, attributes=[("Outputs/Output1", "group", "k", "v")])
    two = make_store(spark, at / "h.store", ([("Output1", 0, 3e12, 0.3), ("Output1", 1, 4e12, 0.4)], schema), groups, status=1)
    return one, two


def masses(df):
    return [r["m"] for r in df.orderBy(*[c for c in ("position", "file_ord", "row_in_file") if c in df.columns]).collect()]


def test_reading(spark, files):
    c = starloom.open_outputs(spark, list(files))
    read = lambda where=None: c.read(1, {"m": "nodeData/basicMass"}, where)
    assert masses(read()) == [1e12, 2e12, 3e12, 4e12]
    assert masses(read("spin > 0.15")) == [2e12, 3e12, 4e12]
    assert masses(read([True, False, False, True])) == [1e12, 4e12]
    assert masses(read([2, 0, -1, 2])) == [3e12, 1e12, 4e12, 3e12]
    assert masses(read([])) == []
    assert c.read(np.int64(2), ["nodeData/spin"]).first()["nodeData/spin"] == 0.15
    d = c["Outputs/Output1/nodeData/basicMass"]
    own = np.array([1e12, 2e12])  # the first file's
    for key in (slice(-2, None), slice(None, -1), slice(None, None, -1), slice(5, None), slice(1, None, -2), slice(0, 9, 3), 0, -1, [1, 0, 1, -1], [], [True, False]):
        assert [r["value"] for r in d[key].orderBy("position").collect()] == np.atleast_1d(own[np.array(key, int) if key == [] else key]).tolist(), key
    for bad in (2, [0, 5], [True]):
        with pytest.raises(IndexError):
            d[bad]
    assert starloom.open_outputs(spark, [files[0], files[0]]).read(1, ["spin"]).count() == 4
    for bad in ([7], [True]):
        with pytest.raises(IndexError):
            read(bad)
    for bad in (lambda: c.read(9, ["spin"]), lambda: c.read(1, ["nope"])):
        with pytest.raises(KeyError):
            bad()
    plan = lambda c: c.read(1, {"m": "nodeData/basicMass"}, "spin > 0.15")._jdf.queryExecution().executedPlan().toString()
    one = plan(starloom.open_outputs(spark, files[0]))
    assert "spin" in one.split("PushedFilters")[1] and "PartitionFilters: [isnotnull(output_name" in one
    both = plan(c)
    assert both.count("FileScan") == 1 and "spin" in both.split("PushedFilters")[1] and "file_path" in both.split("DataFilters")[1]


def test_metadata(spark, files):
    c = starloom.open_outputs(spark, list(files))
    assert [(m.name, m.index, m.redshift) for m in c.outputs] == [("Output1", 1, 0.0), ("Output2", 2, 1.0)]
    assert c.outputs["Output2"].time == 6.0 and c.outputs[0].output_type is None
    with pytest.raises(KeyError):
        c.outputs["Output7"]
    assert c.list_outputs("pandas")["name"].tolist() == ["Output1", "Output2"]
    assert c.list_properties(1, "rows") == [{"name": "basicMass", "dtype": "float64", "shape": "(2,)", "description": "mass", "units": "solar"}]
    d = c["Outputs/Output1/nodeData/basicMass"]
    assert d.shape == (4,) and d.dtype == "double" and d.units.quantity == "solMass" and [r["value"] for r in d[:1].collect()] == [1e12]
    assert c.keys() == ["Outputs"] and c["Outputs"].keys() == ["Output1", "Output2"] and c["Outputs/Output1"].attrs == {"k": "v"} and "x" not in c
    assert starloom.convert_units(c.read(1, ["basicMass"]), "basicMass", "kg").orderBy("file_ord", "row_in_file").first()["basicMass"] == pytest.approx(1.98892e42)
    with pytest.raises(RuntimeError, match="h.store"):
        c.validate_completion()
    with pytest.warns(UserWarning):
        c.validate_completion("warn")
    with pytest.raises(ValueError):
        c.validate_completion("maybe")
    with pytest.raises(ValueError):
        make_table([], "xml")


def test_discovery(tmp_path):
    for n in ("g:MPI0000.hdf5", "g:MPI0001.hdf5", "g.hdf5", "z.hdf5"):
        (tmp_path / n).touch()
    names = lambda p: [x.rsplit("/", 1)[1] for x in discovery.resolve(p)]
    assert names(tmp_path / "g.hdf5") == ["g:MPI0000.hdf5", "g:MPI0001.hdf5"] == names(str(tmp_path / "g:MPI0001.hdf5"))
    assert names(tmp_path / "z.hdf5") == ["z.hdf5"] and len(names(str(tmp_path / "*.hdf5"))) == 4
    assert discovery.model_label("a/g:MPI0001.hdf5") == "g"
    for bad, kind in (("nope*", FileNotFoundError), ([], FileNotFoundError), (("a",), TypeError)):
        with pytest.raises(kind):
            discovery.resolve(bad)
    with pytest.raises(ValueError, match="label"):
        discovery.labelled([str(tmp_path / "z.hdf5"), str(tmp_path / "z.hdf5")])
    with pytest.raises(TypeError):
        discovery.labelled(5)


HISTORY = "output_name string, row_in_file long, nodeUniqueIDBranchTip long, basicMass double, nodeIndex long, flag boolean, spectrum array<double>"


def history_rows(table):
    return [(o, i, n, m, k, True, [n * 10.0 + b for b in range(4)]) for o, rows in table.items() for i, (n, m, k) in enumerate(rows)]


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    table = {"Output1": [(103, 3.0, 30), (101, 1.0, 10), (104, 4.0, 40), (102, 2.0, 20)], "Output2": [(104, 44.0, 400), (105, 55.0, 500), (102, 22.0, 200)], "Output3": [(105, 5555.0, 5000), (104, 4444.0, 4000)]}
    at = tmp_path_factory.mktemp("history")
    groups = [("Output1", 2.0, 0.2, None), ("Output2", 6.0, 0.5, None), ("Output3", 13.8, 1.0, None)]
    return starloom.open_outputs(spark, make_store(spark, at / "t.store", (history_rows(table), HISTORY), groups))


def test_tracing(history):
    rows = history.trace_history([104, 101, 104], {"m": "nodeData/basicMass", "i": "nodeData/nodeIndex", "f": "nodeData/flag", "s": "nodeData/spectrum"}).orderBy("position").collect()
    assert [r["id"] for r in rows] == [104, 101, 104] and rows[0]["m"] == [4, 44, 4444] == rows[2]["m"]
    assert rows[1]["present"] == [True, False, False] and rows[1]["i"] == [10, -1, -1] and rows[1]["f"] == [True, False, False]
    assert rows[1]["m"][0] == 1 and all(map(math.isnan, rows[1]["m"][1:])) and rows[0]["redshift"] == [4.0, 1.0, 0.0]
    assert len(rows[0]["s"]) == 3 and rows[0]["s"][1] == [1040, 1041, 1042, 1043] and math.isnan(rows[1]["s"][2][3])


def test_tracing_contract(spark, history, tmp_path):
    m = {"m": "nodeData/basicMass"}
    with pytest.warns(UserWarning, match="no output"):
        assert history.trace_history([999], m).first()["present"] == [False] * 3
    again = history.trace_history([104], m, outputs=[3, "Output1", 3])
    assert again.first()["m"] == [4444, 4, 4444] and again.schema["present"].metadata["output_names"] == ["Output3", "Output1", "Output3"]
    for kind, call in ((ValueError, {"outputs": []}), (KeyError, {"outputs": [9]}), (ValueError, {"on_duplicate_file_match": "x"}), (KeyError, {"id_dataset": "nodeData/x"})):
        with pytest.raises(kind):
            history.trace_history([104], m, **call)
    with pytest.raises(ValueError, match="reserved"):
        history.trace_history([104], {"time": "nodeData/basicMass"})
    with pytest.raises(KeyError):
        history.trace_history([104], ["nodeData/none"])
    one = make_store(spark, tmp_path / "a.store", (history_rows({"Output1": [(10, 100.0, 1), (11, 110.0, 1), (12, 120.0, 1), (10, 7.0, 1)]}), HISTORY), [("Output1", 1.0, 1.0, None)])
    two = make_store(spark, tmp_path / "b.store", (history_rows({"Output1": [(12, 9999.0, 1), (13, 130.0, 1)]}), HISTORY), [("Output1", 1.0, 1.0, None)])
    c = starloom.open_outputs(spark, [one, two])
    with pytest.raises(ValueError, match="several files: 12"):
        c.trace_history([12], m)
    with pytest.warns(UserWarning, match="first file"):
        assert c.trace_history([12], m, on_duplicate_file_match="warn").first()["m"] == [120.0]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert c.trace_history([12], m, on_duplicate_file_match="first").first()["m"] == [120.0]
    with pytest.warns(UserWarning, match="several times in one file"):
        assert c.trace_history([10], m).first()["m"] == [100.0]
    cone = make_store(spark, tmp_path / "c.store", (history_rows({"Output1": [(1, 1.0, 1)]}), HISTORY), [("Output1", 1.0, 1.0, "lightcone")])
    with pytest.raises(ValueError, match="not snapshots"):
        starloom.open_outputs(spark, cone).trace_history([1], m)


def test_star_formation(spark, tmp_path):
    schema = "output_name string, row_in_file long, diskStarFormationHistoryMass array<array<double>>, diskStarFormationHistoryTimes array<double>"
    rows = [("Output1", 0, [[1.0, 2.0, 3.0], [10.0, 20.0, 30.0]], [1.0, 2.0, 3.0]), ("Output1", 1, [[4.0, 5.0], [40.0, 50.0]], [1.5, 2.5]), ("Output1", 2, [], [])]
    name = "Outputs/Output1/nodeData/diskStarFormationHistoryMass"
    group = [("Output1", 1.0, 1.0, None)]
    values = lambda df: [r["value"] for r in df.orderBy("row_in_file").collect()]
    ages = [("Parameters/starFormationHistory", "group", "countAges", "10"), ("Parameters/starFormationHistory", "group", "ageMinimum", "0.001")]
    fixed = starloom.open_outputs(spark, make_store(spark, tmp_path / "f.store", (rows, schema), group, attributes=ages))[name]
    assert values(starloom.sfh_collapse_metallicities(fixed)) == [[11, 22, 33], [0, 44, 55], [0, 0, 0]]
    times = values(starloom.sfh_times(fixed))
    assert times[0] == [1, 2, 3] and math.isnan(times[1][0]) and times[1][1:] == [1.5, 2.5] and all(map(math.isnan, times[2]))
    ragged = starloom.open_outputs(spark, make_store(spark, tmp_path / "r.store", (rows, schema), group))[name]
    assert values(starloom.sfh_collapse_metallicities(ragged)) == [[11, 22, 33], [44, 55], []] and starloom.sfh_times(ragged) is None
    own = starloom.open_outputs(spark, make_store(spark, tmp_path / "o.store", ([rows[0], rows[2]], schema), group, attributes=[*ages, (name, "dataset", "time", "[1.0, 2.0, 3.0]")]))[name]
    assert values(starloom.sfh_collapse_metallicities(own)) == [[11, 22, 33], [0, 0, 0]] and starloom.sfh_times(own) == [1, 2, 3]
    assert star_formation.parse_times("1.0,2.0") == [1, 2]


def analysis(name, y, target=None, cov=None, lower=None, upper=None, kind="function1D"):
    return (name, kind, f"about {name}", "x", "y", False, True, "Obs", target is not None, [float(i) for i in range(len(y))], y, lower, upper, cov, target, None, None, None)


def test_analyses(spark, tmp_path):
    rows = lambda k, *more: spark.createDataFrame([analysis("shared", [k, 2 * k], target=[1.0, 2.0], lower=[0.5 * k, 3 * k], upper=[2 * k, 3 * k]), analysis("cov", [5.0, 6.0], cov=[[0.01, 0.0], [0.0, -1.0]]), analysis("2d", [1.0], kind="function2D"), *more], store.ANALYSES)
    schema = "output_name string, row_in_file long, v double"
    node = ([("Output1", 0, 1.0)], schema)
    one = make_store(spark, tmp_path / "a.store", node, [("Output1", 1.0, 1.0, None)], rows(1.0))
    two = make_store(spark, tmp_path / "b.store", node, [("Output1", 1.0, 1.0, None)], rows(2.0, analysis("onlyB", [1.0])))
    none = make_store(spark, tmp_path / "n.store", node, [("Output1", 1.0, 1.0, None)])
    models = starloom.open_models(spark, {"A": one, "B": two})
    assert [(r["name"], r["models"]) for r in models.list_analyses("rows")] == [("cov", "A, B"), ("onlyB", "B"), ("shared", "A, B")]
    assert [r["hasTarget"] for r in models["A"].list_analyses("rows")] == [False, True]
    points = {(r["model"], r["name"], r["i"]): r for r in an.plot_data(an.of_models(models)).collect()}
    assert points["B", "shared", 0]["y_err_lower"] == 1.0 and points["B", "shared", 1]["y_err_lower"] == 0.0  # a bound on the wrong side is no bar
    assert points["A", "cov", 0]["y_err_upper"] == pytest.approx(0.1) and points["A", "cov", 1]["y_err_upper"] == 0.0
    assert points["A", "shared", 1]["y_target"] == 2.0 and points["B", "shared", 1]["y_target"] is None
    with pytest.raises(KeyError):
        starloom.open_outputs(spark, none).list_analyses()
    with pytest.raises(KeyError):
        an.chosen_names(["a"], "b")
    with pytest.raises(ValueError):
        an.normalised(models["A"], ["x"])
    with pytest.raises(TypeError):
        an.normalised([1], None)
    with pytest.raises(ImportError):
        models.plot_analyses()
    bad = spark.createDataFrame([analysis("bad", [1.0, 2.0], target=[1.0])], store.ANALYSES)
    with pytest.raises(Exception, match="differs in length"):
        an.curves(bad).collect()


def test_colliding_labels_and_missing_columns(spark, files, tmp_path):
    other = make_store(spark, tmp_path / "x.store", ([("Output1", 0, 1.0)], "output_name string, row_in_file long, basicMass double"), [("Output1", 1.0, 1.0, None)])
    with pytest.raises(KeyError, match="spin"):
        starloom.open_outputs(spark, [files[0], other]).nodes  # noqa: B018
    with pytest.raises(ValueError, match="label"):
        starloom.open_models(spark, [files[0], files[0]])
    assert starloom.open_models(spark, {"a": files[0]}).nodes().select("model").distinct().first()[0] == "a"
    assert starloom.open_outputs(spark, files[0]).output(1).agg(F.count("*")).first()[0] == 2


def test_slices_read_the_first_file_alone(spark, files):
    d = starloom.open_outputs(spark, list(files))["Outputs/Output1/nodeData/basicMass"]
    for key in (slice(None, -1), [1, 0], 0):
        assert {f.split("/nodes/")[0].rsplit("/", 1)[1] for f in d[key].inputFiles()} == {"g.store"}


def test_line_items_are_numbered_by_blocks_of_orders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapters, "BLOCK", 10, raising=False)
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    keys = [None, None, *range(0, 95, 3), -7, -40]
    rows = [(k, n, 1, 1, float(n), 1.0, 0.0, 0.0, "A", status, None) for status in ("O", "F", None) for k in keys for n in (2, 1)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes = adapters.part_nodes(spark, str(tmp_path))
    got = {}
    for r in nodes.orderBy("row_in_file").collect():
        got.setdefault((r["l_linestatus"], r["file_ord"]), []).append((r["row_in_file"], r["l_orderkey"], r["l_linenumber"]))
    want = sorted(((k, n) for k in keys for n in (1, 2)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    order = [(i, *x) for i, x in enumerate(want)]
    assert set(got) == {("O", 1), ("F", 0), (None, None)}
    for own in got.values():  # rows of null keys, first of all, tie
        assert [x[:2] for x in own] == [x[:2] for x in order] and own[4:] == order[4:]
    windows = [line for line in nodes._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("block#" in line for line in windows)  # no task numbers a whole file
