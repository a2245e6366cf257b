"""Queries that go through files and the facades: each writes small files from the tables, opens them again and returns what an operator says of them."""

from __future__ import annotations

import atexit
import itertools
import re
import shutil
import tempfile
from pathlib import Path
from types import SimpleNamespace
from xml.etree import ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_tex, some_ids
from ..functions.units import units_of
from ..operators import analyses, convergence, grubbs, parameters, star_formation, summaries
from ..operators.collection import Collection, open_models, open_outputs
from ..operators.outputs import index_outputs
from ..operators.run import open_mcmc
from ..operators.tables import make_table
from ..sources import chains as chain_source
from ..sources import discovery, store
from ..sources.config import MCMCConfig, ModelParameter, PriorSpec, parse_mcmc_config
from . import adapters as a
from .queries import CH, CL, HN, MO, PN, RH, query, rounded

_made: dict[tuple, str] = {}
_number = itertools.count()


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; where that is unset, on one machine, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="starloom-files-")
        atexit.register(shutil.rmtree, at, True)
    return f"{at.rstrip('/')}/files-{spark.sparkContext.applicationId}-{next(_number)}"


def _local() -> Path:
    """A new folder of the driver's, for files that only the driver reads."""
    at = tempfile.mkdtemp(prefix="starloom-xml-")
    atexit.register(shutil.rmtree, at, True)
    return Path(at)


def _once(make):
    """Files of a table are written once for each application."""

    def made(spark: SparkSession, d: str):
        key = (make.__name__, spark.sparkContext.applicationId, d)
        if key not in _made:
            _made[key] = make(spark, d)
        return _made[key]

    return made


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- simulation files


@_once
def _stores(spark, d):
    """Line items as the first output of two files by line status, suppliers as the second one's of the first file."""
    at = _folder(spark)
    part = a.part_nodes(spark, d)
    lines = part.select("file_ord", "output_name", "row_in_file", F.col("l_quantity").alias("basicMass"), F.col("l_discount").alias("spin"), F.col("l_linenumber").alias("nodeIndex"), F.array("l_quantity", "l_tax").alias("pair"))
    s = a.table(spark, d, "supplier")
    second = s.select(F.lit(0).alias("file_ord"), F.lit("Output2").alias("output_name"), (F.col("s_suppkey") - 1).alias("row_in_file"), F.col("s_acctbal").alias("basicMass"), (F.col("s_acctbal") / 1e5).alias("spin"), F.col("s_nationkey").alias("nodeIndex"), F.array("s_acctbal", "s_acctbal").alias("pair"))
    nodes = lines.unionByName(second)
    groups = spark.createDataFrame([("Output2", 6.0, 0.5, "snapshot"), ("Output1", 13.8, 1.0, None), ("Other", 1.0, 1.0, None)], "name string, time double, scale_factor double, output_type string")
    mass = ("float64", "(0,)", "a mass", 1.98892e30, "solar masses", "solMass", 0)
    properties = spark.createDataFrame([("Output1", "spin", "float64", "(0,)", "", None, None, None, None), ("Output1", "basicMass", *mass), ("Output2", "basicMass", *mass)], store.PROPERTIES)
    attributes = spark.createDataFrame([("Outputs/Output1", "group", "kind", "lines"), ("Outputs/Output1/nodeData/basicMass", "dataset", "comment", "a mass"), ("Parameters/x", "group", "value", "1")], store.ATTRIBUTES)
    for k in (0, 1):
        store.write(f"{at}/part{k}.store", nodes.where(F.col("file_ord") == k).drop("file_ord"), index_outputs(groups), k, properties, attributes, a.models(spark, d).where(F.col("model_ord") == (0, 9)[k]))
    return [f"{at}/part0.store", f"{at}/part1.store"]


@query(f"with {PN} select file_ord::bigint file_ord, row_in_file, l_quantity mass from pn where l_discount > 0.05 and l_quantity < 24")
def store_read_where(spark, d):
    """Two files read as one; the condition and the columns reach their scan."""
    rows = open_outputs(spark, _stores(spark, d)).read(1, {"mass": "nodeData/basicMass"}, "spin > 0.05 and basicMass < 24")
    return rows.select(F.col("file_ord").cast("long").alias("file_ord"), "row_in_file", "mass")


@query(f"with {PN}, n as (select count(*) n from gn) select 'mask' how, count(*) n, round(sum(l_quantity), 2) total from gn where global_row % 3 = 0 union all select 'take', count(*), round(sum(l_quantity), 2) from gn, n where global_row in (7, 0, n.n - 1)")
def dataset_read(spark, d):
    """A dataset's rows over all files by mask and by row numbers."""
    data = open_outputs(spark, _stores(spark, d))["Outputs/Output1/nodeData/basicMass"]
    total = lambda how, df: df.agg(F.lit(how).alias("how"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return total("mask", data.read(np.arange(data.shape[0]) % 3 == 0)).unionAll(total("take", data.read([7, 0, -1])))


SLICES = {
    "[-2:]": (slice(-2, None), "i >= n - 2", "i"), "[:-1]": (slice(None, -1), "i < n - 1", "i"), "[::-1]": (slice(None, None, -1), "true", "-i"), "[5:1:-2]": (slice(5, 1, -2), "i in (5, 3)", "-i"),
    "[1::4]": (slice(1, None, 4), "i % 4 = 1", "i"), "[0]": (0, "i = 0", "i"), "[-1]": (-1, "i = n - 1", "i"), "[9:3]": (slice(9, 3), "false", "i"),
}


@query(f"with {PN}, f as (select row_in_file i, l_quantity v, count(*) over () n from pn where file_ord = 0) " + " union all ".join(f"select '{k}' selection, count(*) n, round(coalesce(sum(v), 0), 2) total, arg_min(v, {o}) first_value, arg_max(v, {o}) last_value from f where {c}" for k, (_, c, o) in SLICES.items()) + " union all select '[[3, 0, 3, -1]]', 4, round(sum(v) + max(case when i = 3 then v end), 2), max(case when i = 3 then v end), max(case when i = n - 1 then v end) from f where i in (3, 0) or i = n - 1")
def dataset_slice(spark, d):
    """Selections of the first file's rows, as of an array."""
    data = open_outputs(spark, _stores(spark, d))["Outputs/Output1/nodeData/basicMass"]
    out = None
    for name, key in [*((k, s[0]) for k, s in SLICES.items()), ("[[3, 0, 3, -1]]", [3, 0, 3, -1])]:
        one = data[key].agg(F.lit(name).alias("selection"), F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.min_by("value", "position").alias("first_value"), F.max_by("value", "position").alias("last_value"))
        out = one if out is None else out.unionAll(one)
    return out


@query("select 'Output1' as output_name, 'basicMass' as name, count(*) n, 1::bigint axes, 'double' as dtype from lineitem union all select 'Output1', 'pair', count(*), 2, 'array<double>' from lineitem union all select 'Output2', 'nodeIndex', count(*), 1, 'int' from supplier")
def dataset_shape(spark, d):
    c = open_outputs(spark, _stores(spark, d))
    found = [(o, n, c[f"Outputs/{o}/nodeData/{n}"]) for o, n in (("Output1", "basicMass"), ("Output1", "pair"), ("Output2", "nodeIndex"))]
    return _rows(spark, [(o, n, x.shape[0], len(x.shape), x.dtype) for o, n, x in found], "output_name string, name string, n long, axes long, dtype string")


@query("select * from (values ('', 'Outputs,Parameters'), ('Outputs', 'Output1,Output2'), ('Outputs/Output1', 'nodeData'), ('Outputs/Output2/nodeData', 'basicMass,nodeIndex,pair,spin'), ('attrs Outputs/Output1', 'kind=lines'), ('attrs Outputs/Output1/nodeData/basicMass', 'comment=a mass'), ('contains', 'true,false')) t(path, found)")
def browse_files(spark, d):
    """Keys, attributes and membership below the root."""
    c = open_outputs(spark, _stores(spark, d))
    joined = lambda items: ",".join(items)
    attrs = lambda p: joined(f"{k}={v}" for k, v in c[p].attrs.items())
    rows = [("", joined(c.keys())), *((p, joined(c[p].keys())) for p in ("Outputs", "Outputs/Output1", "Outputs/Output2/nodeData")), *((f"attrs {p}", attrs(p)) for p in ("Outputs/Output1", "Outputs/Output1/nodeData/basicMass"))]
    rows.append(("contains", joined(str(x).lower() for x in ("spin" in c["Outputs/Output1/nodeData"], "Outputs/Output9" in c))))
    return _rows(spark, rows, "path string, found string")


@query("select * from (values ('Output1', 'basicMass', 'float64', 'a mass', 'solar masses'), ('Output1', 'spin', 'float64', '', ''), ('Output2', 'basicMass', 'float64', 'a mass', 'solar masses')) t(output_name, name, dtype, description, units)")
def list_properties(spark, d):
    c = open_outputs(spark, _stores(spark, d))
    return _rows(spark, [(f"Output{o}", *(r[k] for k in ("name", "dtype", "description", "units"))) for o in (1, 2) for r in c.list_properties(o, "rows")], "output_name string, name string, dtype string, description string, units string")


@query("select * from (values ('by place 0', 'Output1', 1::bigint, 13.8, 0.0), ('by place -1', 'Output2', 2, 6.0, 1.0), ('by name', 'Output2', 2, 6.0, 1.0), ('by number 1', 'Output1', 1, 13.8, 0.0), ('in order', 'Output1 Output2', 2, 19.8, 1.0)) t(asked, name, index, time, redshift)")
def output_lookup(spark, d):
    index = open_outputs(spark, _stores(spark, d)).outputs
    found = {"by place 0": index[0], "by place -1": index[-1], "by name": index["Output2"], "by number 1": index[discovery.output_name(np.int64(1))]}
    rows = [(k, m.name, m.index, m.time, m.redshift) for k, m in found.items()]
    every = list(index)
    rows.append(("in order", " ".join(m.name for m in every), len(index), sum(m.time for m in every), max(m.redshift for m in every)))
    return _rows(spark, rows, "asked string, name string, index long, time double, redshift double")


@query("select * from (values ('part1.store', 1::bigint)) t(file, status)")
def incomplete_store_files(spark, d):
    from ..operators.collection import incomplete_files

    c = open_outputs(spark, _stores(spark, d))
    return incomplete_files(c.status()).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("status_completion").cast("long").alias("status"))


@query("select n_name as name, n_name as label, greatest(n_regionkey, 1)::bigint files, case when n_regionkey = 0 then '' else ':MPI0000' end as first from nation")
def rank_files(spark, d):
    """Every nation is a run with as many rank files as its region's number, or one file without a rank; opened by the last file's name."""
    at, rows = _local(), []
    nations = [(r[0], r[1]) for r in a.table(spark, d, "nation").select("n_name", "n_regionkey").collect()]
    for name, ranks in nations:
        for suffix in [f":MPI{k:04d}" for k in range(ranks)] or [""]:
            (at / f"{name}{suffix}.hdf5").touch()
    for name, ranks in nations:
        files = discovery.resolve(at / (f"{name}:MPI{ranks - 1:04d}.hdf5" if ranks else f"{name}.hdf5"))
        rows.append((name, discovery.model_label(files[0]), len(files), Path(files[0]).stem.removeprefix(name)))
    return _rows(spark, rows, "name string, label string, files long, first string")


@query("select n_name label, (row_number() over (order by n_name) - 1)::bigint place from nation where n_regionkey < 2")
def model_labels(spark, d):
    """Models without labels are named by their files."""
    at = _local()
    names = [r[0] for r in a.table(spark, d, "nation").where("n_regionkey < 2").select("n_name").orderBy("n_name").collect()]
    for n in names:
        (at / f"{n}:MPI0000.hdf5").touch()
    return _rows(spark, [(label, i) for i, label in enumerate(discovery.labelled([str(at / f"{n}:MPI0000.hdf5") for n in names]))], "label string, place long")


@query("select s_suppkey, round(s_acctbal, 2) in_si, 'unit ' || s_nationkey description, case when s_nationkey % 2 = 0 then 'kg' else '' end quantity, (s_nationkey % 2)::bigint is_comoving from supplier")
def units_attribute(spark, d):
    """Units as files store them: records of numbers and bytes."""
    rows = a.table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").collect()
    read = [(k, units_of({"unitsInSI": str(x), "description": f"unit {n}".encode(), "quantity": "" if n % 2 else "kg", "isComoving": n % 2})) for k, x, n in rows]
    return _rows(spark, [(k, u.in_si, u.description, u.quantity, u.is_comoving) for k, u in read], "s_suppkey long, in_si double, description string, quantity string, is_comoving long").withColumn("in_si", F.round("in_si", 2))


# ---- histories


@_once
def _history(spark, d):
    at = f"{_folder(spark)}/orders.store"
    nodes = a.history_nodes(spark, d).drop("file_ord")
    store.write(at, nodes, index_outputs(a.order_years(spark, d).select(F.col("output_name").alias("name"), "time", "scale_factor", F.lit(None).cast("string").alias("output_type"))))
    return at


@query(f"with {HN}, s as (select id, cast(k as bigint) slot, [3, 1, 3][k + 1] y from (select distinct id from tr where id between 1 and 50) i, range(0, 3) t(k)) select s.id, s.slot, coalesce(present, false) present, round(mass, 2) mass, coalesce(n, -7) n from s left join tr on tr.id = s.id and tr.y = s.y")
def trace_chosen_outputs(spark, d):
    """Some outputs, in the order asked and with repeats, through the facade."""
    c = open_outputs(spark, _history(spark, d))
    rows = c.trace_history(range(1, 51), {"mass": "nodeData/basicMass", "n": "nodeData/nodeIndex"}, [3, "Output1", np.int64(3)], int_sentinel=-7)
    return rows.select("id", F.posexplode(F.arrays_zip("present", "mass", "n")).alias("slot", "s")).select("id", F.col("slot").cast("long").alias("slot"), "s.present", rounded("s.mass", 2).alias("mass"), "s.n")


@query("select k id from (select c_custkey k from customer union select -c_custkey from customer) where k not in (select o_custkey from orders)")
def never_found_ids(spark, d):
    """Half of the asked ids stand nowhere."""
    from ..operators import history

    asked = a.customers_asked(spark, d)
    return history.never_found(a.history_nodes(spark, d), asked.unionAll(asked.select("position", -F.col("id"))), "nodeUniqueIDBranchTip")


# ---- nested arrays


@query("select * from (values ('list', 1::bigint, 3::bigint, 6.0), ('commas', 1, 2, 4.5), ('none', 0, 0, 0.0), ('values', 1, 2, 3.0), ('empty', 1, 0, 0.0)) t(kind, known, n, total)")
def time_attribute(spark, d):
    raw = {"list": "[1.0, 2.0, 3.0]", "commas": "2.0,2.5", "none": None, "values": [1, 2.0], "empty": "[ ]"}
    found = {k: star_formation.parse_times(v) for k, v in raw.items()}
    return _rows(spark, [(k, int(v is not None), len(v or []), float(sum(v or []))) for k, v in found.items()], "kind string, known long, n long, total double")


@_once
def _sfh(spark, d):
    """Conversations as star-formation histories of fixed ages: two equal metallicities, and times beside them."""
    at = f"{_folder(spark)}/sfh.store"
    rows = a.conversation_lengths(spark, d).select(F.lit("Output1").alias("output_name"), F.col("conv_id").alias("row_in_file"), F.array("values", "values").alias("diskStarFormationHistoryMass"), F.col("values").alias("diskStarFormationHistoryTimes"))
    ages = spark.createDataFrame([("Parameters/starFormationHistory", "group", k, "1") for k in ("countAges", "ageMinimum")], store.ATTRIBUTES)
    store.write(at, rows, index_outputs(spark.createDataFrame([("Output1", 1.0, 1.0, None)], "name string, time double, scale_factor double, output_type string")), attributes=ages)
    return at


@query(f"with {CL} select conv_id, cast(i as bigint) i, cast(case when i - (w - len(v)) >= 0 then 2 * v[i - (w - len(v)) + 1] else 0 end as double) mass, cast(case when i - (w - len(v)) >= 0 then v[i - (w - len(v)) + 1] end as double) as time from c, w, range(0, 1000) t(i) where i < w")
def sfh_of_fixed_ages(spark, d):
    """A dataset's attributes say how its histories are to be read."""
    data = open_outputs(spark, _sfh(spark, d))["Outputs/Output1/nodeData/diskStarFormationHistoryMass"]
    mass, times = (df.select(F.col("row_in_file").alias("conv_id"), F.posexplode("value").alias("i", name)) for df, name in ((star_formation.sfh_collapse_metallicities(data), "mass"), (star_formation.sfh_times(data), "time")))
    return mass.join(times, ["conv_id", "i"]).select("conv_id", F.col("i").cast("long").alias("i"), "mass", rounded("time").alias("time"))


# ---- analyses


@query("select l_returnflag as name, 'quantity of flag ' || l_returnflag description, 'line' xAxisLabel, string_agg(distinct l_linestatus, ', ' order by l_linestatus) models from lineitem group by l_returnflag")
def analyses_of_files(spark, d):
    """The facades' listings of two files' analyses."""
    one, two = _stores(spark, d)
    models = open_models(spark, {"F": [one], "O": [two]})
    alone = {r["name"]: r for r in models["F"].list_analyses("rows")}
    return _rows(spark, [(r["name"], r["description"], alone[r["name"]]["xAxisLabel"], r["models"]) for r in models.list_analyses("rows")], "name string, description string, xAxisLabel string, models string")


@query(f"with {MO} select model, name, x::double x, round(y, 6) y from m where name in ('N', 'R')")
def plot_data_chosen(spark, d):
    rows = a.models(spark, d)
    available = [r[0] for r in analyses.one_dimensional(rows).select("name").distinct().orderBy("name").collect()]
    return analyses.plot_data(rows, analyses.chosen_names(available, ["R", "N"]), False).where("y_target is null").select("model", "name", "x", rounded("y").alias("y"))


@query("select * from (values ('alone', false, 'Model'), ('mapping', true, 'x,y'), ('list', true, 'part0,part1'), ('labels', true, 'p,q')) t(given, several, labels)")
def normalised_models(spark, d):
    one, two = (Collection(spark, [f]) for f in _stores(spark, d))
    cases = {"alone": (one, None), "mapping": ({"x": one, "y": two}, None), "list": ([one, two], None), "labels": ((one, two), ["p", "q"])}
    found = {k: analyses.normalised(*v) for k, v in cases.items()}
    return _rows(spark, [(k, several, ",".join(items)) for k, (several, items) in found.items()], "given string, several boolean, labels string")


# ---- text and tables


@query(r"""select t, '\mathrm{' || t || '} \leq \lesssim \geq' shown from (select distinct p_type t from part)""")
def plot_labels(spark, d):
    types = [r[0] for r in a.table(spark, d, "part").select("p_type").distinct().collect()]
    return _rows(spark, [(t, plain_tex(rf"\hbox{{{t}}} \le \lesssim \ge")) for t in types], "t string, shown string")


@query("select n_nationkey::bigint n, (select string_agg(i::varchar, ', ' order by i) from range(0, least(n_nationkey, 20)) t(i)) || case when n_nationkey > 20 then ', … (' || (n_nationkey - 20) || ' more)' else '' end as shown from nation where n_nationkey > 0")
def id_lists(spark, d):
    counts = [r[0] for r in a.table(spark, d, "nation").where("n_nationkey > 0").select("n_nationkey").collect()]
    return _rows(spark, [(n, some_ids(list(range(n)))) for n in counts], "n long, shown string")


@query("select r_regionkey::bigint r_regionkey, r_name from region")
def tables_in_forms(spark, d):
    rows = [{"r_regionkey": r[0], "r_name": r[1]} for r in a.table(spark, d, "region").collect()]
    frame = make_table(make_table(rows, "rows"), "pandas")
    return _rows(spark, [(int(k), n) for k, n in zip(frame["r_regionkey"], frame["r_name"], strict=True)], "r_regionkey long, r_name string")


# ---- configuration and parameter files


def _element(parent: ET.Element, tag: str, value: object = None) -> ET.Element:
    return ET.SubElement(parent, tag, {} if value is None else {"value": str(value)})


@_once
def _config(spark, d):
    """A configuration with a parameter for each nation (every seventh one inactive), and a likelihood with its own parameters for each region; and base files."""
    at = _local()
    root = ET.Element("parameters")
    nations = [tuple(r) for r in a.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]
    simulation = ET.Element("posteriorSampleSimulation", value="differentialEvolution")
    _element(simulation, "logFileRoot", "logs/chain")
    for key, name, region in nations:
        p = _element(simulation, "modelParameter", "inactive" if key % 7 == 6 else "active")
        _element(p, "name", f"region[{region + 1}]/{name.replace(' ', '_')}")
        if key % 3:
            _element(p, "label", f"n_{key}")
        prior = _element(p, "distributionFunction1DPrior", "uniform")
        _element(prior, "limitLower", key)
        _element(prior, "limitUpper", key + region + 1)
        if key % 2:
            _element(p, "operatorUnaryMapper", "logarithm")
        _element(_element(p, "distributionFunction1DPerturber", "cauchy"), "scale", key / 4)
    independent = _element(root, "posteriorSampleLikelihood", "independentLikelihoods")
    for region in range(5):
        _element(independent, "parameterMap", " ".join(f"region[{r + 1}]/{name.replace(' ', '_')}" for key, name, r in nations if r == region and key % 7 != 6))
        _element(_element(independent, "posteriorSampleLikelihood", f"galaxies{region}"), "baseParametersFileName", f"base{region}.xml")
        base = ET.Element("parameters")
        for r in range(5):
            group = _element(base, "region", f"region{r}")
            for key, name, own in nations:
                if own == r:
                    _element(group, name.replace(" ", "_"), "0.0")
        ET.ElementTree(base).write(at / f"base{region}.xml")
    root.append(simulation)
    ET.ElementTree(root).write(at / "run.xml")
    return str(at / "run.xml")


NA = "na as (select *, 'region[' || (n_regionkey + 1) || ']/' || replace(n_name, ' ', '_') as name from nation where n_nationkey % 7 <> 6), nr as (select *, row_number() over (order by n_nationkey) - 1 place from na)"


@query(f"with {NA} select place, name, case when n_nationkey % 3 = 0 then replace(n_name, ' ', '_') else 'n_' || n_nationkey end as label, 'uniform' prior, n_nationkey::double low, (n_nationkey + n_regionkey + 1)::double high, round(power(n_regionkey + 1, 2) / 12, 6) variance, case when n_nationkey % 2 = 1 then 'logarithm' else 'identity' end mapper, n_nationkey / 4.0 as scale from nr")
def config_parameters(spark, d):
    c = parse_mcmc_config(_config(spark, d))
    rows = [(i, p.name, p.display_label, p.prior.kind, p.prior.params["limitLower"], p.prior.params["limitUpper"], summaries.prior_variance(p.prior, p.name), p.mapper, p.perturber.params["scale"]) for i, p in enumerate(c.parameters)]
    return _rows(spark, rows, "place long, name string, label string, prior string, low double, high double, variance double, mapper string, scale double").withColumn("variance", F.round("variance", 6))


@query(f"with {NA} select n_regionkey::bigint leaf, 'galaxies' || n_regionkey kind, 'base' || n_regionkey || '.xml' base, string_agg(place::varchar, ',' order by place) state_places from nr group by n_regionkey")
def config_likelihoods(spark, d):
    """The leaves of the likelihood, their base files beside the configuration, and where their parameters stand in a state."""
    c = parse_mcmc_config(_config(spark, d))
    here = c.config_path.parent
    return _rows(spark, [(i, x.kind, str(x.base_parameters_file.relative_to(here)), ",".join(map(str, c.state_indices_for(x)))) for i, x in enumerate(c.likelihood.leaves())], "leaf long, kind string, base string, state_places string")


@query("select * from (values ('differentialEvolution', 22::bigint), ('particleSwarm', 44)) t(kind, columns)")
def config_state_columns(spark, d):
    from dataclasses import replace

    c = parse_mcmc_config(_config(spark, d))
    return _rows(spark, [(k, replace(c, simulation_kind=k).state_columns) for k in ("differentialEvolution", "particleSwarm")], "kind string, columns long")


@query("select l.leaf::bigint leaf, 'base' || leaf || '.xml' stem, n_nationkey::bigint nation, case when n_regionkey = leaf and n_nationkey % 7 <> 6 then (n_nationkey * 1.5)::double else 0.0 end as value from nation, range(0, 5) l(leaf)")
def parameter_files(spark, d):
    """A state written into the base file of every likelihood, and read again."""
    c = parse_mcmc_config(_config(spark, d))
    nations = [tuple(r) for r in a.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]
    written = parameters.emit_parameter_files([key * 1.5 for key, _, _ in nations if key % 7 != 6], c, _local() / "out", name_format="{leaf_index}_{stem}.xml")
    rows = []
    for leaf, path in written:
        root = parameters.read_parameter_file(path).getroot()
        for key, name, region in nations:
            rows.append((leaf, path.name.split("_", 1)[1], key, float(parameters.resolve_parameter_path(root, f"region[@value='region{region}']/{name.replace(' ', '_')}").get("value"))))
    return _rows(spark, rows, "leaf long, stem string, nation long, value double")


@query(f"with {NA} select n_nationkey::bigint nation, case when n_regionkey = 2 then place::double else 0.0 end as value from nr")
def parameter_file_of_one(spark, d):
    """One likelihood's file, through the run; the other elements keep the base's values."""
    with open_mcmc(spark, _config(spark, d)) as run:
        n = len(run.parameters)
        path = run.write_parameter_file(np.arange(n), _local() / "deep" / "one.xml", likelihood_index=2)
        many = run.write_parameter_files(np.arange(n), _local())
        names = [p.name for p in run.parameters]
    roots = [parameters.read_parameter_file(p).getroot() for p in (path, many[2][1])]
    values = [[float(parameters.resolve_parameter_path(r, n).get("value")) for n in names] for r in roots]
    keys = [r[0] for r in a.table(spark, d, "nation").where("n_nationkey % 7 <> 6").select("n_nationkey").orderBy("n_nationkey").collect()]
    return _rows(spark, [(k, x if x == y else float("nan")) for k, x, y in zip(keys, *values, strict=True)], "nation long, value double")


@query(f"with {CH}, c as (select var_samp(v0) a, covar_samp(v0, v1) b, var_samp(v1) c, avg(v0) m0, avg(v1) m1 from ch) select 'metaParameter' || i as name, 'active' kind, 'normal' prior, '-4 4' limits, 0.0 mean, 0::bigint terms from range(0, 2) t(i) union all select 'node/value', 'derived', null, null, round(m0, 5), 1 from c union all select 'node/k', 'derived', null, null, round(m1, 5), 2 from c")
def reparameterisation_file(spark, d):
    """The normal fit's configuration, read again: unit-normal parameters, and the original ones as sums of them."""
    from .queries import chain_set

    path = summaries.multivariate_normal_fit(chain_set(spark, d), post_burn=0).write_reparameterization_config(_local() / "re.xml", n_sigma=4.0)
    rows = []
    for p in ET.parse(path).getroot().findall("modelParameter"):
        prior, definition = p.find("distributionFunction1DPrior"), p.find("definition")
        limits = None if prior is None else " ".join(prior.find(k).get("value") for k in ("limitLower", "limitUpper"))
        text = None if definition is None else definition.get("value")
        mean = 0.0 if text is None else float(re.match(r"[-+]?[\d.]+(e[-+]\d+)?", text)[0])
        rows.append((p.find("name").get("value"), p.get("value"), None if prior is None else prior.get("value"), limits, mean, 0 if text is None else text.count("%[metaParameter")))
    return _rows(spark, rows, "name string, kind string, prior string, limits string, mean double, terms long").withColumn("mean", F.round("mean", 5))


# ---- chains as files


@_once
def _logs(spark, d):
    """Events as the logs of four ranks, and their configuration; the first one has a header."""
    at = _folder(spark)
    e = a.chain_rows(spark, d)
    value = lambda i: F.element_at("state", i).cast("string")
    line = F.concat_ws(" ", F.lit(""), F.col("step").cast("string"), F.col("chain_index").cast("string"), F.lit("0.25"), F.when(F.col("converged"), "T").otherwise(".false."), F.col("log_posterior").cast("string"), F.col("log_likelihood").cast("string"), value(1), value(2))
    hadoop = spark._jvm.org.apache.hadoop.fs
    for k in range(a.CHAINS):
        rows = e.where(F.col("chain_index") == k).orderBy("row_idx").select(line.alias("value"))
        if k == 0:
            head = spark.createDataFrame([("# 1 = Simulation state",), ("#    7 = Parameter `node/value`",), ("#    8 = Parameter `node/k`",), ("",)], "value string")
            rows = head.coalesce(1).unionAll(rows.coalesce(1))
        rows.coalesce(1).write.text(f"{at}/{k}.text")
        fs = hadoop.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in fs.listStatus(hadoop.Path(f"{at}/{k}.text")) if s.getPath().getName().startswith("part-"))
        fs.rename(part, hadoop.Path(f"{at}/chain_{k:04d}.log"))
    root = ET.Element("parameters")
    simulation = _element(root, "posteriorSampleSimulation", "differentialEvolution")
    _element(simulation, "logFileRoot", f"{at.removeprefix('file://')}/chain")
    for name, label in (("node/value", "v"), ("node/k", None)):
        p = _element(simulation, "modelParameter", "active")
        _element(p, "name", name)
        if label:
            _element(p, "label", label)
        prior = _element(p, "distributionFunction1DPrior", "uniform")
        _element(prior, "limitLower", 0)
        _element(prior, "limitUpper", 100)
    config = _local() / "mcmc.xml"
    ET.ElementTree(root).write(config)
    return str(config)


def _run(spark: SparkSession, d: str):
    return open_mcmc(spark, _logs(spark, d))


@query(f"with {CH} select chain_index, row_idx, step, event_type <> 'error' converged, log_posterior, log_likelihood, v0, v1, 0.25::double eval_time from ch")
def chains_of_logs(spark, d):
    """A run's logs, found by its configuration and read as chains."""
    rows = chain_source.read_chains(spark, parse_mcmc_config(_logs(spark, d)), cache=False).rows
    return rows.select("chain_index", "row_idx", "step", "converged", "log_posterior", "log_likelihood", F.element_at("state", 1).alias("v0"), F.element_at("state", 2).alias("v1"), "eval_time")


@query(f"with {CH}, n as (select chain_index, count(*) n from ch group by 1) select 'all' part, chain_index, chain_index place, n from n union all select '[1:3]', chain_index, chain_index, n from n where chain_index in (1, 2) union all select '[-1]', chain_index, chain_index, n from n where chain_index = 3 union all select 'rows of [2]', chain_index, min(row_idx), count(*) from ch where chain_index = 2 group by 2")
def chain_access(spark, d):
    with _run(spark, d) as run:
        chains = run.chains
        rows = [("all", c.chain_index, c.chain_pos, c.n_steps) for c in (chains[i] for i in range(len(chains)))]
        rows += [("[1:3]", c.chain_index, c.chain_pos, c.n_steps) for c in (chains[1:3][i] for i in range(2))]
        rows.append(("[-1]", chains[-1].chain_index, chains[-1].chain_pos, chains[-1].n_steps))
        rows.append(("rows of [2]", 2, *chains[2].rows.agg(F.min("row_idx"), F.count("*")).first()))
    return _rows(spark, rows, "part string, chain_index long, place long, n long")


@query(f"with {RH}, x as (select step, max(rhat) m from r group by step) select 'converged after' what, min(step)::bigint n from x where m <= 1.1 union all select 'burn-in as given', 7")
def run_convergence(spark, d):
    """The step after which a run has converged, and what is taken as its burn-in."""
    with _run(spark, d) as run:
        chains = run.chains
        found = run.convergence_step(step_grid=[chains.shortest * k // 10 for k in range(1, 11)])
        return _rows(spark, [("converged after", found), ("burn-in as given", convergence.resolve_post_burn(chains, 7))], "what string, n long")


@query(f"with {CH}, r as (select chain_index, row_idx, v0 <> lag(v0) over w or v1 <> lag(v1) over w c from ch window w as (partition by chain_index order by row_idx)) select 'acceptance ' || chain_index what, round(avg(c::int), 6) as value from r where row_idx >= 10 group by chain_index union all select 'best posterior', round(max(log_posterior), 6) from ch union all select 'best likelihood', round(max(log_likelihood), 6) from ch")
def run_methods(spark, d):
    """Operators as methods of a run."""
    with _run(spark, d) as run:
        rates = run.acceptance_rate(post_burn=9)
        rows = [*((f"acceptance {c}", float(x)) for c, x in enumerate(rates)), ("best posterior", float(run.maximum_posterior().log_posterior)), ("best likelihood", float(run.maximum_likelihood().log_likelihood))]
    return _rows(spark, rows, "what string, value double").withColumn("value", F.round("value", 6))


class _Strides:
    """Stands for a random generator: draws at a fixed stride."""

    def choice(self, total: int, size: int, replace: bool) -> np.ndarray:
        return np.arange(size) * 7919 % total


@query(f"with {CH}, p as (select row_number() over (order by chain_index, row_idx) - 1 pool_row, chain_index, step, v0, log_posterior from ch where row_idx >= 5), w as (select i draw_pos, i * 7919 % (select count(*) from p) pool_row from range(0, 100) t(i)) select draw_pos, chain_index, step, v0, log_posterior from w join p using (pool_row)")
def posterior_samples(spark, d):
    """Draws from all chains after the burn-in, by a generator that both sides know."""
    with _run(spark, d) as run:
        s = run.posterior_samples(100, post_burn=5, rng=_Strides())
    return _rows(spark, [(i, int(c), int(t), float(x), float(p)) for i, (c, t, x, p) in enumerate(zip(s.chain_index, s.step, s.state[:, 0], s.log_posterior, strict=True))], "draw_pos long, chain_index long, step long, v0 double, log_posterior double")


@query(f"with {CH}, c as (select var_samp(v0) * 12 / 1e4 a, covar_samp(v0, v1) * 12 / 1e4 b, var_samp(v1) * 12 / 1e4 c from ch), e as (select *, (a + c) / 2 m, sqrt(power((a - c) / 2, 2) + b * b) r from c), l as (select 0 k, a, b, m - r l from e union all select 1, a, b, m + r from e), v as (select k, abs(b) / sqrt(b * b + (l - a) * (l - a)) x, abs(l - a) / sqrt(b * b + (l - a) * (l - a)) y from l), t as (select k, 'v' as label, x s from v union all select k, 'k', y from v) select k::bigint k, label, round(s, 6) size, (count(*) over (partition by k))::bigint terms from t where s * s >= 0.001")
def directions(spark, d):
    """The directions' larger components by size (their signs have no meaning), and the terms of their texts."""
    with _run(spark, d) as run:
        r = run.projection_pursuit(post_burn=0)
    rows = [(k, label, abs(x), r.latex_summary(k, contribution_minimum=0.001).count(r"\,")) for k in range(2) for label, x in r.direction(k, contribution_minimum=0.001)]
    return _rows(spark, rows, "k long, label string, size double, terms long").withColumn("size", F.round("size", 6))


# ---- outliers

#: The published critical values of Grubbs' two-sided test at 5 per cent, by the number of points.
GRUBBS = {3: 1.1543, 4: 1.4812, 5: 1.7150, 6: 1.8871, 7: 2.0200, 8: 2.1266, 9: 2.2150, 10: 2.2900}


@query("select * from (values " + ", ".join(f"({n}::bigint, {g:.3f})" for n, g in GRUBBS.items()) + ") t(n, critical)")
def grubbs_values(spark, d):
    return _rows(spark, [(n, round(grubbs.grubbs_critical_value(n, 0.05), 3)) for n in GRUBBS], "n long, critical double")


FAR = "greatest(case when sx > 0 then abs(p.x - mx) / sx else 0 end, case when sy > 0 then abs(p.y - my) / sy else 0 end)"


@query(f"""with recursive e as (select cast(user_id % 12 as bigint) c, arg_max(case when user_id % 12 = 5 then 900.0 when user_id % 12 = 2 then -500.0 else value end, event_id) x, arg_max(cast(json_extract_string(props, '$.k') as double), event_id) y from events group by 1),
r(round, l, gone) as (select 0, (select list(struct_pack(c := c, x := x, y := y) order by c) from e), -1::bigint
 union all select round + 1, list_filter(l, lambda p: p.c <> w.c), w.c from
 (select round, l, list_filter(l, lambda p: {FAR} = top)[1] w, top from (select *, list_max(list_transform(l, lambda p: {FAR})) top from
  (select round, l, list_avg(list_transform(l, lambda p: p.x)) mx, list_stddev_samp(list_transform(l, lambda p: p.x)) sx, list_avg(list_transform(l, lambda p: p.y)) my, list_stddev_samp(list_transform(l, lambda p: p.y)) sy from r))) s
 where len(l) >= 3 and top > map {{{', '.join(f"{n}: {g}" for n, g in (GRUBBS | {11: 2.3547, 12: 2.4116}).items())}}}[len(l)])
select (round - 1)::bigint place, gone chain_index from r where round > 0""")
def outlier_chains(spark, d):
    """Twelve chains, of which two end far from the others; removed one by one."""
    rows = a.chain_rows(spark, d, 12)
    far = F.when(F.col("chain_index") == 5, F.lit(900.0)).when(F.col("chain_index") == 2, F.lit(-500.0)).otherwise(F.element_at("state", 1))
    config = MCMCConfig(Path("run.xml"), Path("log"), "differentialEvolution", tuple(ModelParameter(n, None, PriorSpec("uniform", {"limitLower": 0.0, "limitUpper": 1.0})) for n in ("x", "y")))
    found = convergence.outlier_chains(chain_source.from_rows(config, rows.withColumn("state", F.array(far, F.element_at("state", 2)))))
    return _rows(spark, list(enumerate(found)), "place long, chain_index long")


# ---- what is refused


def _refusals(spark: SparkSession, d: str) -> dict[str, object]:
    c = open_outputs(spark, _stores(spark, d))
    config = parse_mcmc_config(_config(spark, d))
    ragged = a.models(spark, d).withColumn("y_target", F.slice("y_target", 1, 2))
    snapshots = SimpleNamespace(spark=spark, outputs=c.outputs, nodes=c.nodes)
    from dataclasses import replace

    from ..operators import history

    logs = parse_mcmc_config(_logs(spark, d))
    other = replace(logs, parameters=(replace(logs.parameters[0], name="node/other"), logs.parameters[1]))
    return {
        "a header that names other parameters": lambda: chain_source.read_chains(spark, other, cache=False),
        "a log root without logs": lambda: chain_source.read_chains(spark, config, cache=False),
        "a missing output": lambda: c.read(9, ["basicMass"]),
        "a missing dataset": lambda: c.read(1, ["nothing"]),
        "a missing path": lambda: c["Outputs/Output7"],
        "a place out of range": lambda: c["Outputs/Output1/nodeData/basicMass"][1 << 40],
        "a mask of another length": lambda: c.read(1, ["basicMass"], [True]),
        "an incomplete file": c.validate_completion,
        "no outputs chosen": lambda: history.trace_galaxy_history(snapshots, [1], ["nodeData/basicMass"], []),
        "a reserved label": lambda: history.trace_galaxy_history(snapshots, [1], {"time": "nodeData/basicMass"}),
        "a missing id dataset": lambda: history.trace_galaxy_history(snapshots, [1], ["nodeData/basicMass"]),
        "an unknown analysis": lambda: analyses.chosen_names(["a"], "b"),
        "curves of two lengths": lambda: analyses.curves(ragged).collect(),
        "an unknown parameter": lambda: parameters.apply_state(parameters.read_parameter_file(config.likelihood.leaves()[0].base_parameters_file), config.parameters, np.zeros(22), parameter_map=["none"]),
        "a state of another length": lambda: parameters.emit_parameter_files([1.0], config, _local()),
        "a likelihood out of range": lambda: open_mcmc(spark, _config(spark, d)).write_parameter_file(np.zeros(22), _local() / "x.xml", likelihood_index=9),
        "a mapper that has no variance": lambda: summaries.prior_variance(PriorSpec("other", {}), "p"),
        "a table in no known form": lambda: make_table([], "xml"),
        "two models of one label": lambda: open_models(spark, _stores(spark, d)[:1] * 2),
        "a history without a companion": lambda: star_formation.companion("disk"),
        "too few points": lambda: grubbs.grubbs_critical_value(2, 0.05),
    }


REFUSED = {
    "a header that names other parameters": "ValueError", "a log root without logs": "FileNotFoundError", "a missing output": "KeyError", "a missing dataset": "KeyError", "a missing path": "KeyError", "a place out of range": "IndexError",
    "a mask of another length": "IndexError", "an incomplete file": "RuntimeError", "no outputs chosen": "ValueError", "a reserved label": "ValueError", "a missing id dataset": "KeyError", "an unknown analysis": "KeyError",
    "curves of two lengths": "SparkRuntimeException", "an unknown parameter": "KeyError", "a state of another length": "ValueError", "a likelihood out of range": "IndexError", "a mapper that has no variance": "NotImplementedError",
    "a table in no known form": "ValueError", "two models of one label": "ValueError", "a history without a companion": "ValueError", "too few points": "ValueError",
}


@query("select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in REFUSED.items()) + ") t(what, error)")
def refused(spark, d):
    """What each operator refuses, and as which error."""
    rows = []
    for what, call in _refusals(spark, d).items():
        try:
            call()
            rows.append((what, None))
        except Exception as e:
            rows.append((what, type(e).__name__))
    return _rows(spark, rows, "what string, error string")
