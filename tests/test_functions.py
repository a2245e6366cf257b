from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions.arrays import padded_front, right_aligned, sum_rows
from starloom.functions.numeric import NAN, differs, or_nan, ratio, step_of
from starloom.functions.student import t_quantile
from starloom.functions.text import plain_tex, safe_filename, safe_filename_column, some_ids
from starloom.functions.units import Units, column_units, convert_units, units_of, with_units
from starloom.operators.grubbs import grubbs_critical_value, iterative_grubbs


def test_ratio_follows_floating_point(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2.0


def test_nan_differs_from_itself(spark):
    df = spark.createDataFrame([(NAN, NAN), (1.0, 1.0), (1.0, NAN)], "a double, b double")
    assert [r[0] for r in df.select(differs(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert math.isnan(spark.range(1).select(or_nan(F.lit(None).cast("double"))).first()[0])


def test_step_of_is_a_search(spark):
    edges = [3, 5, 9, 20]
    got = {r[0]: r[1] for r in spark.range(1, 25).select("id", step_of(F.col("id"), edges)).collect()}
    assert all(got[v] == int(np.searchsorted(edges, v)) for v in range(1, 25))


def test_nested_sums(spark):
    rows = [(0, [[1.0, 2.0, 3.0], [10.0, 20.0, 30.0]]), (1, [[4.0, 5.0], [40.0, 50.0]]), (2, [])]
    df = spark.createDataFrame(rows, "i int, m array<array<double>>")
    assert [r[0] for r in df.select(sum_rows(F.col("m"))).collect()] == [[11, 22, 33], [44, 55], []]
    assert [r[1] for r in right_aligned(df.withColumn("m", sum_rows(F.col("m"))), "m", 0.0).orderBy("i").collect()] == [[11, 22, 33], [0, 44, 55], [0, 0, 0]]
    assert spark.range(1).select(padded_front(F.array(F.lit(1.5)), 3, 0.0)).first()[0] == [0.0, 0.0, 1.5]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([[1.0], [1.0, 2.0]],)], "m array<array<double>>").select(sum_rows(F.col("m"))).collect()


@pytest.mark.parametrize(("p", "dof", "t"), [(0.975, 1, 12.706204736), (0.975, 10, 2.228138852), (0.995, 5, 4.032142984), (0.9, 30, 1.310415025)])
def test_student_quantiles_match_tables(p, dof, t):
    assert t_quantile(p, dof) == pytest.approx(t, rel=1e-8)
    assert t_quantile(1 - p, dof) == pytest.approx(-t, rel=1e-8)


@pytest.mark.parametrize(("n", "g"), [(3, 1.1543), (5, 1.7150), (10, 2.2900), (20, 2.7082), (50, 3.1282)])
def test_grubbs_values_match_published_two_sided_tables(n, g):
    assert grubbs_critical_value(n, 0.05) == pytest.approx(g, abs=2e-3)


def test_grubbs_removes_in_order():
    points = np.r_[np.linspace(-1, 1, 20), 30.0, -60.0][:, None]
    assert iterative_grubbs(points) == [21, 20]
    assert iterative_grubbs(np.ones((5, 2))) == []
    assert iterative_grubbs(np.array([[0.0], [9.0]])) == []


def test_file_names(spark):
    names = {"step1:chain1/inner": "step1_chain1_inner", "a<>b": "a_b", "x. ": "x", "": "_", "...": "_"}
    assert {n: safe_filename(n) for n in names} == names
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", safe_filename_column(F.col("n"))).collect()} == names
    assert plain_tex(r"\hbox{M} \le \left \ge x") == r"\mathrm{M} \leq \left \geq x"
    assert some_ids(range(22)).endswith("(2 more)")


def test_units(spark):
    df = with_units(spark.createDataFrame([(2.0,)], "m double"), "m", units_of({"unitsInSI": "bad", "description": b"mass", "quantity": b"solMass", "isComoving": 0}))
    assert column_units(df, "m") == Units(1.0, "mass", "solMass", 0)
    assert convert_units(df, "m", "kg").first()[0] == pytest.approx(2 * 1.98892e30)
    with pytest.raises(ValueError, match="cannot convert"):
        convert_units(df, "m", "km/s")
    with pytest.warns(UserWarning, match="unknown unit"):
        with_units(df, "m", Units(1, "", "furlong"))
    assert units_of(None) is None and units_of(3.0).in_si == 3.0
