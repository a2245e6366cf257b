"""Reduced one-dimensional analyses of one or several models: listing, errors, and curves ready for plotting."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tex, safe_filename
from .tables import make_table

KIND = "function1D"


def one_dimensional(analyses: DataFrame) -> DataFrame:
    return analyses.where(F.col("type") == KIND)


def listing(analyses: DataFrame) -> DataFrame:
    """Name, description, axes and whether there is a target, by name."""
    return one_dimensional(analyses).select("name", "description", F.col("x_label").alias("xAxisLabel"), F.col("y_label").alias("yAxisLabel"), F.coalesce("x_log", F.lit(False)).alias("xAxisIsLog"), F.coalesce("y_log", F.lit(False)).alias("yAxisIsLog"), F.coalesce("has_target", F.lit(False)).alias("hasTarget")).orderBy("name")


def listing_of_models(analyses: DataFrame) -> DataFrame:
    """The same over models (columns model, model_ord): `models` joins their labels by name, the rest is the first model's."""
    found = one_dimensional(analyses)
    fields = ["description", "x_label", "y_label", "x_log", "y_log", "has_target"]
    first = F.min_by(F.struct(*fields), "model_ord")
    rows = found.groupBy("name").agg(first.alias("f"), F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("models"))
    return rows.select("name", F.col("f.description").alias("description"), F.col("f.x_label").alias("xAxisLabel"), F.col("f.y_label").alias("yAxisLabel"), F.coalesce("f.x_log", F.lit(False)).alias("xAxisIsLog"), F.coalesce("f.y_log", F.lit(False)).alias("yAxisIsLog"), F.coalesce("f.has_target", F.lit(False)).alias("hasTarget"), "models").orderBy("name")


def _shaped(values: Column, like: Column, what: str) -> Column:
    return F.when(values.isNull() | (F.size(values) == F.size(like)), values).otherwise(F.raise_error(F.concat(F.lit(f"{what} differs in length from y in "), F.col("name"))).cast("array<double>"))


def sigma(covariance: Column, like: Column) -> Column:
    """Square roots of the diagonal, negative values as 0."""
    square = (F.size(covariance) == F.size(like)) & F.forall(covariance, lambda r: F.size(r) == F.size(covariance))
    roots = F.transform(F.sequence(F.lit(1), F.size(covariance)), lambda i: F.sqrt(F.greatest(F.element_at(F.element_at(covariance, i), i), F.lit(0.0))))
    return F.when(covariance.isNull(), F.lit(None)).when(square, roots).otherwise(F.raise_error(F.concat(F.lit("the covariance is not of y's size in "), F.col("name"))).cast("array<double>"))


def errors(lower: Column, upper: Column, covariance: Column, y: Column) -> tuple[Column, Column]:
    """Lengths of the error bars below and above y: from bounds if both are there (never negative), else from the covariance, else null."""
    lower, upper = _shaped(lower, y, "the lower error"), _shaped(upper, y, "the upper error")
    both = lower.isNotNull() & upper.isNotNull()
    s = sigma(covariance, y)
    less = F.zip_with(y, lower, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    more = F.zip_with(y, upper, lambda a, b: F.greatest(b - a, F.lit(0.0)))
    return F.when(both, less).otherwise(s), F.when(both, more).otherwise(s)


def curves(analyses: DataFrame) -> DataFrame:
    """One row per analysis (and model, if there is such a column): x, y, y_target and the error bars of both."""
    c = F.col
    y = _shaped(c("y"), c("x"), "x")
    lo, hi = errors(c("y_lower"), c("y_upper"), c("y_covariance"), c("y"))
    target = _shaped(c("y_target"), c("y"), "the target")
    tlo, thi = errors(c("target_lower"), c("target_upper"), c("target_covariance"), c("y_target"))
    keys = [k for k in ("model", "model_ord") if k in analyses.columns]
    return one_dimensional(analyses).select(*keys, "name", "x", y.alias("y"), lo.alias("y_err_lower"), hi.alias("y_err_upper"), target.alias("y_target"), tlo.alias("target_err_lower"), thi.alias("target_err_upper"), "target_label", "x_label", "y_label", "x_log", "y_log")


def points(curve_rows: DataFrame) -> DataFrame:
    """Curves in long form: one row per point."""
    keys = [k for k in ("model", "model_ord", "name") if k in curve_rows.columns]
    fields = ["x", "y", "y_err_lower", "y_err_upper", "y_target", "target_err_lower", "target_err_upper"]
    whole = [F.coalesce(F.col(f), F.array().cast("array<double>")).alias(f) for f in fields]  # a missing array is as many nulls
    return curve_rows.select(*keys, *whole).select(*keys, F.posexplode(F.arrays_zip(*fields)).alias("i", "p")).select(*keys, "i", *[F.col(f"p.{f}") for f in fields])


def plot_data(analyses: DataFrame, name: str | Sequence[str] | None = None, show_target: bool = True) -> DataFrame:
    """Points of all models for the chosen analyses; the target stands once, with the first model that has it."""
    chosen = one_dimensional(analyses)
    if name is not None:
        chosen = chosen.where(F.col("name").isin([name] if isinstance(name, str) else list(name)))
    rows = curves(chosen)
    if "model_ord" in rows.columns:
        first = F.min(F.when(F.col("y_target").isNotNull(), F.col("model_ord"))).over(Window.partitionBy("name"))
        keep = F.lit(show_target) & (F.col("model_ord") == first)
    else:
        keep = F.lit(show_target)
    for c in ("y_target", "target_err_lower", "target_err_upper"):
        rows = rows.withColumn(f"k_{c}", F.when(keep, F.col(c)))
    for c in ("y_target", "target_err_lower", "target_err_upper"):
        rows = rows.withColumn(c, F.col(f"k_{c}")).drop(f"k_{c}")
    return points(rows)


def chosen_names(available: Sequence[str], name: str | Sequence[str] | None) -> list[str]:
    if name is None:
        return list(available)
    wanted = [name] if isinstance(name, str) else list(name)
    if missing := [n for n in wanted if n not in set(available)]:
        raise KeyError(f"no analysis {missing[0]!r}; there are {', '.join(available)}")
    return wanted


def list_analyses(collection, format: str = "pandas"):
    return make_table([r.asDict() for r in listing(collection.analyses).collect()], format)


def normalised(collection, labels: Sequence[str] | None) -> tuple[bool, dict]:
    """Whether several models are meant, and collections by label."""
    from ..sources.discovery import model_label
    from .collection import Collection

    if isinstance(collection, Collection):
        if labels is not None:
            raise ValueError("labels belong to several collections")
        return False, {"Model": collection}
    if isinstance(collection, Mapping):
        if labels is not None:
            raise ValueError("a mapping has its labels already")
        items = {str(k): c for k, c in collection.items()}
    else:
        try:
            found = list(collection)
        except TypeError as e:
            raise TypeError(f"expected a collection, a sequence or a mapping of them; got {type(collection).__name__}") from e
        if not all(isinstance(c, Collection) for c in found):
            raise TypeError("every element must be a collection")
        names = [model_label(c.files[0]) for c in found] if labels is None else [str(x) for x in labels]
        if len(names) != len(found):
            raise ValueError(f"{len(names)} labels for {len(found)} collections")
        if len(set(names)) != len(names):
            raise ValueError(f"labels must differ; got {names}")
        items = dict(zip(names, found, strict=True))
    if not items:
        raise ValueError("there is no collection")
    if not all(isinstance(c, Collection) for c in items.values()):
        raise TypeError("every value must be a collection")
    return True, items


def of_models(items: Mapping) -> DataFrame:
    out = None
    for i, (label, c) in enumerate(items.items()):
        part = c.analyses.withColumn("model", F.lit(label)).withColumn("model_ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def plot_analyses(collection, name: str | Sequence[str] | None = None, output_directory: str | Path | None = None, *, labels: Sequence[str] | None = None, show_target: bool = True, figsize: tuple[float, float] = (7.0, 5.0), dpi: int = 120, file_format: str = "pdf") -> dict:
    """A figure per analysis, drawn from plot_data() by matplotlib if it is there."""
    try:
        from matplotlib.figure import Figure
    except ImportError as e:
        raise ImportError("plotting needs matplotlib; plot_data() gives the points without it") from e
    several, items = normalised(collection, labels)
    rows = of_models(items)
    available = [r[0] for r in one_dimensional(rows).select("name").distinct().orderBy("name").collect()]
    if not available:
        warnings.warn("no one-dimensional analyses found", UserWarning, stacklevel=2)
        return {}
    chosen = chosen_names(available, name)
    data = plot_data(rows, chosen, show_target).orderBy("name", "model_ord", "i").toPandas()
    about = {r["name"]: r for r in curves(rows).select("name", "x_label", "y_label", "x_log", "y_log", "target_label", "model_ord").orderBy(F.desc("model_ord")).collect()}
    folder = None if output_directory is None else Path(output_directory)
    if folder:
        folder.mkdir(parents=True, exist_ok=True)
    figures = {}
    for n in chosen:
        figure = Figure(figsize=figsize, dpi=dpi)
        ax = figure.add_subplot()
        for model, part in data[data["name"] == n].groupby("model", sort=False):
            bars = None if part["y_err_lower"].isna().all() else [part["y_err_lower"], part["y_err_upper"]]
            ax.errorbar(part["x"], part["y"], yerr=bars, label=model if several else "Model")
            if part["y_target"].notna().any():
                bars = None if part["target_err_lower"].isna().all() else [part["target_err_lower"], part["target_err_upper"]]
                ax.errorbar(part["x"], part["y_target"], yerr=bars, fmt="o", color="black", label=about[n]["target_label"] or "Target")
        ax.set_title(n)
        ax.set_xlabel(plain_tex(about[n]["x_label"] or ""))
        ax.set_ylabel(plain_tex(about[n]["y_label"] or ""))
        ax.set_xscale("log" if about[n]["x_log"] else "linear")
        ax.set_yscale("log" if about[n]["y_log"] else "linear")
        ax.legend()
        figures[n] = figure
        if folder:
            figure.savefig(folder / f"{safe_filename(n)}.{file_format}", format=file_format)
    return figures
