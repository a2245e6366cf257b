"""Queries over the adapters' tables, one per operator, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import long_form, right_aligned, widest
from ..functions.numeric import or_null
from ..functions.text import safe_filename_column
from ..functions.units import Units, convert_units, with_units
from ..operators import analyses, convergence, history, mixing, outputs, reading, star_formation, summaries
from ..operators.collection import incomplete_files
from ..sources import chains as chain_source
from ..sources.config import MCMCConfig, ModelParameter, PriorSpec
from . import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(or_null(F.col(c) if isinstance(c, str) else c), digits)


def config() -> MCMCConfig:
    uniform = PriorSpec("uniform", {"limitLower": 0.0, "limitUpper": 100.0})
    from pathlib import Path

    return MCMCConfig(Path("run.xml"), Path("log"), "differentialEvolution", (ModelParameter("node/value", "v", uniform), ModelParameter("node/k", None, uniform)))


def chain_set(spark: SparkSession, sf_dir: str) -> chain_source.ChainSet:
    return chain_source.from_rows(config(), a.chain_rows(spark, sf_dir))


CH = f"""ch as (select cast(user_id % {a.CHAINS} as bigint) chain_index, row_number() over (partition by user_id % {a.CHAINS} order by event_id) - 1 row_idx, event_id step, event_type,
 -abs(value - 50) log_posterior, -value / 2 log_likelihood, value v0, cast(json_extract_string(props, '$.k') as double) v1 from events),
lg as (select chain_index, row_idx, 0 param_idx, v0 v from ch union all select chain_index, row_idx, 1, v1 from ch),
nm as (select min(n) n from (select count(*) n from ch group by chain_index))"""

# ---- chains


@query(f"with {CH}, c as (select chain_index, row_idx, event_type <> lag(event_type) over (partition by chain_index order by row_idx) c from ch) select chain_index, round(avg(cast(c as int)), 6) rate from c group by 1")
def acceptance_rate(spark, d):
    return mixing.acceptance_rows(a.chain_rows(spark, d), F.col("event_type")).select("chain_index", rounded("rate").alias("rate"))


@query(f"with {CH}, c as (select chain_index, row_idx, v0 <> lag(v0) over w or v1 <> lag(v1) over w c from ch window w as (partition by chain_index order by row_idx)) select chain_index, round(avg(cast(c as int)), 6) rate from c group by 1")
def acceptance_rate_of_states(spark, d):
    return mixing.acceptance_rows(a.chain_rows(spark, d)).select("chain_index", rounded("rate").alias("rate"))


@query(f"with {CH}, c as (select chain_index, row_idx, cast(event_type <> lag(event_type) over (partition by chain_index order by row_idx) as int) c from ch) select chain_index, row_idx, round(case when row_idx >= 30 then avg(c) over (partition by chain_index order by row_idx rows between 29 preceding and current row) end, 6) rate from c")
def acceptance_trace(spark, d):
    return mixing.acceptance_trace_rows(a.chain_rows(spark, d), 30, F.col("event_type")).select("chain_index", "row_idx", rounded("rate").alias("rate"))


@query(f"with {CH} select chain_index, row_idx - 100 row_idx, step, log_posterior from ch where row_idx >= 100")
def post_burn(spark, d):
    return chain_set(spark, d).post_burn(100).rows.select("chain_index", "row_idx", "step", "log_posterior")


@query(f"with {CH} select chain_index, row_idx - 50 row_idx, v0, v1 from ch where row_idx >= 50 and chain_index <> 2")
def concatenated(spark, d):
    return chain_set(spark, d).concatenated(50, drop_chains=[2]).select("chain_index", "row_idx", F.element_at("state", 1).alias("v0"), F.element_at("state", 2).alias("v1"))


@query("select event_id step, user_id % 4 chain_index, event_type <> 'error' converged, value v0, value / 2 v1 from events")
def chain_log_lines(spark, d):
    """Events written as log lines and parsed again."""
    e = a.table(spark, d, "events")
    number = lambda c: F.format_string("%s", c.cast("string"))
    line = F.concat_ws("  ", F.col("event_id").cast("string"), (F.col("user_id") % 4).cast("string"), F.lit("0.5"), F.when(F.col("event_type") != "error", ".TRUE.").otherwise("F"), F.lit("-1.0"), F.lit("-2.0"), number(F.col("value")), number(F.col("value") / 2))
    lines = e.select(F.lit("log_0000.log").alias("path"), F.lit(0).alias("block"), F.col("event_id").alias("line"), F.concat(F.lit("  "), line).alias("value"))
    return chain_source.parse(lines, 2, 2).select("step", "chain_index", "converged", F.element_at("state", 1).alias("v0"), F.element_at("state", 2).alias("v1"))


RH = f"""{CH}, gr as (select k, nm.n * k // 10 s from nm, range(1, 11) t(k)),
mo as (select k, s, param_idx, chain_index, avg(v) x, var_samp(v) s2 from gr join lg on row_idx < s group by all),
g as (select k, s, param_idx, count(*) m, var_samp(x) vx, avg(x) gx, avg(s2) w, var_samp(s2) vs, covar_samp(s2, x * x) c2, covar_samp(s2, x) c1 from mo group by all),
v as (select *, (s - 1.0) / s * w + (m + 1.0) / m * vx v, s * vx b from g),
e as (select *, power((s - 1.0) / s, 2) / m * vs + power((m + 1.0) / (m * s), 2) * 2 * b * b / (m - 1) + 2.0 * (m + 1) * (s - 1) / (m * m * s * 1.0 * s) * (s * 1.0 / m) * (c2 - 2 * gx * c1) vv from v),
r as (select k - 1 grid, s step, param_idx, ((case when vv > 0 then 2 * v * v / vv else 0 end) + 3) / ((case when vv > 0 then 2 * v * v / vv else 0 end) + 1) * sqrt((m + 1.0) / m * v / w - (s - 1.0) / (s * 1.0 * m)) rhat from e)"""


def _steps(c: chain_source.ChainSet) -> list[int]:
    return [c.shortest * k // 10 for k in range(1, 11)]


@query(f"with {RH} select cast(grid as bigint) grid, cast(step as bigint) step, cast(param_idx as bigint) param_idx, round(rhat, 6) rhat from r")
def gelman_rubin(spark, d):
    c = chain_set(spark, d)
    rows = c.rows.where(F.col("row_idx") < c.shortest)
    return convergence.corrected_rhat(convergence.prefix_moments(rows, _steps(c))).select(F.col("grid").cast("long").alias("grid"), "step", F.col("param_idx").cast("long").alias("param_idx"), rounded("rhat").alias("rhat"))


@query(f"""with {RH}, p as (select k, s, param_idx, quantile_cont(v, 0.925) - quantile_cont(v, 0.075) q from gr join lg on row_idx < s group by all),
o as (select k, param_idx, avg(q) q from (select k, param_idx, chain_index, quantile_cont(v, 0.925) - quantile_cont(v, 0.075) q from gr join lg on row_idx < s group by all) group by all)
select cast(k - 1 as bigint) grid, cast(s as bigint) step, cast(param_idx as bigint) param_idx, round(p.q / o.q, 6) r_interval from p join o using (k, param_idx)""")
def r_interval(spark, d):
    c = chain_set(spark, d)
    return convergence.interval_ratio(c.rows.where(F.col("row_idx") < c.shortest), _steps(c)).select(F.col("grid").cast("long").alias("grid"), "step", F.col("param_idx").cast("long").alias("param_idx"), rounded("r_interval").alias("r_interval"))


@query(f"with {RH} select cast(grid as bigint) grid, cast(step as bigint) step, round(max(rhat), 6) rhat_max from r group by all")
def rhat_max(spark, d):
    c = chain_set(spark, d)
    result = convergence.gelman_rubin(c, step_grid=_steps(c))
    return result.maxima().select(F.col("grid").cast("long").alias("grid"), "step", rounded("rhat_max").alias("rhat_max"))


@query(f"with {RH}, x as (select grid, max(rhat) <= 1.1 ok from r group by grid), y as (select grid, min(ok) over w ok, count(*) over w n from x window w as (order by grid rows between current row and 1 following)) select cast(min(grid) filter (ok and n = 2) as bigint) first_grid from y")
def convergence_step(spark, d):
    c = chain_set(spark, d)
    rows = c.rows.where(F.col("row_idx") < c.shortest)
    maxima = convergence.corrected_rhat(convergence.prefix_moments(rows, _steps(c))).groupBy("grid").agg(F.max("rhat").alias("rhat_max"))
    return convergence.first_sustained(maxima, 1.1, 2).select(F.col("first_grid").cast("long").alias("first_grid"))


@query(f"""with {CH}, n as (select chain_index, count(*) n from ch group by 1), x as (select chain_index, param_idx, n, floor(n * 0.1) n1, floor(n * 0.5) n2, row_idx, v from lg join n using (chain_index)),
y as (select chain_index, param_idx, n1, n2, avg(v) filter (row_idx < n1) a1, avg(v) filter (row_idx >= n - n2) a2, var_samp(v) filter (row_idx < n1) v1, var_samp(v) filter (row_idx >= n - n2) v2 from x group by all)
select chain_index, cast(param_idx as bigint) param_idx, round((a1 - a2) / sqrt(v1 / n1 + v2 / n2), 6) z from y""")
def geweke(spark, d):
    return convergence.geweke_rows(a.chain_rows(spark, d)).select("chain_index", F.col("param_idx").cast("long").alias("param_idx"), rounded("z").alias("z"))


@query(f"with {CH} select chain_index, arg_max(v0, row_idx) v0, arg_max(v1, row_idx) v1 from ch group by 1")
def last_states(spark, d):
    return convergence.last_states(a.chain_rows(spark, d)).select("chain_index", F.element_at("state", 1).alias("v0"), F.element_at("state", 2).alias("v1"))


ACF = f"""{CH}, l as (select chain_index, param_idx, row_idx, v, avg(v) over (partition by chain_index, param_idx) m from lg, nm where row_idx < nm.n),
d as (select chain_index, param_idx, row_idx, v - m d from l),
s as (select x.chain_index, x.param_idx, lag, sum(x.d * y.d) s from d x, range(0, 21) t(lag) join d y on y.chain_index = x.chain_index and y.param_idx = x.param_idx and y.row_idx = x.row_idx + lag group by all)"""


@query(f"with {CH}, l as (select chain_index, param_idx, row_idx, v - avg(v) over (partition by chain_index, param_idx) d from lg, nm where row_idx < nm.n), s as (select x.chain_index, x.param_idx, y.row_idx - x.row_idx lag, sum(x.d * y.d) s from l x join l y on x.chain_index = y.chain_index and x.param_idx = y.param_idx and y.row_idx between x.row_idx and x.row_idx + 20 group by all) select chain_index, cast(param_idx as bigint) param_idx, cast(lag as bigint) lag, round(s / max(case when lag = 0 then s end) over (partition by chain_index, param_idx), 6) acf from s")
def acf(spark, d):
    rows = mixing.autocorrelation_function(chain_set(spark, d), max_lag=20)
    return rows.select(F.col("chain_pos").cast("long").alias("chain_index"), F.col("param_idx").cast("long").alias("param_idx"), F.col("lag").cast("long").alias("lag"), rounded("acf").alias("acf"))


@query(SQL["acf"])
def acf_join(spark, d):
    values, _ = mixing._series(chain_set(spark, d), 0)
    return mixing.acf_by_join(values, 20).select(F.col("chain_pos").cast("long").alias("chain_index"), F.col("param_idx").cast("long").alias("param_idx"), F.col("lag").cast("long").alias("lag"), rounded("acf").alias("acf"))


TAU = f"""with {CH}, l as (select chain_index, param_idx, row_idx, v - avg(v) over (partition by chain_index, param_idx) d from lg, nm where row_idx < nm.n),
s as (select x.param_idx, y.row_idx - x.row_idx lag, sum(x.d * y.d) s from l x join l y on x.chain_index = y.chain_index and x.param_idx = y.param_idx and y.row_idx between x.row_idx and x.row_idx + 200 group by all),
t as (select param_idx, lag, 2 * sum(s / z) over (partition by param_idx order by lag) - 1 tau from (select *, max(case when lag = 0 then s end) over (partition by param_idx) z from s)),
w as (select param_idx, coalesce(min(lag) filter (lag >= 5 * tau), max(lag)) lag from t group by 1), p as (select param_idx, tau from t join w using (param_idx, lag))"""


@query(f"{TAU} select cast(param_idx as bigint) param_idx, round(tau, 5) tau from p")
def autocorr_time(spark, d):
    """All lags. The SQL has lags to 200 and equals it where the window closes by then, as on the test tables."""
    values = mixing.autocorrelation_time(chain_set(spark, d), post_burn=0)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "param_idx long, x double").select("param_idx", rounded("x", 5).alias("tau"))


@query(f"{TAU} select cast(param_idx as bigint) param_idx, round((select n from nm) * {a.CHAINS} / tau, 2) ess from p")
def ess(spark, d):
    c = chain_set(spark, d)
    values = mixing.effective_sample_size(c, post_burn=0)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "param_idx long, x double").select("param_idx", rounded("x", 2).alias("ess"))


@query(f"with {CH} select chain_index, step, log_posterior, log_likelihood, v0, v1 from ch order by log_posterior desc, chain_index, row_idx limit 1")
def maximum_posterior(spark, d):
    return summaries.best_row(a.chain_rows(spark, d), "log_posterior").select("chain_index", "step", "log_posterior", "log_likelihood", F.element_at("state", 1).alias("v0"), F.element_at("state", 2).alias("v1"))


@query(f"with {CH} select chain_index, step, log_posterior, log_likelihood, v0, v1 from ch order by log_likelihood desc, chain_index, row_idx limit 1")
def maximum_likelihood(spark, d):
    return summaries.best_row(a.chain_rows(spark, d), "log_likelihood").select("chain_index", "step", "log_posterior", "log_likelihood", F.element_at("state", 1).alias("v0"), F.element_at("state", 2).alias("v1"))


@query(f"with {CH}, p as (select row_number() over (order by chain_index, row_idx) - 1 pool_row, step, v0 from ch), w as (select generate_subscripts([0, 7, 7, 3, 100], 1) - 1 draw_pos, unnest([0, 7, 7, 3, 100]) pool_row) select draw_pos, pool_row, step, v0 from w join p using (pool_row)")
def posterior_rows(spark, d):
    """The draw's join with given numbers; posterior_samples draws them."""
    pool, _ = summaries.pooled(chain_set(spark, d), 0, ())
    return summaries.drawn(pool, [0, 7, 7, 3, 100]).select("draw_pos", "pool_row", "step", F.element_at("state", 1).alias("v0"))


@query(f"with {CH} select 0::bigint param_idx, round(avg(v0), 6) mean from ch union all select 1, round(avg(v1), 6) from ch")
def mvn_mean(spark, d):
    fit = summaries.multivariate_normal_fit(chain_set(spark, d), post_burn=0)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(fit.mean)], "param_idx long, x double").select("param_idx", rounded("x").alias("mean"))


@query(f"with {CH}, c as (select var_samp(v0) a, covar_samp(v0, v1) b, var_samp(v1) c from ch) select 0::bigint i, 0::bigint j, round(a, 5) cov from c union all select 0, 1, round(b, 5) from c union all select 1, 0, round(b, 5) from c union all select 1, 1, round(c, 5) from c")
def mvn_covariance(spark, d):
    fit = summaries.multivariate_normal_fit(chain_set(spark, d), post_burn=0)
    return spark.createDataFrame([(i, j, float(fit.covariance[i, j])) for i in range(2) for j in range(2)], "i long, j long, x double").select("i", "j", rounded("x", 5).alias("cov"))


@query(f"with {CH}, c as (select var_samp(v0) a, covar_samp(v0, v1) b, var_samp(v1) c from ch), l as (select sqrt(a) x, b / sqrt(a) y, c - b * b / a z from c) select 0::bigint i, 0::bigint j, round(x, 5) l from l union all select 0, 1, 0.0 from l union all select 1, 0, round(y, 5) from l union all select 1, 1, round(sqrt(z), 5) from l")
def mvn_cholesky(spark, d):
    fit = summaries.multivariate_normal_fit(chain_set(spark, d), post_burn=0)
    return spark.createDataFrame([(i, j, float(fit.cholesky[i, j])) for i in range(2) for j in range(2)], "i long, j long, x double").select("i", "j", rounded("x", 5).alias("l"))


@query(f"with {CH}, c as (select var_samp(v0) * 12 / 1e4 a, covar_samp(v0, v1) * 12 / 1e4 b, var_samp(v1) * 12 / 1e4 c from ch), e as (select (a + c) / 2 m, sqrt(power((a - c) / 2, 2) + b * b) r from c) select 0::bigint k, round(m - r, 6) eigenvalue from e union all select 1, round(m + r, 6) from e")
def projection_pursuit(spark, d):
    """Two parameters, so the eigenvalues have a closed form."""
    r = summaries.projection_pursuit(chain_set(spark, d), post_burn=0)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(r.eigenvalues)], "k long, x double").select("k", rounded("x").alias("eigenvalue"))


@query(f"with {CH} select cast(floor(v0 / 10) as bigint) bin, count(*) n from ch where v0 >= 0 and v0 < 100 group by 1")
def corner_histogram(spark, d):
    data = summaries.corner_data(chain_set(spark, d), ["node/value"], 0)
    return summaries.histogram(data, "node/value", 0.0, 100.0, 10).select(F.col("bin").cast("long").alias("bin"), "n")


# ---- reading

PN = """pn as (select *, case when l_linestatus = 'O' then 1 else 0 end file_ord, row_number() over (partition by l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 row_in_file from lineitem),
gn as (select *, row_number() over (order by file_ord, row_in_file) - 1 global_row from pn)"""


@query(f"with {PN} select file_ord::bigint file_ord, row_in_file, l_quantity mass, l_extendedprice from pn")
def read_project(spark, d):
    rows = reading.read(a.part_nodes(spark, d), {"mass": "nodeData/l_quantity", "l_extendedprice": "l_extendedprice"})
    return rows.select(F.col("file_ord").cast("long").alias("file_ord"), "row_in_file", "mass", "l_extendedprice")


@query(f"with {PN} select file_ord::bigint file_ord, row_in_file, l_quantity mass from pn where l_discount > 0.05 and l_quantity < 24")
def read_where(spark, d):
    rows = reading.read(a.part_nodes(spark, d), {"mass": "nodeData/l_quantity"}, "l_discount > 0.05 and l_quantity < 24")
    return rows.select(F.col("file_ord").cast("long").alias("file_ord"), "row_in_file", "mass")


@query(f"with {PN} select global_row, l_quantity from gn where global_row >= (select count(*) // 2 from gn)")
def read_mask(spark, d):
    """A positional mask, as long as all files together."""
    nodes = a.part_nodes(spark, d)
    n = nodes.count()
    rows = reading.mask(nodes, np.arange(n) >= n // 2)
    return rows.select("global_row", "l_quantity")


@query(f"with {PN}, n as (select count(*) n from gn), w as (select generate_subscripts([5, 0, 5, -1], 1) - 1 position, unnest([5, 0, 5, -1]) i) select position, l_orderkey, l_quantity from w, n join gn on global_row = case when i < 0 then i + n else i end")
def read_take(spark, d):
    return reading.take(a.part_nodes(spark, d), [5, 0, 5, -1]).select("position", "l_orderkey", "l_quantity")


@query(f"with {PN} select global_row, file_ord::bigint file_ord, l_orderkey from gn")
def multi_file_concat(spark, d):
    return reading.numbered(a.part_nodes(spark, d)).select("global_row", F.col("file_ord").cast("long").alias("file_ord"), "l_orderkey")


@query("with y as (select distinct year(o_orderdate) - 1994 y from orders) select row_number() over (order by y) as index, 'Output' || y as name, '/Outputs/Output' || y path, cast(y as double) as time, round(y / 7.0, 6) scale_factor, round(7.0 / y - 1, 6) redshift from y")
def outputs_index(spark, d):
    groups = a.order_years(spark, d).select(F.col("output_name").alias("name"), "time", "scale_factor", F.lit("snapshot").alias("output_type"))
    return outputs.index_outputs(groups).select(F.col("index").cast("long").alias("index"), "name", "path", "time", rounded("scale_factor").alias("scale_factor"), rounded("redshift").alias("redshift"))


@query("with g as (select l_linestatus s, count(*) n from lineitem group by 1) select 'basicMass' as name, sum(n)::bigint as rows from g union all select 'nodeIndex', sum(n)::bigint from g")
def properties_table(spark, d):
    """The shape of a property: its rows over all files."""
    nodes = a.part_nodes(spark, d).select("file_ord", F.col("l_quantity").alias("basicMass"), F.col("l_linenumber").alias("nodeIndex"))
    names = [f.name for f in nodes.schema.fields if f.name != "file_ord"]
    per = nodes.groupBy("file_ord").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"))
    return per.select(F.explode(F.array(*[F.lit(n) for n in sorted(names)])).alias("name"), "rows")


@query("select s_suppkey path, s_acctbal < -500 unknown from supplier where not coalesce(s_acctbal > 0, false)")
def completion_check(spark, d):
    status = F.when(F.col("s_acctbal") > 0, F.lit(0)).when(F.col("s_acctbal") < -500, F.lit(None)).otherwise(1)
    return incomplete_files(a.table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), status.cast("long").alias("status_completion"))).select("path", F.col("status_completion").isNull().alias("unknown"))


@query("select s_suppkey, round(s_acctbal * 1.98892e30 / 1e30, 1) mass from supplier")
def units_convert(spark, d):
    df = a.table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal")).alias("mass"))
    return convert_units(with_units(df, "mass", Units(1.98892e30, "solar masses", "solMass")), "mass", "kg").select("s_suppkey", F.round(F.col("mass") / 1e30, 1).alias("mass"))


@query(r"""select p_partkey, case when x = '' then '_' else x end safe from (select p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || ':' || p_brand || '/' || p_type || '. ', '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), '[ .]+$', '') x from part)""")
def safe_filenames(spark, d):
    return a.table(spark, d, "part").select("p_partkey", safe_filename_column(F.concat("p_name", F.lit(":"), "p_brand", F.lit("/"), "p_type", F.lit(". "))).alias("safe"))


# ---- histories

HN = """hn as (select year(o_orderdate) - 1994 y, o_custkey id, sum(o_totalprice) mass, count(*) n from orders group by all),
ys as (select distinct y from hn), sl as (select c_custkey id, y from customer, ys), tr as (select sl.id, sl.y, hn.id is not null present, mass, n from sl left join hn using (id, y))"""


def _traced(spark, d, properties, **options):
    return history.trace(a.history_nodes(spark, d), a.order_years(spark, d), a.customers_asked(spark, d), properties, "nodeUniqueIDBranchTip", **options)


@query(f"with {HN} select id, cast(y - 1 as bigint) slot, case when present then cast(y as double) end as time, round(case when present then y / 7.0 end, 6) expansion_factor, round(mass, 2) mass from tr")
def trace_history(spark, d):
    return _traced(spark, d, {"mass": "nodeData/basicMass"}).select("id", F.col("slot").cast("long").alias("slot"), or_null(F.col("time")).alias("time"), rounded("expansion_factor").alias("expansion_factor"), rounded("mass", 2).alias("mass"))


@query(f"with {HN} select id, count(*) slots, count(*) filter (present) n_present from tr group by 1")
def trace_history_present(spark, d):
    return _traced(spark, d, {"mass": "nodeData/basicMass"}).groupBy("id").agg(F.count("*").alias("slots"), F.sum(F.col("present").cast("long")).alias("n_present"))


@query(f"with {HN} select id, cast(y - 1 as bigint) slot, coalesce(n, -1) n from tr")
def trace_int_sentinel(spark, d):
    return _traced(spark, d, {"n": "nodeData/nodeIndex"}).select("id", F.col("slot").cast("long").alias("slot"), "n")


@query(f"with {HN} select id, cast(y - 1 as bigint) slot, cast(b as bigint) band, round(case b when 0 then mass else n end, 2) v from tr, range(0, 2) t(b)")
def trace_array_property(spark, d):
    rows = _traced(spark, d, {"spectrum": "nodeData/spectrum"}, widths={"spectrum": 2})
    return long_form(rows, ["id", "slot"], "spectrum", "band", "v").select("id", F.col("slot").cast("long").alias("slot"), F.col("band").cast("long").alias("band"), rounded("v", 2).alias("v"))


@query(f"with {HN}, p as (select id, list(round(mass, 2) order by y) m, list(round(case when present then 7.0 / y - 1 end, 6) order by y) z from tr group by id) select id, cast(i - 1 as bigint) slot, m[i] mass, z[i] redshift from (select *, unnest(range(1, len(m) + 1)) i from p)")
def trace_pivot(spark, d):
    rows = history.pivoted(_traced(spark, d, {"mass": "nodeData/basicMass"}), ["mass"])
    return rows.select("id", F.posexplode(F.arrays_zip("mass", "redshift")).alias("slot", "s")).select("id", F.col("slot").cast("long").alias("slot"), rounded("s.mass", 2).alias("mass"), rounded("s.redshift").alias("redshift"))


@query("""with e as (select *, row_number() over (order by event_id) r, user_id % 3 f from events), h as (select user_id id, event_type o, arg_min(value, (f, event_id)) v, count(*) copies from e group by all),
u as (select distinct user_id id from events), t as (select distinct event_type o from events) select id, o as output_name, h.id is not null present, v from u cross join t left join h using (id, o)""")
def trace_duplicates_first(spark, d):
    """Many rows for an id in one output: the lowest row of the first file counts."""
    e = a.table(spark, d, "events")
    nodes = e.select(F.col("event_type").alias("output_name"), F.pmod("user_id", F.lit(3)).cast("int").alias("file_ord"), F.col("event_id").alias("row_in_file"), "user_id", "value")
    types = e.select(F.col("event_type").alias("output_name")).distinct().select(F.hash("output_name").alias("slot"), "output_name", F.lit(1.0).alias("time"), F.lit(1.0).alias("scale_factor"))
    asked = e.select(F.col("user_id").alias("position"), F.col("user_id").alias("id")).distinct()
    return history.trace(nodes, types, asked, {"v": "nodeData/value"}, "user_id").select("id", "output_name", "present", or_null(F.col("v")).alias("v"))


@query("select event_type as output_name, user_id id, event_id row_in_file, count(*) over (partition by event_type, user_id) copies from events qualify row_number() over (partition by event_type, user_id order by event_id) = 1")
def duplicate_ids(spark, d):
    nodes = a.table(spark, d, "events").select(F.col("event_type").alias("output_name"), F.lit(0).alias("file_ord"), F.col("event_id").alias("row_in_file"), F.col("user_id").alias("id"))
    return history.first_matches(nodes, "id").select("output_name", "id", "row_in_file", "copies")


# ---- nested arrays

SH = "c as (select l_suppkey, l_linenumber, sum(l_quantity) q from lineitem group by all), s as (select distinct l_suppkey from lineitem), f as (select l_suppkey, i, coalesce(q, 0.0) q from s cross join range(1, 8) t(i) left join c on c.l_suppkey = s.l_suppkey and l_linenumber = i)"


@query("with c as (select l_suppkey, l_linenumber, sum(l_quantity) q from lineitem group by all), f as (select distinct l.l_suppkey k, i from lineitem l, range(1, 8) t(i)) select k l_suppkey, cast(i - 1 as bigint) i, coalesce(q, 0) as value from f left join c on l_suppkey = k and l_linenumber = i")
def sfh_collapse(spark, d):
    rows = star_formation.collapse(a.supplier_histories(spark, d), "history", times=[float(i) for i in range(7)])
    return long_form(rows, ["l_suppkey"], "history").select("l_suppkey", F.col("i").cast("long").alias("i"), "value")


CL = "c as (select conv_id, list(coalesce(length(text), 0) order by turn) v from conversations group by 1), w as (select max(len(v)) w from c)"


@query(f"with {CL} select conv_id, cast(i as bigint) i, cast(case when i - (w - len(v)) >= 0 then v[i - (w - len(v)) + 1] else 0 end as double) as value from c, w, range(0, 1000) t(i) where i < w")
def sfh_right_align(spark, d):
    return long_form(right_aligned(a.conversation_lengths(spark, d), "values", 0.0), ["conv_id"], "values").select("conv_id", F.col("i").cast("long").alias("i"), "value")


@query(f"with {CL} select conv_id, cast(i as bigint) i, cast(case when i - (w - len(v)) >= 0 then v[i - (w - len(v)) + 1] end as double) as value from c, w, range(0, 1000) t(i) where i < w")
def sfh_times(spark, d):
    rows = star_formation.times(a.conversation_lengths(spark, d), "values", None, True)
    return long_form(rows, ["conv_id"], "values").select("conv_id", F.col("i").cast("long").alias("i"), or_null(F.col("value")).alias("value"))


@query("select conv_id, cast(turn_no as bigint) i, cast(2 * n as double) as value from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 turn_no, coalesce(length(text), 0) n from conversations)")
def sfh_ragged(spark, d):
    twice = a.conversation_lengths(spark, d).select("conv_id", F.array("values", "values").alias("history"))
    return long_form(star_formation.collapse(twice, "history"), ["conv_id"], "history").select("conv_id", F.col("i").cast("long").alias("i"), "value")


@query(f"with {CL} select max(len(v))::bigint width from c")
def sfh_width(spark, d):
    return spark.createDataFrame([(widest(a.conversation_lengths(spark, d), "values"),)], "width long")


# ---- analyses

MO = "m as (select l_linestatus model, l_returnflag as name, l_linenumber x, avg(l_quantity) y, coalesce(stddev_samp(l_quantity), 0) s from lineitem group by all), g as (select l_returnflag as name, l_linenumber x, avg(l_quantity) t from lineitem group by all)"


@query("select distinct l_returnflag as name, 'quantity of flag ' || l_returnflag description, 'line' xAxisLabel, 'quantity' yAxisLabel, false xAxisIsLog, false yAxisIsLog, true hasTarget from lineitem where l_linestatus = 'F'")
def list_analyses(spark, d):
    return analyses.listing(a.models(spark, d).where("model = 'F'"))


@query("select l_returnflag as name, 'quantity of flag ' || l_returnflag description, string_agg(distinct l_linestatus, ', ' order by l_linestatus) models from lineitem group by 1")
def models_union(spark, d):
    return analyses.listing_of_models(a.models(spark, d)).select("name", "description", "models")


@query(f"with {MO} select model, name, x::double x, round(s, 5) err_lower, round(s, 5) err_upper from m")
def analysis_errors(spark, d):
    return analyses.points(analyses.curves(a.models(spark, d))).select("model", "name", "x", rounded("y_err_lower", 5).alias("err_lower"), rounded("y_err_upper", 5).alias("err_upper"))


@query(f"with {MO} select model, name, x::double x, round(s, 5) err from m")
def analysis_cov_errors(spark, d):
    rows = a.models(spark, d).withColumn("y_upper", F.lit(None).cast("array<double>"))
    return analyses.points(analyses.curves(rows)).select("model", "name", "x", rounded("y_err_lower", 5).alias("err"))


@query(f"with {MO} select model, name, x::double x, round(y, 6) y, round(case when model = (select min(model) from m z where z.name = m.name) then t end, 6) y_target from m join g using (name, x)")
def plot_data(spark, d):
    return analyses.plot_data(a.models(spark, d)).select("model", "name", "x", rounded("y").alias("y"), rounded("y_target").alias("y_target"))
