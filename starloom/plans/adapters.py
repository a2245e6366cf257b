"""The engine's canonical tables, presented from general relational tables, so that operators can be run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHAINS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain_rows(spark: SparkSession, sf_dir: str, chains: int = CHAINS) -> DataFrame:
    """Events as chains: user_id modulo `chains` is the chain, event_id its order; the state is the value and the number k of props."""
    order = Window.partitionBy("chain_index").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("chain_index", F.pmod("user_id", F.lit(chains)).cast("long"))
    return e.select(
        F.col("chain_index").cast("int").alias("chain_pos"), "chain_index", (F.row_number().over(order) - 1).cast("long").alias("row_idx"), F.col("event_id").alias("step"),
        (F.col("event_type") != "error").alias("converged"), (-F.abs(F.col("value") - 50)).alias("log_posterior"), (-F.col("value") / 2).alias("log_likelihood"),
        F.array(F.col("value"), F.get_json_object("props", "$.k").cast("double")).alias("state"), "event_type",
    )


def history_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots: a year is an output, a customer an object; two files by the customer's parity."""
    o = table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") - 1994).alias("y"), F.col("o_custkey").alias("nodeUniqueIDBranchTip")).agg(F.sum("o_totalprice").alias("basicMass"), F.count("*").alias("nodeIndex"))
    return o.select(F.concat(F.lit("Output"), F.col("y").cast("string")).alias("output_name"), F.pmod("nodeUniqueIDBranchTip", F.lit(2)).cast("int").alias("file_ord"), F.col("nodeUniqueIDBranchTip").alias("row_in_file"), "nodeUniqueIDBranchTip", "basicMass", "nodeIndex", F.array("basicMass", F.col("nodeIndex").cast("double")).alias("spectrum"))


def order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs: slot, output_name, time, scale_factor of each year."""
    years = table(spark, sf_dir, "orders").select((F.year("o_orderdate") - 1994).alias("y")).distinct()
    return years.select((F.col("y") - 1).cast("int").alias("slot"), F.concat(F.lit("Output"), F.col("y").cast("string")).alias("output_name"), F.col("y").cast("double").alias("time"), (F.col("y") / 7).alias("scale_factor"))


def customers_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.col("c_custkey").alias("id"))


def supplier_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as nested histories: a supplier is a galaxy, a return flag a metallicity, line numbers 1 to 7 the times."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    rows = cells.groupBy("l_suppkey", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "q"))).alias("m"))
    full = rows.withColumn("row", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))))
    return full.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "row"))), lambda s: s["row"]).alias("history"))


def conversation_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ragged arrays: the turns' text lengths in order."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("n")))).alias("s"))
    return c.select("conv_id", F.col("s.n").alias("values"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as analyses of two models: line status is the model, return flag the analysis, the line number x, the mean quantity y with its spread as bounds; the overall mean is the target."""
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("y"), F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)).alias("s"))
    goal = li.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("t"))
    rows = per.join(goal, ["l_returnflag", "l_linenumber"]).groupBy("l_linestatus", "l_returnflag").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "y", "s", "t"))).alias("p"))
    field = lambda f: F.transform("p", lambda s: f(s))
    size = F.size("p")
    square = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size), lambda j: F.when(i == j, F.pow(F.element_at(F.col("p"), i)["s"], 2)).otherwise(F.lit(0.0))))
    nothing: Column = F.lit(None)
    return rows.select(
        F.col("l_linestatus").alias("model"), (F.ascii("l_linestatus") - 70).alias("model_ord"), F.col("l_returnflag").alias("name"), F.lit("function1D").alias("type"), F.concat(F.lit("quantity of flag "), F.col("l_returnflag")).alias("description"),
        F.lit("line").alias("x_label"), F.lit("quantity").alias("y_label"), F.lit(False).alias("x_log"), F.lit(False).alias("y_log"), F.lit("all").alias("target_label"), F.lit(True).alias("has_target"),
        field(lambda s: s["l_linenumber"].cast("double")).alias("x"), field(lambda s: s["y"]).alias("y"), field(lambda s: s["y"] - s["s"]).alias("y_lower"), field(lambda s: s["y"] + s["s"]).alias("y_upper"), square.alias("y_covariance"),
        field(lambda s: s["t"]).alias("y_target"), nothing.cast("array<double>").alias("target_lower"), nothing.cast("array<double>").alias("target_upper"), nothing.cast("array<array<double>>").alias("target_covariance"),
    )


#: Order keys whose line items are numbered together.
BLOCK = 1 << 16


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the rows of two files, by line status. A row's number is that within its block of order keys, after the counted rows of the blocks before, so no file is sorted by one task."""
    li = table(spark, sf_dir, "lineitem").withColumn("file_ord", (F.col("l_linestatus") == "O").cast("int")).withColumn("block", F.floor(F.col("l_orderkey") / BLOCK))
    sizes = li.groupBy("l_linestatus", "block").agg(F.count("*").alias("n"))
    # as many rows as blocks: their running sum is cheap
    earlier = Window.partitionBy("l_linestatus").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(sizes.select(F.col("l_linestatus").alias("status_"), F.col("block").alias("block_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    order = Window.partitionBy("l_linestatus", "file_ord", "block").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = li.withColumn("row_in_file", F.row_number().over(order) - 1).join(before, F.col("l_linestatus").eqNullSafe(F.col("status_")) & F.col("block").eqNullSafe(F.col("block_")))
    return rows.withColumn("row_in_file", (F.col("before") + F.col("row_in_file")).cast("long")).withColumn("output_name", F.lit("Output1")).drop("block", "status_", "block_", "before")
