"""Studies: subjects with an outcome, samples in time, observations of variables, and a tree over the variables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Study:
    """A bundle of lazy tables.

    subjects(subject_id, y, ...), samples(subject_id, time), observations(subject_id, time, variable, value) with a
    row for every sample and variable, variables(variable, weight), edges(node, parent, dist) or None, and the
    closed bounds of time. Subjects without samples are in subjects only.
    """

    subjects: DataFrame
    samples: DataFrame
    observations: DataFrame
    variables: DataFrame
    edges: DataFrame | None
    start: float
    end: float

    def with_(self, **changes) -> Study:
        return replace(self, **changes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(long: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """One row for every key and variable of (keys, variable, value) rows: the rounded sum, 0 where there is none.

    A pivot and its inverse: one aggregation, and no join of samples with variables.
    """
    sums = [F.round(F.coalesce(F.sum(F.when(F.col("variable") == v, F.col("value"))), F.lit(0.0)), 6).alias(v) for v in variables]
    return long.groupBy(*keys).agg(*sums).unpivot(keys, variables, "variable", "value")


def observe(long: DataFrame, variables: list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples, observations) of (subject_id, time, variable, value) rows."""
    obs = dense(long, ["subject_id", "time"], variables)
    return long.select("subject_id", "time").distinct(), obs


def names_of(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """The sorted distinct values of a column that names variables: few by nature, and checked."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} variables in {column}")
    return sorted(found)


def _customers(spark: SparkSession, sf_dir: str, outcome: str = "BUILDING") -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("subject_id"), (F.col("c_mktsegment") == outcome).alias("y"), "c_nationkey", "c_acctbal")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, time, variable, value) of events: time is the whole day since 2024-01-01."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), day.alias("time"), F.col("event_type").alias("variable"), "value")


EVENT_TREE = (("engage", "root", 1.0), ("convert", "root", 1.0), ("error", "root", 1.0), ("click", "engage", 1.0), ("view", "engage", 1.0), ("purchase", "convert", 1.0), ("signup", "convert", 1.0))


def events_study(spark: SparkSession, sf_dir: str) -> Study:
    """Events per user and day; the outcome is a market segment."""
    rows = event_rows(spark, sf_dir)
    subjects = _customers(spark, sf_dir).join(rows.select("subject_id").distinct(), "subject_id", "left_semi")
    variables = names_of(table(spark, sf_dir, "events"), "event_type")
    samples, obs = observe(rows, variables)
    weights = spark.createDataFrame([(v, 1.0) for v in variables], "variable string, weight double")
    edges = spark.createDataFrame(EVENT_TREE, "node string, parent string, dist double")
    return Study(subjects, samples, obs, weights, edges, 0.0, 30.0)


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, time, variable, value) of orders: quantities by the nation of the supplier."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"), day.alias("time"))
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("variable"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("value"))
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("subject_id", "time", "variable", "value")


def nation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(node, parent, dist): nations below regions below world."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    leaves = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"))
    return leaves.union(region.select(F.col("r_name"), F.lit("world"))).withColumn("dist", F.lit(1.0))


def orders_study(spark: SparkSession, sf_dir: str) -> Study:
    """Orders per customer and day; variables are supplier nations below regions."""
    rows = order_rows(spark, sf_dir)
    variables = names_of(rows.sparkSession.read.parquet(f"{sf_dir}/nation.parquet"), "n_name")
    samples, obs = observe(rows, variables)
    subjects = _customers(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id")).distinct(), "subject_id", "left_semi")
    weights = spark.createDataFrame([(v, 1.0) for v in variables], "variable string, weight double")
    return Study(subjects, samples, obs, weights, nation_tree(spark, sf_dir), 0.0, 2404.0)


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for exact comparison; minus zero becomes zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0))
