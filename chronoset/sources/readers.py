"""Readers for abundance tables, sample metadata, subjects, sequences, placements and trees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JPLACE = "tree string, fields array<string>, placements array<struct<p: array<array<double>>, nm: array<array<string>>>>"


def abundances(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, variable, value) of a CSV with samples as rows; the header names the variables."""
    wide = spark.read.csv(path, header=True, quote='"')
    first, *names = wide.columns
    wide = wide.select(F.trim(F.col(f"`{first}`").cast("string")).alias("sample_id"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return wide.unpivot(["sample_id"], names, "variable", "value")


def clade_table(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, variable, value) of a TSV with clade paths as rows and samples as columns; percent become shares."""
    wide = spark.read.csv(path, header=True, sep="\t")
    first, *samples = wide.columns
    wide = wide.select(F.col(f"`{first}`").alias("variable"), *[F.col(f"`{s}`").cast("double").alias(s) for s in samples])
    return wide.unpivot(["variable"], samples, "sample_id", "value").select("sample_id", "variable", (F.col("value") * 0.01).alias("value"))


def clade_edges(clades: DataFrame, root: str = "k__Bacteria") -> DataFrame:
    """edges(node, parent, dist) of pipe-separated clade paths (variable) below ``root``, each of length 1."""
    parts = F.split("variable", r"\|")
    inner = clades.select("variable").distinct().where((F.col("variable") != root) & F.col("variable").startswith(root + "|"))
    return inner.select(F.col("variable").alias("node"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "|").alias("parent"), F.lit(1.0).alias("dist"))


def clade_weights(edges: DataFrame, paths: DataFrame, scale: float = 1.0) -> DataFrame:
    """(variable, weight): scale times one more than the number of nodes below."""
    return paths.groupBy(F.col("ancestor").alias("variable")).agg((F.lit(scale) * F.count(F.lit(1))).alias("weight"))


def sample_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, subject_id, time, subject_ord, sample_ord) of a CSV without header.

    Quotes around sample ids go. Subject ids sort as numbers if all of them are numbers; samples by time, then id.
    """
    rows = spark.read.schema("sample_id string, subject_id string, time double").csv(path)
    rows = rows.withColumn("sample_id", F.trim(F.regexp_replace("sample_id", '^"|"$', "")))
    number = F.expr("try_cast(subject_id as bigint)")
    numeric = rows.select(F.bool_and(number.isNotNull()).alias("numeric"))
    ids = rows.select("subject_id").distinct().crossJoin(F.broadcast(numeric))
    order = Window.orderBy(F.when(F.col("numeric"), number), "subject_id")
    ids = ids.select("subject_id", F.row_number().over(order).alias("subject_ord"))
    by = Window.partitionBy("subject_id").orderBy("time", "sample_id")
    return rows.withColumn("sample_ord", F.row_number().over(by)).join(ids, "subject_id").select("sample_id", "subject_id", "time", "subject_ord", "sample_ord")


def subjects(spark: SparkSession, path: str) -> DataFrame:
    """The subject table; its first column becomes subject_id (text), the others are inferred."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    first, *rest = rows.columns
    return rows.select(F.col(f"`{first}`").cast("string").alias("subject_id"), *[F.col(f"`{c}`") for c in rest])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, name) of records with one sequence line; the last name of a repeated sequence wins."""
    records = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    rows = records.select(F.trim(lines[0]).alias("name"), F.trim(lines[1]).alias("sequence"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("sequence").agg(F.max_by("name", "at").alias("name"))


def renamed(abundance: DataFrame, names: DataFrame) -> DataFrame:
    """Variables that are sequences get their names."""
    return abundance.join(names, F.col("variable") == F.col("sequence"), "left").select("sample_id", F.coalesce("name", "variable").alias("variable"), "value")


def jplace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", JPLACE).alias("j")).select("j.*")


def placements(document: DataFrame) -> DataFrame:
    """(sequence, edge, lwr, distal, pendant): a row for every name of every placement; edges are text."""
    field = lambda n: F.element_at("p", F.array_position("fields", n).cast("int"))
    rows = document.select("fields", F.explode("placements").alias("x")).select("fields", "x.nm", F.explode("x.p").alias("p"))
    rows = rows.select("fields", "p", F.explode("nm").alias("nm"))
    return rows.select(F.col("nm")[0].alias("sequence"), field("edge_num").cast("long").cast("string").alias("edge"), field("like_weight_ratio").alias("lwr"), field("distal_length").alias("distal"), field("pendant_length").alias("pendant"))


def newick_edges(text: str, numbered: bool = True) -> list[tuple[str, str, float, str, bool]]:
    """(node, parent, dist, label, is_leaf) of a Newick text. With edge numbers in braces those name the nodes."""
    text = text.strip().rstrip(";")
    rows: dict[str, list] = {}
    children: list[list[str]] = [[]]
    at, made = 0, 0
    while at < len(text):
        c = text[at]
        if c == "(":
            children.append([])
            at += 1
            continue
        if c == ",":
            at += 1
            continue
        below: list[str] = []
        if c == ")":
            below = children.pop()
            at += 1
        end = at
        while end < len(text) and text[end] not in ",()":
            if text[end] in "'\"":
                end = text.index(text[end], end + 1)
            end += 1
        piece, at = text[at:end], end
        number = ""
        if "{" in piece:
            piece, _, number = piece.partition("{")
            number, _, rest = number.partition("}")
            piece += rest
        label, _, dist = piece.rpartition(":") if ":" in piece else (piece, "", "")
        label = label.strip("'\"")
        node = number if numbered and number else label or f"node{made}"
        made += 1
        for child in below:
            rows[child][1] = node
        rows[node] = [node, "", float(dist) if dist else 0.0, label, not below]
        children[-1].append(node)
    return [tuple(r) for r in rows.values()]


def tree_edges(document: DataFrame) -> DataFrame:
    """(node, parent, dist, label, is_leaf) of jplace documents; the root's parent is empty. One text is one tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for t in pdf["tree"] for r in newick_edges(t)]
            yield pd.DataFrame(rows, columns=["node", "parent", "dist", "label", "is_leaf"])

    return document.select("tree").mapInPandas(run, "node string, parent string, dist double, label string, is_leaf boolean")


def traces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(chain, iteration, parameter, value) of trace CSVs; the file is the chain, the first column is the iteration."""
    rows = spark.read.csv(paths, header=True, inferSchema=True).withColumn("chain", F.input_file_name())
    first, *names = [c for c in rows.columns if c != "chain"]
    rows = rows.select("chain", F.col(f"`{first}`").cast("long").alias("iteration"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return rows.unpivot(["chain", "iteration"], names, "parameter", "value")


def equals(frame: DataFrame, column: str, literal) -> Column:
    """Whether a column equals a setting: as whole numbers if the setting is one (booleans are 1 and 0), else as text.

    For a boolean column ``true`` and ``false``, in any case, are taken for 1 and 0 too.
    """
    kind, text = frame.schema[column].dataType.typeName(), str(literal).strip()
    if kind == "boolean" and text.lower() in ("true", "false"):
        text = str(int(text.lower() == "true"))
    try:
        number = int(text)
    except ValueError:
        return F.coalesce(F.col(column).cast("string") == text, F.lit(False))
    value = F.col(column).cast("int") if kind == "boolean" else F.col(column).try_cast("double")
    return F.coalesce(value == F.lit(number), F.lit(False))


def placement_table(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """(variable, ranks...) of a CSV of taxonomic placements; its first column names variables, or sequences that
    ``names`` (sequence, name) renames."""
    rows = spark.read.csv(path, header=True)
    first, *ranks = rows.columns
    rows = rows.select(F.col(f"`{first}`").alias("variable"), *[F.col(f"`{r}`") for r in ranks])
    if names is None:
        return rows
    known = names.select(F.col("sequence").alias("__sequence"), F.col("name").alias("__name"))
    return rows.join(known, F.col("variable") == F.col("__sequence"), "left").select(F.coalesce("__name", "variable").alias("variable"), *[F.col(f"`{r}`") for r in ranks])


def variable_list(spark: SparkSession, path: str) -> DataFrame:
    """(variable) of a file with one name on a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("variable")).where(F.col("variable") != "").distinct()


def variables_of_taxon(table: DataFrame, taxon: str) -> DataFrame:
    """The rows of a placement table (variable, ranks...) that hold a taxon at any rank."""
    ranks = [F.col(f"`{c}`").cast("string") for c in table.columns if c != "variable"]
    return table.where(F.coalesce(F.array_contains(F.array(*ranks), taxon), F.lit(False))) if ranks else table.limit(0)


def combine(abundance: DataFrame, metadata: DataFrame, subject_table: DataFrame, outcome: str, positive) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, samples, observations): samples without abundances and subjects without an outcome are left out.

    A subject with samples that the subject table lacks raises KeyError. The outcome is compared by :func:`equals`.
    """
    lost = metadata.select("subject_id").distinct().join(subject_table, "subject_id", "left_anti").limit(3).collect()
    if lost:
        raise KeyError(f"no subject data for {', '.join(r[0] for r in lost)}")
    kept = subject_table.where(F.col(outcome).isNotNull()).withColumn("y", equals(subject_table, outcome, positive))
    samples = metadata.join(abundance.select("sample_id").distinct(), "sample_id", "left_semi").join(kept.select("subject_id"), "subject_id", "left_semi")
    obs = abundance.join(samples.select("sample_id", "subject_id", "time"), "sample_id").select("subject_id", "time", "sample_id", "variable", "value")
    return kept, samples, obs
