"""Writers: variable tables, summaries as text, and data for a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_variable_table(leaf_table: DataFrame, annotations: DataFrame, path: str) -> None:
    """TSV of variable, description and leaves, a folder of part files."""
    rows = leaf_table.join(annotations, "variable", "left").select("variable", F.coalesce("description", F.lit("(no annotation)")).alias("description"), "leaves")
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_study(frames: dict[str, DataFrame], path: str) -> None:
    """A study bundle as Parquet folders, one for each table."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def read_study(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_records(frames: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines, the input of a page that draws detectors, trees and grids."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def rule_text(rules: list[dict]) -> str:
    """Rules as sentences from small collected rows: atoms as text, beta median and range, and coverage."""
    out = []
    for i, r in enumerate(rules, 1):
        verb = "increases" if r["median"] > 0 else "decreases"
        out.append(f"Rule {i}: if {' and '.join(r['atoms'])}, log-odds {verb} by {abs(r['median']):.3g} ({r['low']:.3g} to {r['high']:.3g}); {r['covered']} subjects, {r['positive']} of them positive")
    return "\n".join(out) or "(no rules)"


def write_texts(spark, texts: dict[str, str], path: str) -> None:
    """Each text as a folder of one text file, wherever Spark can write."""
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
