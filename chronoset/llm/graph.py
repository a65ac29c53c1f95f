"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronoset.llm.common import lean, settle

#: Edges that a task joins at once before the first round.
TOGETHER = 200_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes of the edges but the least ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):  # lower the roots of both sides to the lesser one until they agree
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, np.maximum(root[x], root[y]), low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        differ = root[x] != root[y]
        x, y = x[differ], y[differ]
    leaves = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[leaves], nodes[root[leaves]]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars of bounded portions of them, which join the same nodes."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]))
        n += batch.num_rows
        if n >= TOGETHER:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*np.concatenate(held, axis=1))], ["u", "v"])
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*np.concatenate(held, axis=1))], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges; the root is the smallest node of its component.

    Each round points the larger neighbours of a node at its least neighbour (large star) and then does the same
    with the smaller ones (small star), which keeps the number of edges at most linear. Rounds end when the edges
    stop changing; each round is a written table. Before the first one each task turns portions of its edges into
    stars if nodes are longs, and again when stars of a centre have met, which leaves fewer rounds. Self loops and repeated or null edges are left out; no
    edges give no rows.
    """
    kept = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    kept = kept.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if all(kind == "bigint" for _, kind in kept.dtypes):
        kept = kept.mapInArrow(lean(joined), "u long, v long").repartition("v").mapInArrow(lean(joined), "u long, v long")

    def told(edges: DataFrame) -> tuple[DataFrame, dict]:
        """The distinct edges, written, and what tells them from others, which is counted while they are written."""
        seen = Observation()
        out = settle(edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        return out, seen.get

    now, last = told(kept)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, state = told(lowest.select("u", F.col("m").alias("v")).unionByName(rest))
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
