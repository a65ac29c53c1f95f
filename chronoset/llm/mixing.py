"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoset.llm.common import row_key, settle
from chronoset.operators.ordering import running_sum

WORD = r"[^\x20\x09-\x0D]+"


def _copies_up_to(cut, repeats: int) -> Column:
    """How many copies of a row come at or before the cut in (finish time, source position) order."""
    total = F.lit(0)
    for e in range(repeats):
        f = (F.lit(e) * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")
        total = total + F.when((f < F.lit(cut["f"])) | ((f == F.lit(cut["f"])) & (F.col("pos") <= cut["pos"])), 1).otherwise(0)
    return total


def source_targets(sizes: DataFrame, *, weights=(1, 2, 3), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(source, source_size, pos, target, n) of a table (source, source_size, n) with one row per source.

    Sources in code point order, null last, take the weights in turn. A target stops at ``repeats`` times the size
    of its source; the excess goes to the other sources by weight until none is above. The windows here run over
    one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * repeats).cast("double")
    by_ratio = Window.orderBy("ratio", "pos")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("pos", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", cap)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("place", F.row_number().over(by_ratio))
    budget = F.sum("source_size").over(everything).cast("double") * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    first_open = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("place"))).over(everything)
    ranked = ranked.withColumn("open_from", F.coalesce(first_open, F.lit(1 << 30)))
    final = F.max(F.when(F.col("place") == F.col("open_from"), F.col("level"))).over(everything)
    ranked = ranked.withColumn("final", final)
    target = F.when(F.col("place") < F.col("open_from"), F.col("cap")).otherwise(F.col("final") * F.col("w"))
    return ranked.select("source", "source_size", "n", "pos", target.alias("target"))


def mix(docs: DataFrame, *, weights=(1, 2, 3), share: float = 1.0, repeats: int = 3, seed: str = "mix", bucket_rows: int = 2000) -> DataFrame:
    """Mix all rows of ``docs`` (doc_id, text, source) to target weights.

    Every source is shuffled by md5(seed:doc_id), then md5(text). A copy of a document (up to ``repeats`` copies, one per pass over
    its source) has the virtual finish time (words of its source up to and with it, over all passes) / target.
    Copies are taken in the order of finish time and source position (finish times of a source differ) until the budget, ``share`` of all
    words, is spent.

    Returns doc_id, row (a key of doc_id and text), source, size, source_size, target, taken, copies, finish: one row per input row.

    Running sums never hold a source or the corpus in one task, nor the rows of one id or without one: sources are cut
    into ranges of the shuffle key and of rows that share it, sums of ranges give the offsets, and the global order is
    cut at the one slice of finish times, of about ``bucket_rows`` rows, where the budget runs out.

    Null text counts 0 words; a null source is a source of its own and comes last; null or repeated doc_ids follow
    each other in the order of their texts' digests, and rows that are equal in all this in any order, each with its
    own finish time; a document of no words takes 0; an empty table gives an empty table. Other
    columns are ignored.
    """
    tie = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))).cast("binary"))
    base = settle(docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.col("source").cast("string").alias("source"), size.alias("size"), F.concat(key, tie).alias("k")), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = settle(source_targets(sizes, weights=weights, share=share, repeats=repeats), "mix-targets")
    t = targets.withColumnRenamed("source", "of_source")
    rows = base.join(t, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("nth", F.monotonically_increasing_id())
    rows = running_sum(rows, F.col("size"), ("pos",), "k", "nth", name="cum")
    rows = rows.withColumn("finish", F.when(F.col("target") > 0, F.col("cum").cast("double") / F.col("target")).otherwise(F.lit(0.0)))
    rows = settle(rows.select("doc_id", "row", "source", "size", "source_size", "target", "n", "pos", "cum", "finish"), "mix-queue")

    budget, n_rows = targets.agg(F.sum("source_size") * F.lit(share), F.sum("n")).first() or (0, 0)
    cut = _cut(rows, budget or 0, n_rows or 0, repeats, bucket_rows)
    copies = F.when((F.col("target") > 0) & (F.col("size") > 0), _copies_up_to(cut, repeats) if cut else F.lit(repeats)).otherwise(0)
    out = rows.withColumn("copies", copies.cast("int"))
    return out.select("doc_id", "row", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "finish")


def _cut(rows: DataFrame, budget: float, n_rows: int, repeats: int, bucket_rows: int):
    """The last copy within the budget, as {f, pos}; None if all copies are."""
    passes = F.explode(F.array(*[F.lit(e) for e in range(repeats)])).alias("e")
    copies = rows.where((F.col("target") > 0) & (F.col("size") > 0)).select("*", passes)
    copies = copies.withColumn("f", (F.col("e") * F.col("source_size") + F.col("cum")).cast("double") / F.col("target"))
    slices = max(1, -(-n_rows // bucket_rows))
    copies = copies.select("f", "pos", "size", F.floor(F.col("f") * slices).alias("slice"))
    run = Window.orderBy("slice")
    sums = copies.groupBy("slice").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(run))
    over = sums.where(F.col("upto") > budget).orderBy("slice").first()
    if over is None:
        return None
    start = over["upto"] - over["words"]
    order = Window.orderBy("f", "pos")
    inside = copies.where(F.col("slice") == over["slice"]).withColumn("run", F.sum("size").over(order) + F.lit(start))
    last = inside.where(F.col("run") <= budget).orderBy(F.desc("f"), F.desc("pos")).select("f", "pos").first()
    if last is None:  # the cut falls just before this slice
        last = copies.where(F.col("slice") < over["slice"]).orderBy(F.desc("f"), F.desc("pos")).select("f", "pos").first()
    return last.asDict() if last else {"f": -1.0, "pos": -1}
