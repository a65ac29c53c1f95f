"""Window statistics of an unbounded stream of observations, kept as mergeable sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoset.operators.windows import containing

SUMS = ("n", "st", "sx", "stt", "stx")


def window_sums(obs: DataFrame, windows: list[tuple[float, float]]) -> DataFrame:
    """Sums per (t0, t1, variable, subject_id): they add up over batches, so late rows need no watermark."""
    t, x = F.col("time"), F.col("value")
    rows = obs.select("subject_id", "variable", "time", "value", F.explode(containing(windows)).alias("w"))
    return rows.groupBy("w.t0", "w.t1", "variable", "subject_id").agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("st"), F.sum(x).alias("sx"), F.sum(t * t).alias("stt"), F.sum(t * x).alias("stx"))


def merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy("t0", "t1", "variable", "subject_id").agg(*[F.sum(c).alias(c) for c in SUMS])


def values_of(sums: DataFrame) -> DataFrame:
    """Averages and slopes from merged sums; the slope of equal times is that of the shortest solution."""
    spread = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    mean, centred = F.col("sx") / F.col("n"), F.col("st") / F.col("n") - (F.col("t0") + F.col("t1")) / 2
    slope = F.when(spread > F.lit(1e-9) * F.col("n") * F.col("stt"), (F.col("n") * F.col("stx") - F.col("st") * F.col("sx")) / spread)
    return sums.select("t0", "t1", "variable", "subject_id", mean.alias("average"), F.coalesce(slope, mean * centred / (centred * centred + 1.0)).alias("slope"), "n")


def write_sums(stream: DataFrame, windows: list[tuple[float, float]], path: str, checkpoint: str):
    """Start a query that adds each batch's sums to Parquet at ``path``, partitioned by batch, so a batch that is run
    again replaces itself; read them back through :func:`merged`."""

    def add(batch: DataFrame, number: int) -> None:
        window_sums(batch, windows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
