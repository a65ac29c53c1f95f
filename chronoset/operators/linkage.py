"""Average linkage of values on a line, in sorted runs of bounded size, and what thresholds follow from it."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoset.operators.ordering import numbered, running_sum
from chronoset.sources.scratch import settle


def merge_run(size: np.ndarray, total: np.ndarray, before: float, after: float) -> list[tuple[int, int, float]]:
    """(left, right, height) merges of neighbouring clusters that any values outside the run leave as they are.

    The average distance of two clusters on a line is that of their means, and their nearest clusters are their
    neighbours. A pair merges when each is the other's nearest; pairs are looked at by rising distance. ``before`` and
    ``after`` are the least distances to what lies outside the run: a cluster at an end whose neighbour outside may be
    nearer waits, and so does every cluster whose nearest one waits.
    """
    n = len(size)
    size, total = size.tolist(), total.tolist()
    nxt, prv, alive, waits, stamp = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n, [False] * n, [0] * n
    gaps = [(total[i + 1] / size[i + 1] - total[i] / size[i], i, i + 1, 0, 0) for i in range(n - 1)]
    heapify(gaps)
    out = []
    while gaps:
        gap, i, j, si, sj = heappop(gaps)
        if not alive[i] or not alive[j] or stamp[i] != si or stamp[j] != sj:
            continue
        # the left one of two equal distances merges first
        if waits[i] or waits[j] or prv[i] < 0 and gap >= before or nxt[j] < 0 and gap > after:
            waits[i] = waits[j] = True
            continue
        out.append((i, j, gap))
        size[i] += size[j]
        total[i] += total[j]
        alive[j] = False
        stamp[i] += 1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b >= 0:
                heappush(gaps, (total[b] / size[b] - total[a] / size[a], a, b, stamp[a], stamp[b]))
    return out


def merge_heights(values: DataFrame, key: tuple[str, ...], run: int = 50_000) -> DataFrame:
    """(key, value, next_value, height): for each two neighbouring distinct values the height at which average linkage
    of all values of their key joins them.

    ``values`` has the key and value. Distinct values are numbered in order and cut into runs of ``run`` rows, whatever
    their keys; each round merges in every run what outside values cannot change, and what is left is numbered and
    cut anew, until each key is one cluster. A key whose values lie in one run needs one round.
    """
    spark = values.sparkSession
    start = values.where(F.col("value").isNotNull()).groupBy(*key, "value").agg(F.count(F.lit(1)).cast("double").alias("size"))
    now = start.select(*key, F.col("value").alias("low"), F.col("value").alias("high"), "size", (F.col("value") * F.col("size")).alias("total"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.select(*key).schema)
    columns = [*key, "low", "high", "size", "total"]
    done, last, n_keys = [], None, None
    while True:
        rows = numbered(now, *key, "low", name="place")
        at = F.floor(F.col("place") / run)
        edge = F.when(F.col("place") % run == 0, F.array(at, at - 1)).when(F.col("place") % run == run - 1, F.array(at, at + 1)).otherwise(F.array(at))
        dealt = rows.withColumn("at", F.explode(edge)).withColumn("own", F.col("at") == F.floor(F.col("place") / run))

        def one_run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("place", ignore_index=True)
            label = pd.MultiIndex.from_frame(pdf[list(key)]).factorize()[0]
            own, low, high = pdf["own"].to_numpy(), pdf["low"].to_numpy(), pdf["high"].to_numpy()
            size, total = pdf["size"].to_numpy(), pdf["total"].to_numpy()
            keep = np.nonzero(own)[0]
            mine, rows_, merges = label[keep], [], []
            for part in np.split(keep, np.nonzero(np.diff(mine))[0] + 1):
                if not len(part):
                    continue
                a, b = part[0], part[-1]
                before = low[a] - high[a - 1] if a > 0 and label[a - 1] == label[a] else np.inf
                after = low[b + 1] - high[b] if b + 1 < len(pdf) and label[b + 1] == label[b] else np.inf
                s, t, hi, gone = size[part].copy(), total[part].copy(), high[part].copy(), np.zeros(len(part), bool)
                lo = low[part]
                for i, j, height in merge_run(s.copy(), t.copy(), before, after):
                    merges.append((part[0], hi[i], lo[j], height))
                    s[i], t[i], hi[i] = s[i] + s[j], t[i] + t[j], hi[j]
                    gone[j] = True
                left = np.nonzero(~gone)[0]
                rows_.append(pd.DataFrame({"row": part[0], "low": lo[left], "high": hi[left], "size": s[left], "total": t[left], "height": np.nan}))
            out = pd.concat([*rows_, pd.DataFrame(merges, columns=["row", "high", "low", "height"]).assign(size=0.0, total=0.0)], ignore_index=True)
            return pd.concat([pdf[list(key)].iloc[out["row"].to_numpy(int)].reset_index(drop=True), out.drop(columns="row")], axis=1)[[*columns, "height"]]

        found = settle(dealt.groupBy("at").applyInPandas(one_run, f"{schema}, low double, high double, size double, total double, height double"), "linkage")
        done.append(found.where(F.col("height").isNotNull()).select(*key, F.col("high").alias("value"), F.col("low").alias("next_value"), "height"))
        now = found.where(F.col("height").isNull()).select(*columns)
        left = now.count()
        n_keys = now.select(*key).distinct().count() if n_keys is None else n_keys
        if left <= n_keys:
            break
        if left == last:
            run *= 2  # nothing could be decided: look further
        last = left
    out = done[0] if done else spark.createDataFrame([], f"{schema}, value double, next_value double, height double")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def clustered_thresholds(long: DataFrame, key: tuple[str, ...], most: int, digits: int = 8, run: int = 50_000) -> DataFrame:
    """(key, threshold): midpoints of neighbouring values; where a key has more than ``most`` + 1 values, only those
    between the ``most`` + 1 clusters that average linkage leaves, cut at the smallest height with no more of them.

    Joins at the height of the cut all happen, so ties leave fewer clusters.
    """
    heights = settle(merge_heights(long.select(*key, "value"), key, run), "linkage-heights")
    sizes = long.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy(*key).orderBy(F.desc("height"), "value")
    top = heights.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most + 1)
    cut = top.groupBy(*key).agg(F.max(F.when(F.col("place") == most + 1, F.col("height"))).alias("cut"))
    kept = top.join(cut, list(key)).where(F.col("cut").isNull() | (F.col("height") > F.col("cut") * (1 + 1e-12)))
    many = kept.join(sizes.where(F.col("n") > most + 1), list(key), "left_semi").select(*key, (0.5 * (F.col("value") + F.col("next_value"))).alias("threshold"))
    few = sizes.where(F.col("n") <= most + 1)
    some = long.join(few, list(key), "left_semi")
    middles = heights.join(few, list(key), "left_semi").select(*key, (0.5 * (F.col("value") + F.col("next_value"))).alias("threshold"))
    repeated = some.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.col("value").alias("threshold"))
    return many.unionByName(middles).unionByName(repeated).withColumn("threshold", F.round("threshold", digits)).distinct()


def bin_medians(values: DataFrame, cuts: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, bin, upper, median) of the bins between thresholds: values from a threshold up to below the next one.

    A bin without values has its upper edge as its median, and the last one infinity.
    """
    marks = cuts.select(*key, F.col("threshold").alias("x"), F.lit(True).alias("edge"))
    both = values.select(*key, F.col("value").alias("x"), F.lit(False).alias("edge")).join(cuts.select(*key).distinct(), list(key), "left_semi").unionByName(marks)
    run = settle(running_sum(both, F.col("edge").cast("long"), key, "x", F.desc("edge"), name="bin", place="place"), "bins")
    inside = run.where(~F.col("edge"))
    spans = inside.groupBy(*key, "bin").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    at = F.col("place") - F.col("first")
    central = inside.join(spans, [*key, "bin"]).where((at == F.floor((F.col("n") - 1) / 2)) | (at == F.floor(F.col("n") / 2)))
    middle = central.groupBy(*key, "bin").agg(F.avg("x").alias("median"))
    uppers = run.where("edge").select(*key, (F.col("bin") - 1).alias("bin"), F.col("x").alias("upper"))
    last = run.where("edge").groupBy(*key).agg(F.max("bin").alias("bin")).withColumn("upper", F.lit(float("inf")))
    bins = uppers.unionByName(last.select(*key, "bin", "upper"))
    return bins.join(middle, [*key, "bin"], "left").withColumn("median", F.coalesce("median", "upper"))


def filter_by_bin_medians(values: DataFrame, cuts: DataFrame, key: tuple[str, ...], least: float | dict[str, float], least_exp: float | dict[str, float] | None = None, type_column: str = "type") -> DataFrame:
    """The thresholds of ``cuts`` (key, threshold) that part clusters of bins which differ enough.

    The bins of a key are clustered by average linkage of their medians. A threshold lies between two children of one
    node of that tree; it stays if the medians over the children's bins differ by ``least`` or more, or, where
    ``least_exp`` is given, those of the exponentials do. Limits may differ by type of detector. Keys have as many
    bins as thresholds, which mining bounds; values are reduced to medians before.
    """
    bins = bin_medians(values, cuts, key)
    limit = lambda v, t: v.get(t) if isinstance(v, dict) else v
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.select(*key).schema)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        x, upper = pdf["median"].to_numpy(float), pdf["upper"].to_numpy(float)
        kind = pdf[type_column].iloc[0] if type_column in pdf else None
        low, low_exp = limit(least, kind), limit(least_exp, kind)
        end = np.arange(len(x))  # the last bin of the cluster that starts at a bin
        good = []
        finite = np.where(np.isfinite(x), x, np.finfo(float).max / 4)
        for i, j, _ in merge_run(np.ones(len(x)), finite, np.inf, np.inf):
            left, right = x[i : end[i] + 1], x[j : end[j] + 1]
            with np.errstate(over="ignore", invalid="ignore"):
                ok = np.median(right) - np.median(left) >= low
                if low_exp is not None:
                    ok = ok or np.median(np.exp(right)) - np.median(np.exp(left)) >= low_exp
            if ok:
                good.append(upper[end[i]])
            end[i] = end[j]
        return pdf[list(key)].iloc[[0] * len(good)].assign(threshold=good)

    return bins.groupBy(*key).applyInPandas(keep, f"{schema}, threshold double")
