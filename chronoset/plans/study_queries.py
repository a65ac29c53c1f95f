"""Queries on studies, windows, detectors, filters and transforms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoset.operators import detectors, filters, linkage, metrics, subsample, transforms, truths
from chronoset.operators import windows as W
from chronoset.operators.ordering import numbered
from chronoset.sources.scratch import settle
from chronoset.sources.studies import Study, event_rows, events_study, order_rows, orders_study, r6, table

QUERIES: dict = {}
ORACLE: dict = {}

# ------------------------------------------------------------------------------------------------ shared SQL

EVENTS = """
raw AS (
  SELECT user_id AS subject_id, datediff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS time, event_type AS variable, value
  FROM events),
smp AS (SELECT DISTINCT subject_id, time FROM raw),
vars AS (SELECT DISTINCT variable FROM raw WHERE variable IS NOT NULL),
sums AS (SELECT subject_id, time, variable, round(sum(value), 6) AS value FROM raw GROUP BY ALL),
obs AS (
  SELECT s.subject_id, s.time, v.variable, coalesce(x.value, 0.0) + 0.0 AS value
  FROM smp s CROSS JOIN vars v LEFT JOIN sums x ON x.subject_id = s.subject_id AND x.time = s.time AND x.variable = v.variable),
subj AS (
  SELECT c_custkey AS subject_id, c_mktsegment = 'BUILDING' AS y, c_nationkey, c_acctbal
  FROM customer WHERE c_custkey IN (SELECT subject_id FROM raw))
"""

ORDERS = """
raw AS (
  SELECT o_custkey AS subject_id, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS time, n_name AS variable, l_quantity AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
smp AS (SELECT DISTINCT subject_id, time FROM raw),
vars AS (SELECT DISTINCT n_name AS variable FROM nation),
sums AS (SELECT subject_id, time, variable, round(sum(value), 6) AS value FROM raw GROUP BY ALL),
obs AS (
  SELECT s.subject_id, s.time, v.variable, coalesce(x.value, 0.0) + 0.0 AS value
  FROM smp s CROSS JOIN vars v LEFT JOIN sums x ON x.subject_id = s.subject_id AND x.time = s.time AND x.variable = v.variable),
subj AS (
  SELECT c_custkey AS subject_id, c_mktsegment = 'BUILDING' AS y, c_nationkey, c_acctbal
  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
"""


def edge_sql(start: float, end: float, n: int) -> str:
    return f"edge AS (SELECT i, CASE WHEN i = {n} THEN {end}::DOUBLE ELSE {start}::DOUBLE + i * (({end}::DOUBLE - {start}::DOUBLE) / {n}) END AS x FROM range({n + 1}) r(i))"


def detector_sql(n: int = 3) -> str:
    return (EVENTS + f", {edge_sql(0.0, 30.0, n)}," + """
win AS (SELECT a.x AS t0, b.x AS t1 FROM edge a JOIN edge b ON a.i < b.i),
per AS (SELECT w.t0, w.t1, s.subject_id, count(m.time) AS n FROM win w CROSS JOIN subj s LEFT JOIN smp m ON m.subject_id = s.subject_id AND m.time BETWEEN w.t0 AND w.t1 GROUP BY ALL),
valid AS (SELECT t0, t1, min(n) AS fewest, min(n) >= 2 AS slope_ok FROM per GROUP BY ALL HAVING min(n) >= 1),
dv AS (
  SELECT v.t0, v.t1, o.variable, o.subject_id, avg(o.value) AS average,
    coalesce(regr_slope(o.value, o.time), avg(o.value) * (avg(o.time) - (v.t0 + v.t1) / 2) / ((avg(o.time) - (v.t0 + v.t1) / 2) * (avg(o.time) - (v.t0 + v.t1) / 2) + 1.0)) AS slope,
    count(*) AS n
  FROM obs o JOIN valid v ON o.time BETWEEN v.t0 AND v.t1 GROUP BY v.t0, v.t1, o.variable, o.subject_id),
long AS (
  SELECT t0, t1, variable, 'average' AS type, subject_id, round(average, 6) + 0.0 AS value FROM dv
  UNION ALL SELECT t0, t1, variable, 'slope', subject_id, round(slope, 6) + 0.0 FROM dv JOIN valid USING (t0, t1) WHERE slope_ok),
thr AS (
  SELECT DISTINCT t0, t1, variable, type, threshold FROM (
    SELECT *, round(0.5 * (value + lead(value) OVER (PARTITION BY t0, t1, variable, type ORDER BY value)), 8) AS threshold FROM long)
  WHERE threshold IS NOT NULL)
""")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def mined(spark: SparkSession, sf_dir: str, intervals: int = 3) -> tuple[Study, DataFrame, DataFrame]:
    """(study, long values, thresholds) of the events study, with windows that are valid for all subjects."""
    s = events_study(spark, sf_dir)
    s = s.with_(samples=s.samples.join(s.subjects, "subject_id", "left_semi"), observations=s.observations.join(s.subjects, "subject_id", "left_semi"))
    good = W.valid_windows(s.subjects, s.samples, W.windows_of(s.start, s.end, intervals)).collect()  # one row a window
    wide = detectors.values(s.observations, [(r["t0"], r["t1"]) for r in good])
    long = detectors.long_values(wide, [(r["t0"], r["t1"]) for r in good if r["slope_ok"]])
    long = settle(long, "detector-values")  # read by several branches of what follows
    return s, long, detectors.thresholds(long)


# ------------------------------------------------------------------------------------------------ studies

@query("study_samples", f"WITH {EVENTS} SELECT * FROM obs")
def study_samples(spark, sf_dir):
    return events_study(spark, sf_dir).observations


@query("study_subjects", f"WITH {EVENTS} SELECT subj.*, coalesce(n, 0)::BIGINT AS n_samples FROM subj LEFT JOIN (SELECT subject_id, count(*) AS n FROM smp GROUP BY 1) USING (subject_id)")
def study_subjects(spark, sf_dir):
    s = events_study(spark, sf_dir)
    n = s.samples.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    return s.subjects.join(n, "subject_id", "left").withColumn("n_samples", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


@query("orders_observations", f"WITH {ORDERS} SELECT * FROM obs")
def orders_observations(spark, sf_dir):
    return orders_study(spark, sf_dir).observations


@query("study_size", f"WITH {ORDERS} SELECT (SELECT count(*) FROM subj)::BIGINT AS subjects, (SELECT count(*) FROM smp)::BIGINT AS samples, count(DISTINCT variable)::BIGINT AS variables, count(*) FILTER (value <> 0)::BIGINT AS nonzero FROM obs")
def study_size(spark, sf_dir):
    s = orders_study(spark, sf_dir)
    sizes = s.observations.agg(F.countDistinct("variable").alias("variables"), F.count_if(F.col("value") != 0).alias("nonzero"))
    return s.subjects.agg(F.count(F.lit(1)).alias("subjects")).crossJoin(s.samples.agg(F.count(F.lit(1)).alias("samples"))).crossJoin(sizes)


@query("window_edges", f"WITH {ORDERS}, b AS (SELECT min(time) AS s, max(time) AS e FROM smp) SELECT i::BIGINT AS i, CASE WHEN i = 4 THEN e ELSE s + i * ((e - s) / 4) END AS edge FROM b, range(5) r(i)")
def window_edges(spark, sf_dir):
    """Equally spaced edges between the first and the last sample of the study."""
    b = order_rows(spark, sf_dir).agg(F.min("time").alias("s"), F.max("time").alias("e"))
    n = 4
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("i")
    return b.select("s", "e", i).select("i", F.when(F.col("i") == n, F.col("e")).otherwise(F.col("s") + F.col("i") * ((F.col("e") - F.col("s")) / n)).alias("edge"))


@query("windows_valid", f"WITH {detector_sql(5)} SELECT t0, t1, fewest::BIGINT AS fewest, slope_ok FROM valid")
def windows_valid(spark, sf_dir):
    s = events_study(spark, sf_dir)
    return W.valid_windows(s.subjects, s.samples, W.windows_of(s.start, s.end, 5))


# ------------------------------------------------------------------------------------------------ detectors

@query("detector_average", f"WITH {detector_sql()} SELECT t0, t1, variable, subject_id, value AS average FROM long WHERE type = 'average'")
def detector_average(spark, sf_dir):
    return mined(spark, sf_dir)[1].where("type = 'average'").select("t0", "t1", "variable", "subject_id", F.col("value").alias("average"))


@query("detector_slope", f"WITH {detector_sql()} SELECT t0, t1, variable, subject_id, value AS slope FROM long WHERE type = 'slope'")
def detector_slope(spark, sf_dir):
    return mined(spark, sf_dir)[1].where("type = 'slope'").select("t0", "t1", "variable", "subject_id", F.col("value").alias("slope"))


@query("detector_slope_degenerate", f"""WITH {EVENTS}, {edge_sql(0.0, 30.0, 40)}, win AS (SELECT a.x AS t0, b.x AS t1 FROM edge a JOIN edge b ON b.i = a.i + 1)
SELECT t0, t1, variable, subject_id, round(CASE WHEN min(time) = max(time) THEN avg(value) * (avg(time) - (t0 + t1) / 2) / ((avg(time) - (t0 + t1) / 2) * (avg(time) - (t0 + t1) / 2) + 1.0) ELSE regr_slope(value, time) END, 6) + 0.0 AS slope, count(*)::BIGINT AS n
FROM obs JOIN win ON time BETWEEN t0 AND t1 GROUP BY t0, t1, variable, subject_id""")
def detector_slope_degenerate(spark, sf_dir):
    """Windows shorter than a day hold one time per subject, so slopes are those of the shortest solution."""
    s = events_study(spark, sf_dir)
    wide = detectors.values(s.observations, [(a, b) for _, a, b in W.blocks_of(0.0, 30.0, 40)])
    return wide.select("t0", "t1", "variable", "subject_id", r6("slope").alias("slope"), "n")


@query("detector_values_atoms", f"WITH {EVENTS}, {edge_sql(0.0, 30.0, 3)}, win AS (SELECT a.x AS t0, b.x AS t1 FROM edge a JOIN edge b ON a.i < b.i) SELECT t0, t1, variable, subject_id, round(avg(value), 6) + 0.0 AS average, round(CASE WHEN min(time) = max(time) THEN avg(value) * (avg(time) - (t0 + t1) / 2) / ((avg(time) - (t0 + t1) / 2) * (avg(time) - (t0 + t1) / 2) + 1.0) ELSE regr_slope(value, time) END, 6) + 0.0 AS slope, count(*)::BIGINT AS n FROM obs JOIN win ON time BETWEEN t0 AND t1 GROUP BY t0, t1, variable, subject_id")
def detector_values_atoms(spark, sf_dir):
    s = events_study(spark, sf_dir)
    wide = detectors.values_by_atoms(s.observations, 0.0, 30.0, 3, W.windows_of(0.0, 30.0, 3))
    return wide.select("t0", "t1", "variable", "subject_id", r6("average").alias("average"), r6("slope").alias("slope"), "n")


@query("detector_thresholds", f"WITH {detector_sql()} SELECT * FROM thr")
def detector_thresholds(spark, sf_dir):
    return mined(spark, sf_dir)[2]


def linkage_sql(most: int) -> str:
    """Average linkage of each key's values, one join at a time, and the thresholds it leaves."""
    return f"""
start AS (SELECT t0, t1, variable, type, list(n ORDER BY value) AS sizes, list(value * n ORDER BY value) AS totals, list(value ORDER BY value) AS ends, list(value ORDER BY value)[2:] AS starts
  FROM (SELECT t0, t1, variable, type, value, count(*)::DOUBLE AS n FROM long GROUP BY ALL) GROUP BY ALL),
joins AS (
  SELECT *, NULL::DOUBLE AS height, NULL::DOUBLE AS v, NULL::DOUBLE AS w FROM start
  UNION ALL
  SELECT t0, t1, variable, type, list_concat(list_concat(sizes[1:i - 1], [sizes[i] + sizes[i + 1]]), sizes[i + 2:]), list_concat(list_concat(totals[1:i - 1], [totals[i] + totals[i + 1]]), totals[i + 2:]),
    list_concat(ends[1:i - 1], ends[i + 1:]), list_concat(starts[1:i - 1], starts[i + 1:]), gaps[i], ends[i], starts[i]
  FROM (SELECT *, list_position(gaps, list_min(gaps)) AS i FROM (SELECT * EXCLUDE (height, v, w), list_transform(range(1, len(sizes)), lambda j: totals[j + 1] / sizes[j + 1] - totals[j] / sizes[j]) AS gaps FROM joins WHERE len(sizes) > 1))),
placed AS (SELECT t0, t1, variable, type, height, v, w, row_number() OVER (PARTITION BY t0, t1, variable, type ORDER BY height DESC, v) AS place FROM joins WHERE height IS NOT NULL),
cut AS (SELECT t0, t1, variable, type, max(height) FILTER (place = {most + 1}) AS cut FROM placed GROUP BY ALL),
sized AS (SELECT t0, t1, variable, type, count(*) AS n FROM long GROUP BY ALL),
clustered AS (
  SELECT DISTINCT t0, t1, variable, type, round(threshold, 8) AS threshold FROM (
    SELECT t0, t1, variable, type, 0.5 * (v + w) AS threshold FROM placed JOIN cut USING (t0, t1, variable, type) JOIN sized USING (t0, t1, variable, type)
    WHERE n <= {most + 1} OR cut IS NULL OR height > cut * (1 + 1e-12)
    UNION ALL SELECT t0, t1, variable, type, value FROM long JOIN sized USING (t0, t1, variable, type) WHERE n <= {most + 1} GROUP BY t0, t1, variable, type, value HAVING count(*) > 1))
"""


@query("detector_thresholds_clustered", f"WITH RECURSIVE {detector_sql()}, {linkage_sql(20)} SELECT * FROM clustered")
def detector_thresholds_clustered(spark, sf_dir):
    return detectors.clustered_thresholds(mined(spark, sf_dir)[1], 20)


@query("detector_population_counts", f"WITH {detector_sql()} SELECT variable, type, (2 * count(*))::BIGINT AS n_detectors, count(DISTINCT (t0, t1))::BIGINT AS n_windows FROM thr GROUP BY ALL")
def detector_population_counts(spark, sf_dir):
    return mined(spark, sf_dir)[2].groupBy("variable", "type").agg((2 * F.count(F.lit(1))).alias("n_detectors"), F.countDistinct("t0", "t1").alias("n_windows"))


_BITS = """, pop AS (
  SELECT t.t0, t.t1, t.variable, t.type, t.threshold, string_agg(CASE WHEN l.value > t.threshold THEN '1' ELSE '0' END, '' ORDER BY l.subject_id) AS bits
  FROM thr t JOIN long l USING (t0, t1, variable, type) GROUP BY ALL),
sides AS (SELECT *, 'above' AS direction FROM pop UNION ALL SELECT * EXCLUDE (bits), translate(bits, '01', '10') AS bits, 'below' FROM pop)
"""


@query("detector_truth_order", f"WITH {detector_sql()} {_BITS} SELECT *, (row_number() OVER (ORDER BY bits, t0, t1, variable, type, threshold, direction) - 1)::BIGINT AS detector_id FROM sides")
def detector_truth_order(spark, sf_dir):
    """Detectors numbered by their packed truths, which are written out as text after that."""
    _, long, cuts = mined(spark, sf_dir)
    return truths.numbered_texts(long, cuts)


_WORDS = """, place AS (SELECT subject_id, y, (row_number() OVER (ORDER BY subject_id) - 1) // 63 AS block, 1::BIGINT << (62 - (row_number() OVER (ORDER BY subject_id) - 1) % 63)::INT AS bit FROM subj),
met AS (SELECT t.t0, t.t1, t.variable, t.type, t.threshold, p.block, p.bit, p.y, l.value > t.threshold AS up FROM thr t JOIN long l USING (t0, t1, variable, type) JOIN place p USING (subject_id)),
words AS (
  SELECT t0, t1, variable, type, threshold, 'above' AS direction, block::BIGINT AS block, coalesce(bit_or(bit) FILTER (up), 0)::BIGINT AS word FROM met GROUP BY ALL
  UNION ALL SELECT t0, t1, variable, type, threshold, 'below', block::BIGINT, coalesce(bit_or(bit) FILTER (NOT up), 0)::BIGINT FROM met GROUP BY ALL)
"""


@query("truth_words", f"WITH {detector_sql()} {_WORDS} SELECT * FROM words")
def truth_words(spark, sf_dir):
    """The truth matrix in words of 63 subjects."""
    s, long, cuts = mined(spark, sf_dir)
    return truths.packed(long, cuts, truths.placed(s.subjects))


@query("truth_hamming", f"""WITH {detector_sql()} {_WORDS} SELECT t0, t1, variable, type, threshold, 'above' AS direction, count(*) FILTER (up)::BIGINT AS n_true, count(*) FILTER (up <> y)::BIGINT AS distance FROM met GROUP BY ALL
UNION ALL SELECT t0, t1, variable, type, threshold, 'below', count(*) FILTER (NOT up)::BIGINT, count(*) FILTER (up = y)::BIGINT FROM met GROUP BY ALL""")
def truth_hamming(spark, sf_dir):
    """Each detector's number of true subjects and its Hamming distance to the outcome."""
    s, long, cuts = mined(spark, sf_dir)
    return detectors.distances(long, cuts, s.subjects)


_BINS = """, marks AS (SELECT t0, t1, variable, type, threshold AS upper FROM clustered UNION ALL SELECT DISTINCT t0, t1, variable, type, 'Infinity'::DOUBLE FROM clustered),
bins AS (SELECT *, row_number() OVER (PARTITION BY t0, t1, variable, type ORDER BY upper) - 1 AS bin, lag(upper, 1, '-Infinity'::DOUBLE) OVER (PARTITION BY t0, t1, variable, type ORDER BY upper) AS lower FROM marks),
medians AS (SELECT b.t0, b.t1, b.variable, b.type, b.bin, b.upper, coalesce(median(l.value), b.upper) AS m FROM bins b LEFT JOIN long l ON l.t0 = b.t0 AND l.t1 = b.t1 AND l.variable = b.variable AND l.type = b.type AND l.value >= b.lower AND l.value < b.upper GROUP BY b.t0, b.t1, b.variable, b.type, b.bin, b.upper),
leaf AS (SELECT t0, t1, variable, type, list([m] ORDER BY bin) AS parts, list(upper ORDER BY bin) AS uppers FROM medians GROUP BY ALL),
tree AS (
  SELECT *, NULL::DOUBLE AS gap, NULL::DOUBLE AS egap, NULL::DOUBLE AS threshold FROM leaf
  UNION ALL
  SELECT t0, t1, variable, type, list_concat(list_concat(parts[1:i - 1], [list_concat(parts[i], parts[i + 1])]), parts[i + 2:]), list_concat(uppers[1:i - 1], uppers[i + 1:]),
    list_aggregate(parts[i + 1], 'median') - list_aggregate(parts[i], 'median'), list_aggregate(list_transform(parts[i + 1], lambda x: exp(x)), 'median') - list_aggregate(list_transform(parts[i], lambda x: exp(x)), 'median'), uppers[i]
  FROM (SELECT *, list_position(gaps, list_min(gaps)) AS i FROM (SELECT * EXCLUDE (gap, egap, threshold), list_transform(range(1, len(parts)), lambda j: list_sum(parts[j + 1]) / len(parts[j + 1]) - list_sum(parts[j]) / len(parts[j])) AS gaps FROM tree WHERE len(parts) > 1)))
"""


@query("threshold_bin_filter", f"WITH RECURSIVE {detector_sql()}, {linkage_sql(12)} {_BINS} SELECT t0, t1, variable, type, threshold FROM tree WHERE gap >= CASE WHEN type = 'average' THEN 4.0 ELSE 0.5 END")
def threshold_bin_filter(spark, sf_dir):
    """Thresholds whose two sides in the tree of bins differ by 4 in the medians of averages, or 0.5 of slopes."""
    _, long, _ = mined(spark, sf_dir)
    cuts = settle(detectors.clustered_thresholds(long, 12), "clustered-thresholds")
    return linkage.filter_by_bin_medians(long, cuts, detectors.KEY, {"average": 4.0, "slope": 0.5})


@query("threshold_bin_filter_exp", f"WITH RECURSIVE {detector_sql()}, {linkage_sql(12)} {_BINS} SELECT t0, t1, variable, type, threshold FROM tree WHERE type = 'slope' AND (gap >= 2.0 OR egap >= 0.75)")
def threshold_bin_filter_exp(spark, sf_dir):
    """The same for slopes, which may differ on the exponential scale in place of the linear one."""
    long = mined(spark, sf_dir)[1].where("type = 'slope'")
    cuts = settle(detectors.clustered_thresholds(long, 12), "clustered-thresholds")
    return linkage.filter_by_bin_medians(long, cuts, detectors.KEY, 2.0, 0.75)


@query("detector_best_match_outcome", f"""WITH {detector_sql()}, agree AS (
  SELECT t.t0, t.t1, t.variable, t.type, t.threshold, count(*) FILTER ((l.value > t.threshold) = s.y) AS above, count(*) FILTER ((l.value <= t.threshold) = s.y) AS below
  FROM thr t JOIN long l USING (t0, t1, variable, type) JOIN subj s USING (subject_id) GROUP BY ALL),
sides AS (SELECT t0, t1, variable, type, threshold, 'above' AS direction, above AS agree FROM agree UNION ALL SELECT t0, t1, variable, type, threshold, 'below', below FROM agree)
SELECT * REPLACE (agree::BIGINT AS agree) FROM sides ORDER BY agree DESC, t0, t1, variable, type, threshold, direction LIMIT 20""")
def detector_best_match_outcome(spark, sf_dir):
    """The 20 detectors that agree best with the outcome."""
    s, long, cuts = mined(spark, sf_dir)
    found = detectors.agreement(long, cuts, s.subjects)
    return found.orderBy(F.desc("agree"), "t0", "t1", "variable", "type", "threshold", "direction").limit(20)


@query("detector_filter", f"""WITH {detector_sql()} SELECT t0, t1, variable, type, threshold, count(*) FILTER (value > threshold)::BIGINT AS n_above FROM thr JOIN long USING (t0, t1, variable, type) GROUP BY ALL
HAVING count(*) FILTER (value > threshold) BETWEEN 0.25 * count(*) AND 0.75 * count(*)""")
def detector_filter(spark, sf_dir):
    """Detectors whose truth splits the subjects in parts of a quarter at least."""
    _, long, cuts = mined(spark, sf_dir)
    n = detectors.counted_above(long, cuts)
    return n.where(F.col("n_above").between(0.25 * F.col("n"), 0.75 * F.col("n"))).drop("n")


@query("value_panel", f"WITH {detector_sql()} SELECT t0, t1, variable, type, subject_id, value, round(value - median(value) OVER p, 8) + 0.0 AS deviation, round(max(value) OVER p - min(value) OVER p, 6) + 0.0 AS spread FROM long WINDOW p AS (PARTITION BY t0, t1, variable, type)")
def value_panel(spark, sf_dir):
    long = mined(spark, sf_dir)[1]
    key = list(detectors.KEY)
    stats = long.groupBy(*key).agg(F.median("value").alias("m"), (F.max("value") - F.min("value")).alias("w"))
    return long.join(stats, key).select(*key, "subject_id", "value", r6(F.col("value") - F.col("m"), 8).alias("deviation"), r6("w").alias("spread"))


@query("rank_panel", f"WITH {detector_sql()} SELECT t0, t1, variable, type, subject_id, rank() OVER (PARTITION BY t0, t1, variable, type ORDER BY value) + (count(*) OVER (PARTITION BY t0, t1, variable, type, value) - 1) / 2.0::DOUBLE AS rank FROM long")
def rank_panel(spark, sf_dir):
    return metrics.rank_panel(mined(spark, sf_dir)[1])


_H = "CASE WHEN {0} > 0 THEN -({0} / t) * ln({0} / t) ELSE 0 END"


@query("mi_panel", f"""WITH {detector_sql()},
ranked AS (SELECT t0, t1, variable, type, y, rank() OVER (PARTITION BY t0, t1, variable, type ORDER BY value) + (count(*) OVER (PARTITION BY t0, t1, variable, type, value) - 1) / 2.0::DOUBLE AS upto FROM long JOIN subj USING (subject_id)),
c AS (SELECT t0, t1, variable, type, upto, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM ranked GROUP BY ALL),
r AS (SELECT t0, t1, variable, type, upto, (sum(p) OVER u)::DOUBLE AS a, (sum(q) OVER u)::DOUBLE AS b, (sum(p) OVER e)::DOUBLE AS pos, (sum(q) OVER e)::DOUBLE AS neg FROM c
  WINDOW u AS (PARTITION BY t0, t1, variable, type ORDER BY upto), e AS (PARTITION BY t0, t1, variable, type)),
x AS (SELECT *, pos - a AS d, neg - b AS f, pos + neg AS t, a + b AS lo, pos + neg - a - b AS hi FROM r),
h AS (SELECT *, {_H.format('lo')} + {_H.format('hi')} AS hr, {_H.format('pos')} + {_H.format('neg')} AS hy, {_H.format('a')} + {_H.format('b')} + {_H.format('d')} + {_H.format('f')} AS hj FROM x WHERE hi > 0)
SELECT t0, t1, variable, type, upto, round((hr + hy - hj) / nullif((hr + hy) / 2, 0), 6) + 0.0 AS nmi FROM h""")
def mi_panel(spark, sf_dir):
    s, long, _ = mined(spark, sf_dir)
    return metrics.mi_panel(long, s.subjects).withColumn("nmi", r6("nmi"))


# ------------------------------------------------------------------------------------------------ filters

@query("filter_overall_abundance", f"WITH {ORDERS} SELECT variable, round(sum(value), 4) AS total FROM obs GROUP BY 1 HAVING sum(value) >= 0.04 * (SELECT sum(value) FROM obs) OR variable IN ('CHINA')")
def filter_overall_abundance(spark, sf_dir):
    s = orders_study(spark, sf_dir)
    least = 0.04 * (order_rows(spark, sf_dir).agg(F.sum("value")).first()[0] or 0.0)
    return filters.high_overall_abundance(s.observations, least, ("CHINA",)).withColumn("total", F.round("total", 4))


@query("filter_sample_depth", f"WITH {EVENTS} SELECT subject_id, time, round(sum(value), 6) AS depth FROM obs GROUP BY ALL HAVING sum(value) >= 100.0")
def filter_sample_depth(spark, sf_dir):
    return filters.deep_samples(events_study(spark, sf_dir).observations, 100.0).withColumn("depth", F.round("depth", 6))


@query("trim_window", f"WITH {EVENTS} SELECT * FROM obs WHERE time BETWEEN 5.0 AND 20.0")
def trim_window(spark, sf_dir):
    return filters.trim(events_study(spark, sf_dir).observations, 5.0, 20.0)


@query("filter_sample_density", f"""WITH {ORDERS}, {edge_sql(0.0, 2404.0, 4)}, blk AS (SELECT a.x AS t0, b.x AS t1 FROM edge a JOIN edge b ON b.i = a.i + 2),
n AS (SELECT s.subject_id, t0, count(m.time) AS n FROM subj s CROSS JOIN blk LEFT JOIN smp m ON m.subject_id = s.subject_id AND m.time BETWEEN t0 AND t1 GROUP BY ALL)
SELECT subject_id, min(n)::BIGINT AS fewest FROM n GROUP BY 1 HAVING min(n) >= 2""")
def filter_sample_density(spark, sf_dir):
    s = orders_study(spark, sf_dir)
    return filters.dense_subjects(s.subjects, s.samples, s.start, s.end, 4, 2, consecutive=2)


@query("filter_missing_outcome", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def filter_missing_outcome(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return filters.with_outcome(both, "quality").select("doc_id", "quality")


_RUNS = """, flag AS (SELECT *, value > 10.0 AS high FROM obs),
island AS (SELECT variable, subject_id, high, row_number() OVER w - sum(high::INT) OVER w AS island FROM flag WINDOW w AS (PARTITION BY variable, subject_id ORDER BY time)),
runs AS (SELECT variable, subject_id, island, count(*) FILTER (high) AS n FROM island GROUP BY ALL),
longest AS (SELECT variable, subject_id, max(n)::BIGINT AS longest FROM runs GROUP BY ALL)
"""


@query("longest_runs", f"WITH {EVENTS} {_RUNS} SELECT * FROM longest")
def longest_runs(spark, sf_dir):
    return filters.longest_runs(events_study(spark, sf_dir).observations, 10.0)


@query("filter_temporal_abundance", f"WITH {EVENTS} {_RUNS} SELECT variable, count(*) FILTER (longest >= 3)::BIGINT AS n_subjects FROM longest GROUP BY 1 HAVING count(*) FILTER (longest >= 3) >= 5")
def filter_temporal_abundance(spark, sf_dir):
    return filters.persistent_variables(events_study(spark, sf_dir).observations, 10.0, 3, 5)


@query("filter_low_variance_mad", "WITH m AS (SELECT event_type AS variable, median(value) AS m FROM events GROUP BY 1) SELECT variable, round(m, 6) AS median, round(median(abs(value - m)), 6) AS mad FROM events JOIN m ON event_type = variable GROUP BY variable, m HAVING median(abs(value - m)) >= 1.0")
def filter_low_variance_mad(spark, sf_dir):
    raw = event_rows(spark, sf_dir)
    return filters.varied_variables(raw, 1.0).select("variable", r6("median").alias("median"), r6("mad").alias("mad"))


@query("filter_top_variance", f"WITH {ORDERS}, v AS (SELECT variable, round(var_pop(value), 6) AS variance FROM obs GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY variance DESC)::BIGINT AS place, count(*) OVER () AS n FROM v) SELECT variable, variance, place FROM r WHERE place <= floor(n * 0.4)")
def filter_top_variance(spark, sf_dir):
    return filters.top_variance(orders_study(spark, sf_dir).observations, 0.4).select("variable", F.round("variance", 6).alias("variance"), F.col("place").cast("long").alias("place"))


@query("filter_spanning_subjects", f"WITH {ORDERS} SELECT subject_id, count(*)::BIGINT AS n, min(time) AS first, max(time) AS last FROM smp JOIN subj USING (subject_id) WHERE NOT y GROUP BY 1 HAVING count(*) >= 5 AND min(time) <= 300 AND max(time) >= 1800")
def filter_spanning_subjects(spark, sf_dir):
    s = orders_study(spark, sf_dir)
    return filters.spanning_subjects(s.subjects, s.samples, 300.0, 1800.0, 5)


@query("select_variables", f"WITH {ORDERS} SELECT * FROM obs WHERE variable IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def select_variables(spark, sf_dir):
    asia = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return filters.select_variables(orders_study(spark, sf_dir).observations, asia.select(F.col("n_name").alias("variable"))).select("subject_id", "time", "variable", "value")


@query("select_subjects_invert", f"WITH {EVENTS} SELECT * FROM obs WHERE subject_id NOT IN (SELECT subject_id FROM subj WHERE y)")
def select_subjects_invert(spark, sf_dir):
    s = events_study(spark, sf_dir)
    return filters.select_subjects(s.observations, s.subjects.where("y"), invert=True).select("subject_id", "time", "variable", "value")


# ------------------------------------------------------------------------------------------------ transforms

@query("relative_abundance", f"WITH {EVENTS} SELECT subject_id, time, variable, round(value / nullif(sum(value) OVER (PARTITION BY subject_id, time), 0), 6) + 0.0 AS value FROM obs")
def relative_abundance(spark, sf_dir):
    return transforms.relative_abundance(events_study(spark, sf_dir).observations).select("subject_id", "time", "variable", r6("value").alias("value"))


@query("internal_normalization", f"WITH {EVENTS} SELECT subject_id, time, variable, round(value / nullif(sum(CASE WHEN variable IN ('click', 'view') THEN value ELSE 0.0 END) OVER (PARTITION BY subject_id, time), 0), 6) + 0.0 AS value FROM obs")
def internal_normalization(spark, sf_dir):
    return transforms.internal_normalization(events_study(spark, sf_dir).observations, ("click", "view"), reject=None).select("subject_id", "time", "variable", r6("value").alias("value"))


@query("log_transform", f"WITH {EVENTS} SELECT subject_id, time, variable, round(ln(CASE WHEN value < 1e-10 THEN 1e-6 ELSE value END), 6) + 0.0 AS value FROM obs")
def log_transform(spark, sf_dir):
    return transforms.log_transform(events_study(spark, sf_dir).observations).select("subject_id", "time", "variable", r6("value").alias("value"))


@query("exponentiate", f"WITH {EVENTS} SELECT subject_id, time, variable, round(exp(value / 100.0), 6) + 0.0 AS value FROM obs")
def exponentiate(spark, sf_dir):
    obs = events_study(spark, sf_dir).observations.withColumn("value", F.col("value") / 100.0)
    return transforms.exponentiate(obs).select("subject_id", "time", "variable", r6("value").alias("value"))


@query("window_mean_features", f'WITH {EVENTS}, {edge_sql(0.0, 30.0, 5)}, blk AS (SELECT a.i AS "window", a.x AS t0, b.x AS t1 FROM edge a JOIN edge b ON b.i = a.i + 2) SELECT subject_id, "window"::BIGINT AS "window", variable, round(avg(value), 6) + 0.0 AS value FROM obs JOIN blk ON time BETWEEN t0 AND t1 GROUP BY ALL')
def window_mean_features(spark, sf_dir):
    means = transforms.window_means(events_study(spark, sf_dir).observations, 0.0, 30.0, 5, 2)
    return means.select("subject_id", F.col("window").cast("long").alias("window"), "variable", r6("value").alias("value"))


@query("sample_order", f"WITH {ORDERS} SELECT subject_id, time, (dense_rank() OVER (ORDER BY subject_id))::BIGINT AS subject_ord, (row_number() OVER (PARTITION BY subject_id ORDER BY time))::BIGINT AS sample_ord FROM smp")
def sample_order(spark, sf_dir):
    """Samples in time order within subjects, and subjects in order of id."""
    s = orders_study(spark, sf_dir)
    ids = numbered(s.samples.select("subject_id").distinct(), "subject_id").select("subject_id", (F.col("place") + 1).alias("subject_ord"))
    by = Window.partitionBy("subject_id").orderBy("time")
    return s.samples.withColumn("sample_ord", F.row_number().over(by).cast("long")).join(ids, "subject_id").select("subject_id", "time", "subject_ord", "sample_ord")


@query("subject_subsample", f"WITH {EVENTS}, r AS (SELECT subject_id, y, row_number() OVER (ORDER BY md5('1:' || subject_id::VARCHAR), subject_id) AS place, count(*) OVER () AS n FROM subj) SELECT subject_id, y FROM r WHERE 2 * place <= n")
def subject_subsample(spark, sf_dir):
    """A sampling operator: half of the subjects, drawn by a hash of their id."""
    return subsample.draw_subjects(events_study(spark, sf_dir).subjects.select("subject_id", "y"), 0.5, seed=1)


@query("subsample_timepoints", f"WITH {ORDERS}, o AS (SELECT subject_id, time, row_number() OVER (PARTITION BY subject_id ORDER BY time) AS sample_ord FROM smp) SELECT subject_id, time, sample_ord::BIGINT AS sample_ord FROM o WHERE sample_ord IN (1, 3, 5)")
def subsample_timepoints(spark, sf_dir):
    """The first, third and fifth sample of each subject: an explicit choice of time points."""
    by = Window.partitionBy("subject_id").orderBy("time")
    rows = orders_study(spark, sf_dir).samples.withColumn("sample_ord", F.row_number().over(by).cast("long"))
    return rows.where(F.col("sample_ord").isin(1, 3, 5))


@query("threshold_filter", f"""WITH {detector_sql()} SELECT t.t0, t.t1, t.variable, t.type, t.threshold FROM thr t JOIN long l USING (t0, t1, variable, type) GROUP BY ALL
HAVING median(l.value) FILTER (l.value > t.threshold) - median(l.value) FILTER (l.value <= t.threshold) >= 8.0""")
def threshold_filter(spark, sf_dir):
    """Thresholds whose sides differ by 8 or more in their medians."""
    _, long, cuts = mined(spark, sf_dir)
    return detectors.filter_thresholds(cuts, long, 8.0)


@query("detectors_for_outcome_classes", f"WITH {detector_sql()} SELECT t0, t1, variable, type, round(avg(value) FILTER (y), 8) + 0.0 AS positives, round(avg(value) FILTER (NOT y), 8) + 0.0 AS negatives FROM long JOIN subj USING (subject_id) GROUP BY ALL")
def detectors_for_outcome_classes(spark, sf_dir):
    s, long, _ = mined(spark, sf_dir)
    both = long.join(s.subjects, "subject_id").groupBy("t0", "t1", "variable", "type")
    return both.agg(r6(F.avg(F.when(F.col("y"), F.col("value"))), 8).alias("positives"), r6(F.avg(F.when(~F.col("y"), F.col("value"))), 8).alias("negatives"))
