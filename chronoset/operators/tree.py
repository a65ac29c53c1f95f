"""Trees over variables as edge tables (node, parent, dist), and their closures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoset.operators.ordering import numbered
from chronoset.sources.scratch import settle

#: Values of a range of samples, and names of nodes that are broadcast.
RANGE, NAMES = 200_000, 500_000


def closure(edges: DataFrame, most_depth: int = 64) -> DataFrame:
    """(ancestor, descendant, depth, path_len) for every node and itself and all its ancestors.

    Paths double in length with each round, so rounds grow with the logarithm of the depth. A cycle raises
    ValueError. ``path_len`` is the sum of ``dist`` between the two nodes.
    """
    edges = settle(edges.select("node", "parent", "dist"), "tree-edges")
    nodes = edges.select("node").union(edges.select("parent")).distinct()
    paths = edges.select(F.col("parent").alias("ancestor"), F.col("node").alias("descendant"), F.lit(1).alias("depth"), F.col("dist").alias("path_len"))
    reach = 1
    while True:
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.descendant") == F.col("b.ancestor")).select(
            "a.ancestor", "b.descendant", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.path_len") + F.col("b.path_len")).alias("path_len"))
        longer = longer.where((F.col("depth") > reach) & (F.col("depth") <= 2 * reach)).dropDuplicates(["ancestor", "descendant"])
        longer = settle(longer, "tree-paths")
        if longer.isEmpty():
            break
        paths, reach = paths.unionByName(longer), 2 * reach
        if reach > 2 * most_depth:
            raise ValueError("the tree is deeper than expected, or has a cycle")
    own = nodes.select(F.col("node").alias("ancestor"), F.col("node").alias("descendant"), F.lit(0).alias("depth"), F.lit(0.0).alias("path_len"))
    return own.unionByName(paths)


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select("node").join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def aggregate(obs: DataFrame, edges: DataFrame, paths: DataFrame, root: bool = False) -> DataFrame:
    """Observations with a row for every node above the leaves: the sum of its leaves in the sample.

    Variables outside the tree pass through, as do leaves; the root is left out unless asked for. Leaves are joined
    to their ancestors, of which there are as many as the tree is deep.
    """
    below = paths.where(F.col("depth") > 0).select(F.col("ancestor").alias("node"), F.col("descendant").alias("variable"))
    if not root:
        below = below.join(edges.select("node"), "node", "left_semi")
    sums = obs.join(below, "variable").groupBy("subject_id", "time", "node").agg(F.sum("value").alias("value"))
    return obs.select("subject_id", "time", "variable", "value").unionByName(sums.withColumnRenamed("node", "variable"))


def prune(edges: DataFrame, paths: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges of the tree of targets (node), the root, and common ancestors that branch; branch lengths add up."""
    t = targets.select(F.col("node").alias("target"))
    hit = paths.join(t, F.col("descendant") == F.col("target"))
    child = edges.select(F.col("parent").alias("up"), F.col("node").alias("down"))
    # children of a node whose subtree holds a target
    busy = hit.select(F.col("ancestor").alias("down")).distinct().join(child, "down").groupBy("up").agg(F.count(F.lit(1)).alias("n"))
    tops = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    kept = busy.where(F.col("n") >= 2).select(F.col("up").alias("node")).union(t.select(F.col("target").alias("node"))).union(tops).distinct()
    up = paths.where(F.col("depth") > 0).join(kept.withColumnRenamed("node", "descendant"), "descendant", "left_semi").join(kept.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    near = up.groupBy("descendant").agg(F.min_by(F.struct("ancestor", "path_len"), "depth").alias("p"))
    return near.select(F.col("descendant").alias("node"), F.col("p.ancestor").alias("parent"), F.col("p.path_len").alias("dist"))


def subtree_lengths(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, length): all branch lengths below a node and its own; the root has none of its own."""
    d = edges.select(F.col("node").alias("descendant"), "dist")
    return paths.join(d, "descendant").groupBy(F.col("ancestor").alias("node")).agg(F.sum("dist").alias("length"))


def similarities(paths: DataFrame) -> DataFrame:
    """(a, b, similarity): 0.5 to the number of levels between a node and its ancestors, both ways; 1 for itself."""
    s = F.pow(F.lit(0.5), F.col("depth"))
    down = paths.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"), s.alias("similarity"))
    up = paths.where(F.col("depth") > 0).select(F.col("descendant").alias("a"), F.col("ancestor").alias("b"), s.alias("similarity"))
    return down.unionByName(up)


def node_priors(edges: DataFrame, paths: DataFrame, shape: float, scale: float) -> DataFrame:
    """(node, prior): the gamma density of subtree length over its median among leaves' root distances; root 0."""
    tops = edges.select(F.col("parent").alias("ancestor")).distinct().join(edges.select(F.col("node").alias("ancestor")), "ancestor", "left_anti")
    root_distance = paths.join(tops, "ancestor", "left_semi").join(leaves(edges).withColumnRenamed("node", "descendant"), "descendant", "left_semi")
    middle = root_distance.agg(F.median("path_len").alias("middle"))
    lengths = subtree_lengths(edges, paths).join(edges.select("node"), "node", "left_semi").crossJoin(F.broadcast(middle))
    x = F.col("length") / F.col("middle")
    raw = F.when(x > 0, F.pow(x, F.lit(shape - 1)) * F.exp(-x / scale)).otherwise(0.0)
    weighed = lengths.select("node", raw.alias("raw"))
    out = weighed.select("node", F.try_divide("raw", F.sum("raw").over(Window.partitionBy())).alias("prior"))
    return out.unionByName(tops.select(F.col("ancestor").alias("node"), F.lit(0.0).alias("prior")))


def surplus_nodes(edges: DataFrame, paths: DataFrame, present: DataFrame) -> DataFrame:
    """Inner nodes other than the root that keep fewer than two children once the tree is cut to present leaves."""
    kept = leaves(edges).join(present.select("node"), "node", "left_semi")
    hit = paths.join(kept.withColumnRenamed("node", "descendant"), "descendant", "left_semi").select(F.col("ancestor").alias("down")).distinct()
    n = hit.join(edges.select(F.col("node").alias("down"), F.col("parent").alias("up")), "down").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    inner = edges.select("node").join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
    return inner.join(n, "node", "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long")).where(F.col("children") < 2)


def common_ancestors(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, node): the deepest node above all members of each group (group, member)."""
    size = groups.groupBy("group").agg(F.countDistinct("member").alias("size"))
    held = groups.distinct().join(paths, F.col("member") == F.col("descendant")).groupBy("group", "ancestor").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("far"))
    full = held.join(size, "group").where(F.col("n") == F.col("size"))
    return full.groupBy("group").agg(F.min_by("ancestor", F.struct("far", "ancestor")).alias("node"))


def leaf_table(edges: DataFrame, paths: DataFrame, variables: DataFrame) -> DataFrame:
    """(variable, leaves): the space-joined leaves below each variable; empty for a leaf, a remark outside the tree."""
    ends = leaves(edges).withColumnRenamed("node", "descendant")
    per = paths.join(ends, "descendant", "left_semi").groupBy(F.col("ancestor").alias("variable")).agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("depth") > 0, F.col("descendant")))), " ").alias("leaves"))
    return variables.select("variable").join(per, "variable", "left").withColumn("leaves", F.coalesce("leaves", F.lit("(not in variable tree)")))


def consensus(paths: DataFrame, taxonomy: DataFrame, ranks: tuple[str, ...]) -> DataFrame:
    """(node, label): the values of the leading ranks on which all described leaves below a node agree.

    ``taxonomy`` holds leaf and a column for each rank, coarsest first. Labels stop at the first rank with more than
    one value.
    """
    t = taxonomy.select("leaf", *ranks)
    values = [F.sort_array(F.collect_set(r)).alias(r) for r in ranks]
    per = paths.join(t, F.col("descendant") == F.col("leaf")).groupBy(F.col("ancestor").alias("node")).agg(*values, F.count(F.lit(1)).alias("n_leaves"))
    agreed, open_ = [], F.lit(True)
    for r in ranks:
        open_ = open_ & (F.size(r) == 1)
        agreed.append(F.when(open_, F.element_at(r, 1)))
    return per.select("node", F.array_join(F.array_compact(F.array(*agreed)), " ").alias("label"), "n_leaves")


def layout(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, x, y, height) for drawing: x is the root distance, leaves stand in order, an inner node between its ends.

    The middle of a node's children is not that of its leaves, so y goes up level by level, once for each level.
    """
    tops = edges.select(F.col("parent").alias("ancestor")).distinct().join(edges.select(F.col("node").alias("ancestor")), "ancestor", "left_anti")
    place = paths.join(tops, "ancestor", "left_semi").select(F.col("descendant").alias("node"), F.col("path_len").alias("x"), F.col("depth").alias("level"))
    done = numbered(leaves(edges), "node").select("node", F.col("place").cast("double").alias("y"), F.lit(0.0).alias("height"))
    place, edges = settle(place, "layout-places"), settle(edges, "layout-edges")
    deepest = place.agg(F.max("level")).first()[0] or 0
    for level in range(deepest - 1, -1, -1):
        here = place.where(F.col("level") == level).select(F.col("node").alias("parent"))
        spans = edges.join(here, "parent", "left_semi").join(done, "node").groupBy("parent").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
        spans = settle(spans.select(F.col("parent").alias("node"), ((F.col("lo") + F.col("hi")) / 2).alias("y"), (F.col("hi") - F.col("lo")).alias("height")), "layout-level")
        done = done.unionByName(spans)
    return place.join(done, "node").select("node", "x", "y", "height")


def best_placements(placements: DataFrame, paths: DataFrame) -> DataFrame:
    """(sequence, node, pendant): the edge with more than half of the likelihood, the last one if there are several;
    else the ancestor with the smallest sum above one half, ties to the smaller name.

    ``placements`` holds sequence, edge, lwr and pendant, rows of a sequence in ascending order of (lwr, edge).
    """
    sure = placements.where(F.col("lwr") > 0.5).groupBy("sequence").agg(F.max_by("edge", F.struct("lwr", "edge")).alias("sure"))
    sums = placements.join(paths, F.col("edge") == F.col("descendant")).groupBy("sequence", "ancestor").agg(F.round(F.sum("lwr"), 9).alias("mass"))
    wide = sums.where(F.col("mass") > 0.5).groupBy("sequence").agg(F.min_by("ancestor", F.struct("mass", "ancestor")).alias("wide"))
    pendant = placements.groupBy("sequence").agg(F.sum(F.col("lwr") * F.col("pendant")).alias("pendant"))
    return pendant.join(sure, "sequence", "left").join(wide, "sequence", "left").select("sequence", F.coalesce("sure", "wide").alias("node"), "pendant")


def placement_weights(placements: DataFrame, paths: DataFrame) -> DataFrame:
    """(sequence, node, probability): the likelihood of all placements in a node's subtree."""
    return placements.join(paths, F.col("edge") == F.col("descendant")).groupBy("sequence", F.col("ancestor").alias("node")).agg(F.sum("lwr").alias("probability"))


def placement_pruned(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the tree cut to the placements' nodes, the root, and common ancestors that branch."""
    return prune(edges, closure(edges), placements.select(F.col("edge").alias("node")).distinct())


def _weighted_sums(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(subject_id, time, variable, value): for each sample and node the sum of values, each times the node's probability.

    Samples are cut in ranges, each of which gets the list of nodes of each of its variables once, and multiplies there.
    Neither the products nor the sums, of which a sample has as many as its variables have nodes, are shuffled.
    """
    spark = values.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-values.count() // RANGE))  # few ranges, as each gets its own lists
    ranged = settle(values.repartitionByRange(n, "subject_id", "time").withColumn("part", F.spark_partition_id()), "placement-ranges")
    nodes = numbered(weights.select("node").distinct(), "node", name="code")
    coded = weights.join(F.broadcast(nodes) if nodes.count() <= NAMES else nodes, "node")
    lists = coded.groupBy("sequence").agg(F.collect_list(F.struct(F.col("code").cast("int").alias("code"), "probability")).alias("l"))  # one variable's nodes
    asked = ranged.select("part", F.col("variable").alias("sequence")).distinct().join(lists, "sequence")
    kinds = {c: values.schema[c].dataType.simpleString() for c in ("subject_id", "time")}
    none = lambda kind: F.lit(None).cast(kind)
    first = asked.select("part", F.lit(0).alias("row"), F.col("sequence").alias("variable"), F.col("l.code").alias("codes"), F.col("l.probability").alias("shares"), *[none(k).alias(c) for c, k in kinds.items()], none("double").alias("value"))
    then = ranged.select("part", F.lit(1).alias("row"), "variable", none("array<int>").alias("codes"), none("array<double>").alias("shares"), *kinds, F.col("value").cast("double").alias("value"))
    stream = first.unionByName(then).repartition(n, "part").sortWithinPartitions("part", "row", *kinds)
    out = stream.mapInArrow(_multiplied, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", code bigint, value double")
    return out.join(F.broadcast(nodes) if nodes.count() <= NAMES else nodes, "code").select("subject_id", "time", F.col("node").alias("variable"), "value")


def _multiplied(batches):
    """Sums by sample and node of rows in order of part: first the lists of its variables, then its samples in order."""
    part, lists, table, rest = None, [], None, None

    def sums(rows: pa.Table) -> pa.RecordBatch:
        at, ends, codes, shares = table
        which = at.get_indexer(rows.column("variable").to_pandas())
        size = np.where(which < 0, 0, ends[which + 1] - ends[which])
        if not size.any():
            return pa.RecordBatch.from_pylist([], pa.schema([*(rows.schema.field(c) for c in ("subject_id", "time")), ("code", pa.int64()), ("value", pa.float64())]))
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - ends[which], size)
        value = rows.column("value").to_numpy()  # nulls as NaN
        known = np.repeat(np.asarray(rows.column("value").is_valid()), size)
        sample = np.cumsum(_starts(rows)) - 1
        keys = np.repeat(sample, size) * (int(codes.max(initial=0)) + 1) + codes[flat]
        order = np.argsort(keys, kind="stable")
        begins = np.nonzero(np.diff(keys[order], prepend=-1))[0]
        total = np.add.reduceat(np.where(known, np.repeat(value, size) * shares[flat], 0.0)[order], begins)
        of = np.repeat(np.arange(len(size)), size)[order][begins]
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().take(pa.array(of)) for c in ("subject_id", "time")), pa.array(codes[flat][order][begins].astype(np.int64)), pa.array(total, mask=~np.logical_or.reduceat(known[order], begins))], ["subject_id", "time", "code", "value"])

    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            some = batch.slice(k, 4096)
            parts, row = some.column("part").to_numpy(), some.column("row").to_numpy()
            cuts = [0, *(np.nonzero(np.diff(parts.astype(np.int64) * 2 + row))[0] + 1), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                piece = some.slice(a, b - a)
                if parts[a] != part:
                    if rest is not None:
                        yield sums(rest)
                    part, lists, table, rest = parts[a], [], None, None
                if row[a] == 0:
                    lists.append((piece.column("variable").to_pandas(), np.diff(piece.column("codes").offsets.to_numpy()), piece.column("codes").flatten().to_numpy(), piece.column("shares").flatten().to_numpy()))
                    continue
                if table is None and not lists:
                    continue
                if table is None:
                    name, size, codes, shares = (np.concatenate(x) for x in zip(*lists, strict=True))
                    table, lists = (pd.Index(name), np.concatenate([[0], np.cumsum(size)]), codes, shares), []
                rows = pa.Table.from_batches([piece.select(["variable", "value", "subject_id", "time"])])
                rows = rows if rest is None else pa.concat_tables([rest, rows])
                last = int(np.nonzero(_starts(rows))[0][-1])  # the last sample may go on
                if last:
                    yield sums(rows.slice(0, last))
                rest = rows.slice(last)
    if rest is not None:
        yield sums(rest)


def _starts(rows: pa.Table) -> np.ndarray:
    """Whether a row begins a new sample."""
    new = np.zeros(rows.num_rows, bool)
    for c in ("subject_id", "time"):
        x = rows.column(c).to_pandas()
        new |= ((x != x.shift()) & ~(x.isna() & x.shift().isna())).to_numpy()
    new[0] = True
    return new


def aggregate_by_placements(obs: DataFrame, placements: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, lengths): observations with a row for every node that a variable may descend from, and the
    weights of variables and nodes.

    ``placements`` has sequence, edge, lwr and pendant. A node's value in a sample is the sum of its variables' values,
    each times the likelihood that the node is its ancestor: the product of the sparse matrices of observations,
    placements and closure, of which placements and closure meet first. A node's length is that of its subtree, its own
    branch and the mean pendant branch of each edge in it, by likelihood, included; a variable's is its mean
    pendant branch. A variable that is not placed, or a node named as a variable, raises ValueError.
    """
    values = settle(obs.groupBy("subject_id", "time", "variable").agg(F.sum("value").alias("value")), "placement-values")
    seen = values.select(F.col("variable").alias("sequence")).distinct()
    lost = seen.join(placements, "sequence", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"not placed: {', '.join(str(r[0]) for r in lost)}")
    placed = settle(placements.join(seen, "sequence", "left_semi"), "placements")
    cut = settle(placement_pruned(placed, edges), "placement-tree")
    paths = settle(closure(cut), "placement-paths")
    weights = settle(placement_weights(placed, paths), "placement-weights")
    if not weights.join(seen.withColumnRenamed("sequence", "node"), "node", "left_semi").isEmpty():
        raise ValueError("nodes of the tree are named as variables")
    sums = _weighted_sums(values, weights)
    mean_pendant = F.sum(F.col("lwr") * F.col("pendant")) / F.sum("lwr")
    on_edge = placed.groupBy(F.col("edge").alias("descendant")).agg(mean_pendant.alias("pendant"))
    own = paths.select("descendant").distinct().join(cut.select(F.col("node").alias("descendant"), "dist"), "descendant", "left").join(on_edge, "descendant", "left")
    own = own.select("descendant", (F.coalesce("dist", F.lit(0.0)) + F.coalesce("pendant", F.lit(0.0))).alias("own"))
    lengths = paths.join(own, "descendant").groupBy(F.col("ancestor").alias("variable")).agg(F.sum("own").alias("weight"))
    lengths = lengths.unionByName(placed.groupBy(F.col("sequence").alias("variable")).agg(mean_pendant.alias("weight")))
    return obs.select("subject_id", "time", "variable", "value").unionByName(sums), lengths


def peaks(obs: DataFrame, clades: DataFrame) -> DataFrame:
    """(clade, subject_id, peak): the largest share of a sample that the members of ``clades`` (clade, member) make up,
    over the subject's samples. Samples that sum to 0 have no shares."""
    sums = obs.join(clades, F.col("variable") == F.col("member")).groupBy("clade", "subject_id", "time").agg(F.sum("value").alias("value"))
    totals = obs.groupBy("subject_id", "time").agg(F.sum("value").alias("total"))
    return sums.join(totals, ["subject_id", "time"]).groupBy("clade", "subject_id").agg(F.max(F.try_divide(F.col("value"), F.col("total"))).alias("peak"))


def clades_by_peak(obs: DataFrame, clades: DataFrame, least: float, most: float, most_members: int) -> DataFrame:
    """(clade, n_members, lowest, highest): clades of at most ``most_members`` members whose peak lies between
    ``least`` and ``most`` in every subject."""
    sizes = clades.groupBy("clade").agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") <= most_members)
    found = peaks(obs, clades.join(sizes.select("clade"), "clade", "left_semi")).groupBy("clade").agg(F.min("peak").alias("lowest"), F.max("peak").alias("highest"))
    return found.where((F.col("lowest") >= least) & (F.col("highest") <= most)).join(sizes, "clade").select("clade", "n_members", "lowest", "highest")
