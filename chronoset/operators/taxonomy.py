"""Names of variables and tree nodes from taxonomies and placement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoset.operators import tree

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
NOTHING = "(unclassifiable sequence)"


def lineages(sequences: DataFrame, taxa: DataFrame) -> DataFrame:
    """Reference sequences (seqname, tax_id) with the lineage of their taxon (tax_id, ranks)."""
    return sequences.join(taxa, "tax_id")


def groups_at(lineage: DataFrame, rank: str, check_rank: str | None = None) -> DataFrame:
    """(group, member): the leaves of each taxon at a rank; with ``check_rank`` only taxa of several values there."""
    rows = lineage.where(F.col(rank).isNotNull()).select(F.col(rank).alias("group"), F.col("seqname").alias("member"), *([F.col(check_rank).alias("check")] if check_rank else []))
    if check_rank is None:
        return rows
    several = rows.groupBy("group").agg(F.countDistinct("check").alias("n")).where(F.col("n") > 1)
    return rows.join(several.select("group"), "group", "left_semi").select("group", "member")


def rank_lengths(edges: DataFrame, paths: DataFrame, lineage: DataFrame, rank: str) -> DataFrame:
    """(group, node, length): the subtree length of each taxon's common ancestor."""
    return tree.common_ancestors(paths, groups_at(lineage, rank)).join(tree.subtree_lengths(edges, paths), "node").select("group", "node", "length")


def finest(ranks: tuple[str, ...] = RANKS) -> Column:
    """'Genus species' if both are known, else the finest known rank, else a remark."""
    pair = F.when(F.col(ranks[-1]).isNotNull() & F.col(ranks[-2]).isNotNull(), F.concat_ws(" ", F.col(ranks[-2]), F.col(ranks[-1])))
    return F.coalesce(pair, *[F.col(r) for r in reversed(ranks)], F.lit(NOTHING))


def from_table(placement: DataFrame, paths: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """(variable, label): leaves by their finest known rank, inner nodes by the leading ranks their leaves agree on,
    with the number of leaves; leaves without any rank do not count for the agreement.

    ``placement`` holds leaf and the ranks, coarsest first.
    """
    leaf = placement.select(F.col("leaf").alias("variable"), finest(ranks).alias("label"))
    known = placement.where(F.coalesce(*[F.col(r) for r in ranks]).isNotNull())
    inner = tree.consensus(paths.where(F.col("depth") > 0), known, ranks)
    text = F.concat(F.when(F.col("label") == "", "(unclassifiable)").otherwise(F.col("label")), F.lit(" ("), F.col("n_leaves").cast("string"), F.lit(" leaves)"))
    return leaf.unionByName(inner.select(F.col("node").alias("variable"), text.alias("label")))


def from_placements(assigned: DataFrame, node_labels: DataFrame) -> DataFrame:
    """(variable, label) of placed sequences (sequence, node): 'OTU mapped to' the label of their node."""
    rows = assigned.join(node_labels.select("node", F.col("label").alias("parent_label")), "node", "left")
    return rows.select(F.col("sequence").alias("variable"), F.concat(F.lit("OTU mapped to "), F.coalesce("parent_label", "node")).alias("label"))


def hybrid(placement: DataFrame, assigned: DataFrame, node_labels: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """(variable, label): inner nodes by ``node_labels`` (node, label); leaves by ``placement`` (leaf, ranks) if it names
    their species, else by the node they are ``assigned`` to (sequence, node)."""
    species = placement.where(F.col(ranks[-1]).isNotNull()).select(F.col("leaf").alias("variable"), finest(ranks).alias("own"))
    leaves = from_placements(assigned, node_labels).join(species, "variable", "left").select("variable", F.coalesce("own", "label").alias("label"))
    return leaves.unionByName(node_labels.select(F.col("node").alias("variable"), "label"))
