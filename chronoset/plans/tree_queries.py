"""Queries on trees, with their SQL. The tree is supplier, nation, region, world; suppliers grow with the data."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoset.operators import taxonomy, tree
from chronoset.sources.studies import nation_tree, orders_study, r6, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def supplier_tree(spark, sf_dir) -> DataFrame:
    """edges(node, parent, dist) of suppliers below nations, regions and the world."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_name").alias("node"), F.col("n_name").alias("parent"), (1.0 + F.col("s_suppkey") % 3).cast("double").alias("dist"))
    return s.unionByName(nation_tree(spark, sf_dir))


TREE = """
edge AS (
  SELECT s_name AS node, n_name AS parent, (1.0 + s_suppkey % 3)::DOUBLE AS dist FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name, 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'world', 1.0 FROM region),
paths AS (
  SELECT node AS ancestor, node AS descendant, 0 AS depth, 0.0::DOUBLE AS path_len FROM (SELECT node FROM edge UNION SELECT parent FROM edge)
  UNION ALL SELECT parent, node, 1, dist FROM edge
  UNION ALL SELECT b.parent, a.node, 2, a.dist + b.dist FROM edge a JOIN edge b ON a.parent = b.node
  UNION ALL SELECT c.parent, a.node, 3, a.dist + b.dist + c.dist FROM edge a JOIN edge b ON a.parent = b.node JOIN edge c ON b.parent = c.node),
leaf AS (SELECT node FROM edge WHERE node NOT IN (SELECT parent FROM edge))
"""

ORDERS_BY_NATION = """
raw AS (
  SELECT o_custkey AS subject_id, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS time, n_name AS variable, n_regionkey, l_quantity AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


def closed(spark, sf_dir):
    edges = supplier_tree(spark, sf_dir)
    return edges, tree.closure(edges)


@query("tree_closure", f"WITH {TREE} SELECT ancestor, descendant, depth::BIGINT AS depth, path_len FROM paths")
def tree_closure(spark, sf_dir):
    return closed(spark, sf_dir)[1].withColumn("depth", F.col("depth").cast("long"))


@query("tree_aggregate", f"""WITH {ORDERS_BY_NATION},
smp AS (SELECT DISTINCT subject_id, time FROM raw),
names AS (SELECT n_name AS variable, n_name AS leaf FROM nation UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
sums AS (SELECT subject_id, time, variable AS leaf, round(sum(value), 6) AS value FROM raw GROUP BY ALL),
tops AS (SELECT DISTINCT variable FROM names)
SELECT s.subject_id, s.time, t.variable, round(coalesce(sum(x.value), 0.0), 6) + 0.0 AS value
FROM smp s CROSS JOIN tops t LEFT JOIN (SELECT subject_id, time, n.variable, sums.value FROM sums JOIN names n USING (leaf)) x
  ON x.subject_id = s.subject_id AND x.time = s.time AND x.variable = t.variable GROUP BY s.subject_id, s.time, t.variable""")
def tree_aggregate(spark, sf_dir):
    """Observations of nations with the sums of regions."""
    s = orders_study(spark, sf_dir)
    out = tree.aggregate(s.observations, s.edges, tree.closure(s.edges))
    return out.select("subject_id", "time", "variable", r6("value").alias("value"))


def _rich(spark, sf_dir):
    """The suppliers with a balance above the average: the targets of pruning."""
    s = table(spark, sf_dir, "supplier")
    mean = s.agg(F.avg("s_acctbal").alias("mean"))
    return s.crossJoin(F.broadcast(mean)).where(F.col("s_acctbal") > 1.8 * F.col("mean")).select(F.col("s_name").alias("node"))


RICH = "rich AS (SELECT s_name AS node FROM supplier WHERE s_acctbal > 1.8 * (SELECT avg(s_acctbal) FROM supplier))"


@query("tree_prune", f"""WITH {TREE}, {RICH},
busy AS (SELECT parent AS node FROM edge WHERE node IN (SELECT ancestor FROM paths WHERE descendant IN (SELECT node FROM rich)) GROUP BY parent HAVING count(*) >= 2),
kept AS (SELECT node FROM busy UNION SELECT node FROM rich UNION SELECT 'world')
SELECT descendant AS node, arg_min(ancestor, depth) AS parent, arg_min(path_len, depth) AS dist FROM paths WHERE depth > 0 AND descendant IN (SELECT node FROM kept) AND ancestor IN (SELECT node FROM kept) GROUP BY descendant""")
def tree_prune(spark, sf_dir):
    edges, paths = closed(spark, sf_dir)
    return tree.prune(edges, paths, _rich(spark, sf_dir))


@query("tree_subtree_length", f"WITH {TREE} SELECT ancestor AS node, round(sum(dist), 6) AS length FROM paths JOIN edge ON descendant = node GROUP BY 1")
def tree_subtree_length(spark, sf_dir):
    return tree.subtree_lengths(*closed(spark, sf_dir)).withColumn("length", F.round("length", 6))


@query("tree_similarity", f"WITH {TREE} SELECT ancestor AS a, descendant AS b, pow(0.5, depth) AS similarity FROM paths UNION ALL SELECT descendant, ancestor, pow(0.5, depth) FROM paths WHERE depth > 0")
def tree_similarity(spark, sf_dir):
    return tree.similarities(closed(spark, sf_dir)[1])


@query("tree_node_prior", f"""WITH {TREE},
mid AS (SELECT median(path_len) AS m FROM paths WHERE ancestor = 'world' AND descendant IN (SELECT node FROM leaf)),
len AS (SELECT ancestor AS node, sum(dist) / (SELECT m FROM mid) AS x FROM paths JOIN edge ON descendant = edge.node WHERE ancestor <> 'world' GROUP BY 1),
raw AS (SELECT node, CASE WHEN x > 0 THEN pow(x, 1.0) * exp(-x / 1.5) ELSE 0 END AS raw FROM len)
SELECT node, round(raw / (SELECT sum(raw) FROM raw), 9) + 0.0 AS prior FROM raw UNION ALL SELECT 'world', 0.0""")
def tree_node_prior(spark, sf_dir):
    return tree.node_priors(*closed(spark, sf_dir), 2.0, 1.5).withColumn("prior", r6("prior", 9))


@query("tree_surplus_nodes", f"""WITH {TREE}, {RICH},
hit AS (SELECT DISTINCT ancestor AS node FROM paths WHERE descendant IN (SELECT node FROM rich)),
n AS (SELECT parent AS node, count(*) AS children FROM edge JOIN hit USING (node) GROUP BY 1)
SELECT node, coalesce(children, 0)::BIGINT AS children FROM edge LEFT JOIN n USING (node) WHERE node IN (SELECT parent FROM edge) AND coalesce(children, 0) < 2""")
def tree_surplus_nodes(spark, sf_dir):
    edges, paths = closed(spark, sf_dir)
    return tree.surplus_nodes(edges, paths, _rich(spark, sf_dir))


@query("tree_lca_by_group", f"""WITH {TREE}, g AS (SELECT DISTINCT l_partkey % 97 AS "group", s_name AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
size AS (SELECT "group", count(*) AS size FROM g GROUP BY 1),
held AS (SELECT "group", ancestor, count(*) AS n, max(depth) AS far FROM g JOIN paths ON member = descendant GROUP BY 1, 2)
SELECT "group", arg_min(ancestor, (far, ancestor)) AS node FROM held JOIN size USING ("group") WHERE n = size GROUP BY 1""")
def tree_lca_by_group(spark, sf_dir):
    """The common ancestor of the suppliers of each group of parts."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    groups = lines.select((F.col("l_partkey") % 97).alias("group"), F.col("s_name").alias("member")).distinct()
    return tree.common_ancestors(closed(spark, sf_dir)[1], groups)


@query("variable_leaf_table", f"""WITH {TREE}, v AS (SELECT node AS variable FROM edge UNION ALL SELECT DISTINCT p_brand FROM part),
per AS (SELECT ancestor AS variable, coalesce(string_agg(DISTINCT descendant, ' ' ORDER BY descendant) FILTER (depth > 0), '') AS leaves FROM paths WHERE descendant IN (SELECT node FROM leaf) GROUP BY 1)
SELECT variable, coalesce(leaves, '(not in variable tree)') AS leaves FROM v LEFT JOIN per USING (variable)""")
def variable_leaf_table(spark, sf_dir):
    edges, paths = closed(spark, sf_dir)
    variables = edges.select(F.col("node").alias("variable")).union(table(spark, sf_dir, "part").select("p_brand").distinct())
    return tree.leaf_table(edges, paths, variables)


@query("annotate_nodes", f"""WITH {TREE}, tax AS (SELECT s_name AS leaf, r_name AS a, n_name AS b, 'K' || (s_suppkey % 2) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
per AS (SELECT ancestor AS node, count(DISTINCT a) AS na, min(a) AS a, count(DISTINCT b) AS nb, min(b) AS b, count(DISTINCT c) AS nc, min(c) AS c, count(*) AS n_leaves FROM paths JOIN tax ON descendant = leaf GROUP BY 1)
SELECT node, concat_ws(' ', CASE WHEN na = 1 THEN a END, CASE WHEN na = 1 AND nb = 1 THEN b END, CASE WHEN na = 1 AND nb = 1 AND nc = 1 THEN c END) AS label, n_leaves::BIGINT AS n_leaves FROM per""")
def annotate_nodes(spark, sf_dir):
    """Nodes described by the leading ranks on which their leaves agree."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tax = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    tax = tax.select(F.col("s_name").alias("leaf"), F.col("r_name").alias("a"), F.col("n_name").alias("b"), F.concat(F.lit("K"), (F.col("s_suppkey") % 2).cast("string")).alias("c"))
    return tree.consensus(closed(spark, sf_dir)[1], tax, ("a", "b", "c"))


@query("tree_layout", f"""WITH {TREE},
y3 AS (SELECT node, (row_number() OVER (ORDER BY node) - 1)::DOUBLE AS y, 0.0::DOUBLE AS height FROM leaf),
y2 AS (SELECT parent AS node, (min(y) + max(y)) / 2 AS y, max(y) - min(y) AS height FROM y3 JOIN edge USING (node) WHERE parent IN (SELECT n_name FROM nation) GROUP BY 1),
d2 AS (SELECT * FROM y3 UNION ALL SELECT * FROM y2),
y1 AS (SELECT parent AS node, (min(y) + max(y)) / 2 AS y, max(y) - min(y) AS height FROM d2 JOIN edge USING (node) WHERE parent IN (SELECT r_name FROM region) GROUP BY 1),
d1 AS (SELECT * FROM d2 UNION ALL SELECT * FROM y1),
y0 AS (SELECT parent AS node, (min(y) + max(y)) / 2 AS y, max(y) - min(y) AS height FROM d1 JOIN edge USING (node) WHERE parent = 'world' GROUP BY 1),
d0 AS (SELECT * FROM d1 UNION ALL SELECT * FROM y0)
SELECT node, path_len AS x, y, height FROM d0 JOIN paths ON descendant = node AND ancestor = 'world'""")
def tree_layout(spark, sf_dir):
    return tree.layout(*closed(spark, sf_dir))


@query("placement_assignment", f"""WITH {TREE}, p AS (
  SELECT l_partkey AS sequence, s_name AS edge, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_partkey) AS lwr, round(avg(l_discount), 6) AS pendant
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
sure AS (SELECT sequence, arg_max(edge, (lwr, edge)) AS node FROM p WHERE lwr > 0.5 GROUP BY 1),
mass AS (SELECT sequence, ancestor, round(sum(lwr), 9) AS mass FROM p JOIN paths ON edge = descendant GROUP BY 1, 2),
wide AS (SELECT sequence, arg_min(ancestor, (mass, ancestor)) AS node FROM mass WHERE mass > 0.5 GROUP BY 1)
SELECT p.sequence, coalesce(any_value(sure.node), any_value(wide.node)) AS node, round(sum(lwr * pendant), 9) + 0.0 AS pendant FROM p LEFT JOIN sure USING (sequence) LEFT JOIN wide USING (sequence) GROUP BY p.sequence""")
def placement_assignment(spark, sf_dir):
    """Parts placed on the supplier tree, with shares of quantity as likelihoods."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    p = lines.groupBy(F.col("l_partkey").alias("sequence"), F.col("s_name").alias("edge")).agg(F.sum("l_quantity").alias("q"), F.round(F.avg("l_discount"), 6).alias("pendant"))
    p = p.withColumn("lwr", F.col("q") / F.sum("q").over(Window.partitionBy("sequence"))).drop("q")
    return tree.best_placements(p, closed(spark, sf_dir)[1]).withColumn("pendant", r6("pendant", 9))




_LINEAGE = "lin AS (SELECT s_name AS seqname, r_name AS family, n_name AS genus, 'K' || (s_suppkey % 4) AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def lineage(spark, sf_dir):
    """Suppliers as reference sequences: regions are families, nations genera, and a key modulo 4 the species."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    taxa = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("tax_id"), F.col("r_name").alias("family"), F.col("n_name").alias("genus"))
    seqs = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("seqname"), F.col("s_nationkey").alias("tax_id"), F.concat(F.lit("K"), (F.col("s_suppkey") % 4).cast("string")).alias("species"))
    return taxonomy.lineages(seqs, taxa)


@query("taxon_groups", f"WITH {_LINEAGE} SELECT genus AS \"group\", seqname AS member FROM lin WHERE genus IN (SELECT genus FROM lin GROUP BY 1 HAVING count(DISTINCT species) > 1)")
def taxon_groups(spark, sf_dir):
    return taxonomy.groups_at(lineage(spark, sf_dir), "genus", "species")


@query("taxon_lengths", f"""WITH {TREE}, {_LINEAGE},
size AS (SELECT family, count(*) AS size FROM lin GROUP BY 1),
held AS (SELECT family, ancestor, count(*) AS n, max(depth) AS far FROM lin JOIN paths ON seqname = descendant GROUP BY 1, 2),
lca AS (SELECT family, arg_min(ancestor, (far, ancestor)) AS node FROM held JOIN size USING (family) WHERE n = size GROUP BY 1),
len AS (SELECT ancestor AS node, sum(dist) AS length FROM paths JOIN edge ON descendant = edge.node GROUP BY 1)
SELECT family AS "group", node, round(length, 6) AS length FROM lca JOIN len USING (node)""")
def taxon_lengths(spark, sf_dir):
    """Subtree lengths of the common ancestors of families."""
    return taxonomy.rank_lengths(*closed(spark, sf_dir), lineage(spark, sf_dir), "family").withColumn("length", F.round("length", 6))


_TABLE = "tab AS (SELECT s_name AS leaf, CASE WHEN s_suppkey % 5 > 0 THEN n_name END AS genus, CASE WHEN s_suppkey % 5 > 1 THEN 'K' || (s_suppkey % 2) END AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("annotate_from_table", f"""WITH {TREE}, {_TABLE},
per AS (SELECT ancestor AS variable, count(DISTINCT genus) AS ng, min(genus) AS g, count(DISTINCT species) AS ns, min(species) AS s, count(*) AS n FROM paths JOIN tab ON descendant = leaf WHERE depth > 0 AND genus IS NOT NULL GROUP BY 1)
SELECT leaf AS variable, coalesce(genus || ' ' || species, species, genus, '(unclassifiable sequence)') AS label FROM tab
UNION ALL SELECT variable, CASE WHEN ng = 1 THEN g || CASE WHEN ns = 1 THEN ' ' || s ELSE '' END ELSE '(unclassifiable)' END || ' (' || n || ' leaves)' FROM per""")
def annotate_from_table(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    t = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    t = t.select(F.col("s_name").alias("leaf"), F.when(k % 5 > 0, F.col("n_name")).alias("genus"), F.when(k % 5 > 1, F.concat(F.lit("K"), (k % 2).cast("string"))).alias("species"))
    return taxonomy.from_table(t, closed(spark, sf_dir)[1], ("genus", "species"))


_NODES = """per AS (SELECT ancestor AS node, count(DISTINCT r_name) AS na, min(r_name) AS a, count(DISTINCT n_name) AS nb, min(n_name) AS b FROM paths JOIN supplier ON descendant = s_name JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE depth > 0 GROUP BY 1),
named AS (SELECT node, concat_ws(' ', CASE WHEN na = 1 THEN a END, CASE WHEN na = 1 AND nb = 1 THEN b END) AS label FROM per)"""


@query("annotate_hybrid", f"""WITH {TREE}, {_TABLE}, {_NODES}
SELECT s_name AS variable, coalesce(CASE WHEN tab.species IS NOT NULL THEN coalesce(genus || ' ' || species, species) END, 'OTU mapped to ' || named.label) AS label
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN named ON named.node = n_name LEFT JOIN tab ON tab.leaf = s_name
UNION ALL SELECT node, label FROM named""")
def annotate_hybrid(spark, sf_dir):
    """Suppliers named by the table where it knows their species, else by their nation; other nodes by their leaves."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    t = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    own = t.select(F.col("s_name").alias("leaf"), F.when(k % 5 > 0, F.col("n_name")).alias("genus"), F.when(k % 5 > 1, F.concat(F.lit("K"), (k % 2).cast("string"))).alias("species"))
    ranks = t.select(F.col("s_name").alias("leaf"), F.col("r_name").alias("family"), F.col("n_name").alias("genus"))
    nodes = tree.consensus(closed(spark, sf_dir)[1].where(F.col("depth") > 0), ranks, ("family", "genus"))
    assigned = t.select(F.col("s_name").alias("sequence"), F.col("n_name").alias("node"))
    return taxonomy.hybrid(own, assigned, nodes.select("node", "label"), ("genus", "species"))
