"""MinHash near-duplicates by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoset.llm.common import lean, row_key, settle, sieve
from chronoset.llm.graph import components
from chronoset.llm.jaccard import overlaps, shingles, word_hashes
from chronoset.llm.words import WordTable, pieces, portions

#: Minwise values of a set; a token of the embedded set is a place and the value there.
VALUES = 128
#: Members that a node may have to be compared exhaustively in one task.
LEAF = 256
#: Standard deviations below the threshold at which the estimate of a pair still has it verified.
SLACK = 5.0
_rng = np.random.default_rng(20181204)
_A = (_rng.integers(1, 1 << 62, VALUES, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 62, VALUES, np.int64).astype(np.uint64)
_PLACE = _rng.integers(0, 1 << 62, VALUES, np.int64).astype(np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: runs of anything but ASCII white space, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def minwise(h: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """(sets, VALUES) uint32 minwise values; zeros for an empty set."""
    full = np.nonzero(runs)[0]
    out = np.zeros((len(runs), VALUES), np.uint32)
    if len(full):
        starts = pieces(runs)[full]
        for j in range(VALUES):
            out[full, j] = np.minimum.reduceat(((h * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def branch(paths: np.ndarray, values: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the tokens that each row's node chooses; a node chooses any token with probability ``rate``.

    The choice depends on the path and the token alone, so sets that share a node and a chosen token share the child.
    """
    h = (values.astype(np.uint64) + _PLACE) * _A ^ paths.astype(np.uint64)[:, None]
    for turn in (30, 27):
        h = (h ^ (h >> np.uint64(turn))) * _MIX
    h ^= h >> np.uint64(31)
    row, place = np.nonzero(h < np.uint64(int(rate * 2.0**64)))
    child = h[row, place] * _B[place] + paths.astype(np.uint64)[row]
    return row, ((child ^ (child >> np.uint64(32))) * _MIX).view(np.int64)


def trees_needed(threshold: float, depth: int, recall: float) -> int:
    """The least number of trees that makes a pair at the threshold share a node of full depth with probability ``recall``.

    With m of VALUES tokens in common each level keeps Poisson(m / (threshold * VALUES)) common children on average,
    so survival is that of a branching process; m itself is binomial.
    """
    chance = [comb(VALUES, m) * threshold**m * (1 - threshold) ** (VALUES - m) for m in range(VALUES + 1)]
    lost = []
    for m in range(VALUES + 1):
        alive = 1.0
        for _ in range(depth):
            alive = 1 - exp(-alive * m / (threshold * VALUES))
        lost.append(1 - alive)
    trees = 1
    while sum(c * x**trees for c, x in zip(chance, lost, strict=True)) > 1 - recall:
        trees += 1
    return trees


def pairs_within(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of the members of each group, groups of the given sizes one after the other, in portions."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    x, y, held = [], [], 0
    for start, n in zip(pieces(sizes).tolist(), sizes.tolist(), strict=True):
        if n not in known:
            known[n] = np.triu_indices(n, 1)
        a, b = known[n]
        x.append(a + start)
        y.append(b + start)
        held += len(a)
        if held > most:
            yield np.concatenate(x), np.concatenate(y)
            x, y, held = [], [], 0
    if held:
        yield np.concatenate(x), np.concatenate(y)


def equal_values(sketch: np.ndarray, x: np.ndarray, y: np.ndarray, portion: int = 1 << 16) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[(sketch[x[s : s + portion]] == sketch[y[s : s + portion]]).sum(axis=1) for s in range(0, len(x), portion)]])


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], most: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the sizes of these, from batches that are sorted by ``key``."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        """Where groups start."""
        if not table.num_rows:
            return np.zeros(0, np.int64)
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in key:
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.nonzero(new)[0]

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            table = pa.Table.from_batches(held)
            starts = cut(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), np.diff(starts)
                held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        starts = cut(table)
        if len(starts):
            yield table, np.diff(np.append(starts, table.num_rows))


def _binary(column) -> list[bytes]:
    return column.to_pylist()


def near_duplicates(docs: DataFrame, *, size: int = 3, percent: int = 85, least_depth: int = 2, depth: int = 3, recall: float = 0.9999, leaf: int = LEAF) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, row.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of ``size``-word shingles.
    component_id is the smallest doc_id that links reach, kept whether it is the row's own.

    1. Documents with the same set are one class. A set is embedded as VALUES tokens, its minwise values.
    2. In each of a number of independent trees, a node chooses tokens by hashing its path, each with probability
       1 / (threshold * VALUES), and a class goes to the children of the chosen tokens it has. The first
       ``least_depth`` levels need no counts, so each class finds its nodes there by itself, and classes that have
       little in common have parted. Nodes of one class end; nodes of more than ``leaf`` classes branch again, up to
       ``depth`` levels. The number of trees follows from ``recall``, which a pair at the threshold reaches at full
       depth; most nodes end before, where it is higher.
    3. Leaves are compared exhaustively by their minwise values, in two passes. The first one hands on each member's
       best partner; these pairs are verified on the full sets. A leaf whose members are then connected is done, and
       so is a member without a possible partner. Among the others all pairs across components that can be links are
       verified on the full sets, each in the first leaf that its classes share. So components lose no link, and
       copies need no pairs of their own.

    A leaf beyond ``leaf`` classes at full depth, as of thousands of near copies, is cut into blocks: in the first pass
    each block meets a bounded draw of the leaf's members, in the second one the members outside the largest
    component meet all blocks.

    Null and empty texts and texts without words have no shingles and no links; texts of fewer than ``size`` words have
    one shingle; repeated rows are one class; a null doc_id is linked as others are, counts for component_id only if
    no id is there, and is kept then; an empty table gives no rows; other columns are ignored.
    """
    threshold = percent / 100
    rate = 1 / (threshold * VALUES)
    seeds = np.random.default_rng(11).integers(1, 1 << 62, trees_needed(threshold, depth, recall), np.int64)
    least = int(np.ceil(VALUES * threshold - SLACK * np.sqrt(VALUES * threshold * (1 - threshold))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", row_key("doc_id", "text"))

    def sets_of(texts: list[str], table: WordTable) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        h, runs = shingles(texts, size, table, words_of)
        return [np.unique(s) for s in np.split(h, np.cumsum(runs)[:-1])], h, runs

    def name_of(s: np.ndarray) -> bytes | None:
        return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(word_hashes)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in portions(texts):
                sets, h, runs = sets_of(texts[start:end], table)
                values = minwise(h, runs)
                paths: list[list[int]] = [[] for _ in sets]
                full = np.nonzero(runs)[0]
                for seed in seeds.tolist():
                    at, child = full, np.full(len(full), seed)
                    for _ in range(least_depth):
                        deeper, child = branch(child, values[at], rate)
                        at = at[deeper]
                    for k, c in zip(at.tolist(), child.tolist(), strict=True):
                        paths[k].append(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, end - start), batch.column("row").slice(start, end - start), pa.array([name_of(s) for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                    ["doc_id", "row", "name", "n_shingles", "tokens", "paths"])

    sketched = settle(rows.select("doc_id", "row", "text").mapInArrow(lean(sketch), "doc_id long, row long, name binary, n_shingles long, tokens binary, paths array<long>"), "chosenpath-sketches")
    classes = sketched.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.min("n_shingles").alias("n_shingles"))
    classes = settle(classes, "chosenpath-classes")

    def tokens_of(names: DataFrame) -> DataFrame:
        """(name, tokens) of the named classes; only their rows are shuffled."""
        wanted = settle(names.select("name").distinct().withColumn("key", F.xxhash64("name")), "chosenpath-names")
        some = sieve(sketched.where(F.col("name").isNotNull()).select("name", "tokens", F.xxhash64("name").alias("key")), "key", wanted.select("key"))[0]
        return some.groupBy("name").agg(F.first("tokens").alias("tokens")).join(wanted.select("name"), "name")

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                values = np.frombuffer(b"".join(_binary(part.column("tokens"))), np.uint32).reshape(-1, VALUES)
                at, child = branch(part.column("node").to_numpy(), values, rate)
                yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), part.column("name").take(pa.array(at))], ["node", "name"])

    def shared(members: DataFrame) -> DataFrame:
        """Members of nodes that hold two or more classes, with the number of these; only such rows are shuffled whole.

        Copies of a document are counted first, which finds all wanted nodes, and told apart among the few rows left.
        """
        rows_in = settle(members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "chosenpath-nodes")
        some = settle(sieve(members, "node", rows_in)[0].distinct(), "chosenpath-some")
        sizes = some.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return settle(some.join(sizes, "node"), "chosenpath-members")

    members = shared(sketched.select("name", F.explode("paths").alias("node")))
    done = members.where(F.col("size") <= leaf)
    for _ in range(depth - least_depth):
        large = members.where(F.col("size") > leaf)
        if large.isEmpty():
            break
        deeper = large.join(tokens_of(large), "name").select("node", "name", "tokens").mapInArrow(lean(go_on), "node long, name binary")
        members = shared(settle(deeper, "chosenpath-deeper"))
        done = done.unionByName(members.where(F.col("size") <= leaf))
    else:
        done = done.unionByName(members.where(F.col("size") > leaf))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One byte of each minwise value: enough for estimates."""
        for batch in batches:
            values = np.frombuffer(b"".join(_binary(batch.column("tokens"))), np.uint32).reshape(-1, VALUES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("n_shingles"), pa.array([v.tobytes() for v in values], pa.binary()), batch.column("leaves")], ["name", "n_shingles", "bytes", "leaves"])

    leaves = done.groupBy("name").agg(F.array_sort(F.collect_list("node")).alias("leaves"))  # a few for each tree
    used = tokens_of(leaves).join(classes.select("name", "n_shingles"), "name").join(leaves, "name").select("name", "n_shingles", "tokens", "leaves")
    used = settle(used.mapInArrow(lean(narrow), "name binary, n_shingles long, bytes binary, leaves array<long>"), "chosenpath-used")

    def candidates(table: pa.Table, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of places in the table that can be links, with the number of equal minwise values."""
        bytes_ = np.frombuffer(b"".join(_binary(table["bytes"])), np.uint8).reshape(-1, VALUES)
        n = table["n_shingles"].to_numpy()
        for x, y in pairs_within(sizes):
            fit = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[fit], y[fit]
            equal = equal_values(bytes_, x, y)
            keep = equal >= least
            yield x[keep], y[keep], equal[keep]

    blocks = F.ceil(F.col("size") / leaf)
    drawn = F.pmod(F.xxhash64("name", F.lit(5)), F.col("size") * 2) < leaf
    to = F.when((blocks > 1) & drawn, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("name", F.lit(3)), blocks)))
    dealt = done.select("node", "name", F.explode(to).alias("block")).join(used.drop("leaves"), "name").repartition("node", "block").sortWithinPartitions("node", "block")

    def best_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in whole_groups(batches, ["node", "block"]):
            names = table["name"].combine_chunks()
            best = np.full(table.num_rows, -1, np.int64)
            partner = np.full(table.num_rows, -1, np.int64)
            for x, y, equal in candidates(table, sizes):
                for own, other in ((x, y), (y, x)):
                    order = np.lexsort((other, -equal, own))
                    first = order[np.unique(own[order], return_index=True)[1]] if len(order) else order
                    better = equal[first] > best[own[first]]
                    best[own[first[better]]], partner[own[first[better]]] = equal[first[better]], other[first[better]]
            at = np.nonzero(partner >= 0)[0]
            yield pa.RecordBatch.from_arrays([table["node"].combine_chunks().take(pa.array(at)), names.take(pa.array(at)), names.take(pa.array(partner[at]))], ["node", "name", "partner"])

    partnered = settle(dealt.mapInArrow(lean(best_partners), "node long, name binary, partner binary"), "chosenpath-partners")
    found = partnered.select(F.least("name", "partner").alias("a"), F.greatest("name", "partner").alias("b")).where(F.col("a") != F.col("b"))
    found = settle(found.distinct(), "chosenpath-pairs")

    def full_sets(wanted: DataFrame) -> DataFrame:
        """(name, shingles) of the wanted classes; only their texts are shuffled, once each."""
        wanted = settle(classes.select("name", "row").join(wanted, "name"), "chosenpath-wanted")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = WordTable(word_hashes)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for start, end in portions(texts):
                    sets = [s for s in sets_of(texts[start:end], table)[0] if len(s)]
                    yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["name", "shingles"])

        some = sieve(rows.select("row", "text"), "row", wanted.select("row"))[0].select("text")
        sets = some.mapInArrow(lean(of), "name binary, shingles binary").groupBy("name").agg(F.first("shingles").alias("shingles"))
        return settle(sets.join(wanted.select("name"), "name", "left_semi"), "chosenpath-sets")

    sets = full_sets(found.select(F.explode(F.array("a", "b")).alias("name")).distinct())
    both = found.join(sets.withColumnRenamed("shingles", "s").withColumnRenamed("name", "a"), "a").join(sets.withColumnRenamed("shingles", "t").withColumnRenamed("name", "b"), "b")

    def linked(common, n, m):
        return 100 * common >= percent * (n + m - common)

    def verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s, t in zip(batch.column("s"), batch.column("t"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                good.append(linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = settle(both.select("a", "b", "s", "t").mapInArrow(lean(verify_pairs), "a binary, b binary"), "chosenpath-links")
    groups = settle(components(links), "chosenpath-groups")

    # second pass: leaves that hold more than one component; blocks of large ones have not met all others before
    open_ = partnered.select("node", "name").distinct().unionByName(done.where(F.col("size") > leaf).select("node", "name")).distinct()
    labelled = open_.join(groups.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    labelled = settle(labelled.select("node", "name", "root"), "chosenpath-labelled")
    parts = labelled.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("node").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = settle(mixed.select("node", F.col("main.root").alias("main"), F.col("main.n").alias("inside"), (F.col("size") - F.col("main.n")).alias("outside")), "chosenpath-mixed")
    n_out, n_in = F.ceil(F.col("outside") / leaf), F.ceil(F.col("inside") / leaf)
    own = lambda n: F.pmod(F.xxhash64("name", F.lit(4)), n)
    is_main = F.col("root") == F.col("main")
    cut = labelled.join(mixed, "node").withColumn("own", F.when(is_main, n_out + own(n_in)).otherwise(own(n_out)))
    meets = F.when(is_main, F.sequence(F.lit(0).cast("long"), n_out - 1)).otherwise(F.sequence(F.lit(0).cast("long"), n_out + n_in - 1))
    cut = cut.select("node", "name", "root", "own", F.explode(meets).alias("met")).select("node", "name", "root", "own", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"))
    group = ["node", "i", "j"]

    def across(table: pa.Table, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates of different components and, unless it is one block, of different blocks, in their first common leaf."""
        root = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        block, i, j, node = (table[c].to_numpy() for c in ("own", "i", "j", "node"))
        lists = table["leaves"].to_pylist()
        most = max(map(len, lists), default=0)
        held = np.zeros((len(lists), most), np.int64)
        there = np.zeros((len(lists), most), bool)
        for k, v in enumerate(lists):
            held[k, : len(v)], there[k, : len(v)] = v, True
        for x, y, _ in candidates(table, sizes):
            keep = (root[x] != root[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
            x, y = x[keep], y[keep]
            first = np.ones(len(x), bool)
            for s in range(0, len(x), 4096):
                a, b = x[s : s + 4096], y[s : s + 4096]
                same = (held[a][:, :, None] == held[b][:, None, :]) & there[a][:, :, None] & there[b][:, None, :] & (held[a] < node[a][:, None])[:, :, None]
                first[s : s + 4096] = ~same.any(axis=(1, 2))
            yield x[first], y[first]

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in whole_groups(batches, group):
            hit = np.zeros(table.num_rows, bool)
            for x, y in across(table, sizes):
                hit[x] = hit[y] = True
            yield from table.select([*group, "name", "root", "own"]).filter(pa.array(hit)).to_batches()

    near = cut.join(used, "name").repartition(*group).sortWithinPartitions(*group)
    columns = "node long, i long, j long, name binary, root binary, own long"
    near = settle(near.select("node", "i", "j", "name", "root", "own", "n_shingles", "bytes", "leaves").mapInArrow(lean(involved), columns), "chosenpath-across")
    if not near.isEmpty():
        sets = full_sets(near.select("name").distinct())
        near = near.join(used, "name").join(sets, "name").repartition(*group).sortWithinPartitions(*group)

        def verify_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, sizes in whole_groups(batches, group, 1 << 10):
                names, roots = table["name"].combine_chunks(), table["root"].combine_chunks()
                held = [np.frombuffer(v, np.uint64) for v in _binary(table["shingles"])]
                n = np.array([len(s) for s in held])
                starts = pieces(sizes)
                for x, y in across(table, sizes):
                    good = np.zeros(len(x), bool)
                    of = np.searchsorted(starts, x, side="right") - 1
                    for k in np.unique(of).tolist():
                        mine = np.nonzero(of == k)[0]
                        base, end = starts[k], starts[k] + sizes[k]
                        common = overlaps(held[base:end], x[mine] - base, y[mine] - base)
                        good[mine] = linked(common, n[x[mine]], n[y[mine]])
                    yield pa.RecordBatch.from_arrays([roots.take(pa.array(x[good])), roots.take(pa.array(y[good]))], ["a", "b"])

        more = near.select(*group, "name", "root", "own", "n_shingles", "bytes", "leaves", "shingles").mapInArrow(lean(verify_groups), "a binary, b binary")
        joined = settle(components(settle(more.distinct(), "chosenpath-more")), "chosenpath-joined")
        alone = joined.join(groups.select(F.col("root").alias("node")).distinct(), "node", "left_anti")
        wider = groups.join(joined.withColumnRenamed("root", "top").withColumnRenamed("node", "root"), "root", "left")
        groups = settle(wider.select("node", F.coalesce("top", "root").alias("root")).unionByName(alone.select("node", "root")).distinct(), "chosenpath-groups")

    tops = classes.select("name", "least_id").join(groups.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    heads = tops.groupBy("root").agg(F.min("least_id").alias("component_id"))
    out = sketched.select("doc_id", "row", "name", "n_shingles").join(tops.join(heads, "root").select("name", "component_id"), "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "row")
