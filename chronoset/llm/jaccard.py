"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoset.llm.common import lean, row_key, settle, sieve
from chronoset.llm.graph import components
from chronoset.llm.words import WordTable, pieces, portions

_word = re.compile(rb"[0-9a-z\x80-\xff]+")
HASHES, ROWS = 64, 4
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 62, HASHES, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 62, HASHES, np.int64).astype(np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: runs of ASCII letters and digits, A-Z lowered, and all characters beyond ASCII."""
    return _word.findall(text.encode("utf-8", "surrogatepass").lower())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def shingles(texts: list[str], size: int, table: WordTable, split=words_of) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, text after text, and their number for each text.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    found = [split(t) if t else [] for t in texts]
    counts = np.array([len(s) for s in found], np.int64)
    ids = table.ids([w for s in found for w in s])
    h = table.rows[ids] if len(ids) else np.zeros(0, np.uint64)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts, at = pieces(counts), pieces(runs)
    place = np.repeat(starts, runs) + np.arange(int(runs.sum())) - np.repeat(at, runs)
    length = np.repeat(np.minimum(counts, size), runs)
    out = np.repeat(np.minimum(counts, size).astype(np.uint64), runs)
    for j in range(size):
        here = length > j
        out = out * _P
        out[here] += h[place[here] + j]
        out ^= out >> np.uint64(29)
    return out, runs


def signatures(h: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """(texts, HASHES) uint32 MinHash values; zeros for a text without shingles."""
    full = np.nonzero(runs)[0]
    out = np.zeros((len(runs), HASHES), np.uint32)
    if len(full):
        starts = pieces(runs)[full]
        for j in range(HASHES):
            out[full, j] = np.minimum.reduceat(((h * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_matches(depths: tuple[int, ...], threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values the least number of equal ones that keeps a pair.

    With a uniform prior the similarity after m of n equal values follows Beta(m + 1, n - m + 1); a pair goes when
    P(similarity >= threshold) = P(Binomial(n + 1, threshold) <= m) falls below ``tolerance``.
    """
    out = {}
    for n in depths:
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def pruned_pairs(a: np.ndarray, b: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that pass every depth; each pair once if both are the same block."""
    i, j = np.triu_indices(len(a), 1) if same else (x.reshape(-1) for x in np.indices((len(a), len(b))))
    equal, done = np.zeros(len(i), np.int16), 0
    for n, m in least.items():
        equal += (a[i, done:n] == b[j, done:n]).sum(axis=1, dtype=np.int16)
        keep = equal >= m
        i, j, equal, done = i[keep], j[keep], equal[keep], n
    return i, j


def first_met(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether pairs of signatures, row by row, have no band of ROWS equal values before the given one."""
    apart = np.ones(len(a), bool)
    for t in range(band):
        apart &= (a[:, t * ROWS : (t + 1) * ROWS] != b[:, t * ROWS : (t + 1) * ROWS]).any(axis=1)
    return apart


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 1 << 14) -> np.ndarray:
    """The exact number of common shingles of the sets i and j, pair by pair."""
    if len(i) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    every, ids = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, len(every), columns):
        lo, hi = np.searchsorted(ids, (start, start + columns))
        m = np.zeros((len(sets), min(columns, len(every) - start)), np.float32)
        m[row[lo:hi], ids[lo:hi] - start] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def jaccard_join(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 192) -> DataFrame:
    """Link all documents of ``docs`` (doc_id, text) whose sets of word shingles have Jaccard similarity >= threshold.

    Returns doc_id, class_id (smallest doc_id of the connected group), copy_id (smallest doc_id with the same set),
    n_links (number of other documents linked to this one, copies included), n_shingles, row (a key of doc_id and
    text) and link_group (a number of the connected group, null without shingles): a row for each input row.

    1. Documents with the same set are one class; from here on each class has one row.
    2. Classes that share a band of MinHash values are a bucket. Buckets are cut into blocks, and each pair of blocks
       is one bounded group, in which pairs are compared MinHash value by value and dropped once the posterior
       probability of reaching the threshold is below ``tolerance``. A pair is looked at in its first common band
       only. Classes without a pair left go no further.
    3. The others get their texts, and their pairs are verified exactly on the sets. A group returns link counts and
       one link for each member to its smallest partner, so rows stay linear while no link is lost from counts and
       groups. Of the corpus only texts of these classes, found by :func:`common.sieve`, are shuffled.

    With 16 bands of 4 values a pair at similarity 0.8 shares one with probability 0.9998, more above it.

    Null and empty texts and texts without words have no shingles and no links; texts of fewer than ``size`` words
    have one shingle; repeated rows are copies; null doc_ids are documents, and a class's ids are the smallest ones
    that are not null; an empty table gives an empty table; other columns are ignored.
    """
    bands = HASHES // ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", row_key("doc_id", "text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(word_hashes)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in portions(texts):
                h, runs = shingles(texts[start:end], size, table)
                sigs = signatures(h, runs)
                sets = [np.unique(s) for s in np.split(h, np.cumsum(runs)[:-1])]
                names = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
                keys = [[xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(bands)] if len(s) else None for sig, s in zip(sigs, sets, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, end - start), batch.column("row").slice(start, end - start), pa.array(names, pa.string()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "row", "name", "n_shingles", "sig", "bands"])

    schema = "doc_id long, row long, name string, n_shingles long, sig binary, bands array<long>"
    sketched = settle(rows.select("doc_id", "row", "text").mapInArrow(lean(sketch), schema), "sketches")
    classes = sketched.where(F.col("name").isNotNull()).groupBy("name").agg(
        F.min("doc_id").alias("copy_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = settle(classes.withColumn("node", F.xxhash64("name")), "classes")

    bucket = Window.partitionBy("t", "band")
    banded = classes.select("node", F.posexplode("bands").alias("t", "band"))
    banded = banded.select("*", F.count(F.lit(1)).over(bucket).alias("members")).where(F.col("members") > 1)
    banded = settle(banded, "buckets").join(classes.select("node", "sig"), "node")
    n_blocks = F.ceil(F.col("members") / block)
    banded = banded.withColumn("n_blocks", n_blocks).withColumn("b", F.pmod(F.xxhash64("node", F.lit(3)), F.col("n_blocks")))
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j"))))
    group = ["t", "band", "i", "j"]
    dealt = banded.select("t", "band", "node", "b", "sig", pairs.alias("p")).select("t", "band", "p.i", "p.j", "node", "b", "sig")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)
    least = least_matches((16, 32, HASHES), threshold, tolerance)

    def left_pairs(members: list[dict]) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """The members of a group and the pairs of them that this group has to verify."""
        i, j, t = members[0]["i"], members[0]["j"], members[0]["t"]
        left = [g for g in members if g["b"] == i]
        right = left if i == j else [g for g in members if g["b"] == j]
        if not left or not right:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        sig = lambda part: np.frombuffer(b"".join(g["sig"] for g in part), np.uint32).reshape(-1, HASHES)
        a, b = sig(left), sig(right)
        x, y = pruned_pairs(a, b, i == j, least)
        fresh = first_met(a[x], b[y], t)
        x, y = x[fresh], y[fresh]
        return (left, x, y) if i == j else (left + right, x, y + len(left))

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        members, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["t"], row["band"], row["i"], row["j"])
                if now != key:
                    if len(members) > 1:
                        yield members
                    members, key = [], now
                members.append(row)
        if len(members) > 1:
            yield members

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*group, "node", "b"]
        found = []
        for members in groups_of(batches):
            used, x, y = left_pairs(members)
            found += [tuple(used[k][n] for n in names) for k in np.unique(np.concatenate([x, y])).tolist()]
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    near = settle(dealt.withColumn("t", F.col("t").cast("long")).mapInArrow(lean(prune), "t long, band long, i long, j long, node long, b long"), "near")
    members = settle(classes.select("node", "row", "copies", "sig").join(near.select("node").distinct(), "node"), "members")
    wanted = sieve(rows.select("row", "text"), "row", members.select("row"))[0]
    texts = wanted.groupBy("row").agg(F.first("text").alias("text"))  # repeated rows once
    members = settle(members.join(texts, "row").drop("row"), "member-texts")
    dealt = near.join(members, "node").repartition(*group).sortWithinPartitions(*group)

    def one_group(members: list[dict], table: WordTable):
        used, x, y = left_pairs(members)
        if not len(x):
            return
        h, runs = shingles([g["text"] for g in used], size, table)
        sets = [np.unique(s) for s in np.split(h, np.cumsum(runs)[:-1])]
        n = np.array([len(s) for s in sets])
        common = overlaps(sets, x, y)
        good = common >= threshold * (n[x] + n[y] - common) - 1e-9
        x, y = x[good], y[good]
        nodes = np.array([g["node"] for g in used], np.int64)
        copies = np.array([g["copies"] for g in used], np.int64)
        links, partner = np.zeros(len(used), np.int64), nodes.copy()
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        np.minimum.at(partner, x, nodes[y])
        np.minimum.at(partner, y, nodes[x])
        # partners alone could leave a group in pieces (a's smallest is b, c's is d, yet b and c are linked)
        for _ in range(len(used)):
            before = partner.copy()
            np.minimum.at(partner, x, partner[y])
            np.minimum.at(partner, y, partner[x])
            if (partner == before).all():
                break
        for k in np.nonzero(links)[0]:
            yield int(nodes[k]), int(links[k]), int(partner[k])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found = WordTable(word_hashes), []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["node", "links", "partner"])

        for members in groups_of(batches):
            found += one_group(members, table)
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        yield batch_of(found)

    checked = settle(dealt.mapInArrow(lean(verify), "node long, links long, partner long"), "links")
    groups = components(checked.where(F.col("node") != F.col("partner")), "node", "partner")
    counts = checked.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("name", "node", "copy_id", "copies").join(settle(counts, "link-counts"), "node", "left").join(settle(groups, "groups"), "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    labelled = named.join(heads, "root").select("name", "copy_id", "class_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketched.select("doc_id", "row", "name", "n_shingles").join(labelled, "name", "left")
    own = lambda c: F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", own("class_id"), own("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles", "row", F.col("root").alias("link_group"))
