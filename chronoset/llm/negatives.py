"""Hard-negative mining: rotated one-bit codes with stored alignment bound scores; survivors are scored in integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoset.llm.common import lean, settle, small
from chronoset.llm.vectors import exact_products, key_of_score, long_score, matrix, score_of_key, spread, usable, whole_numbers

#: Bits to which a rotated query is rounded; each is a plane of the popcount.
PLANES = 8
#: One-bit codes of a vector, each of what the ones before left; every one narrows the intervals, the first ones by 0.6 each.
LEVELS = 6


def rotation(width: int, seed: int = 13) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lengths, alignments, rests) of the rows of ``x``.

    A code is the signs of the rotated vector as 64-bit words, (rows, levels, words); an alignment is the inner
    product of the vector's direction with that of its code. What the code leaves of the direction is orthogonal to
    it and is coded in the same way, ``levels`` times in all; rests are the lengths of what is left at the end.
    """
    y = x @ turn.T
    width = y.shape[1]
    length = np.sqrt((y * y).sum(axis=1))
    left = y / np.maximum(length, 1e-300)[:, None]
    codes = np.zeros((len(x), levels, -(-width // 64)), np.uint64)
    align = np.zeros((len(x), levels))
    for level in range(levels):
        bits = left >= 0
        padded = np.zeros((len(x), codes.shape[2] * 64), bool)
        padded[:, :width] = bits
        codes[:, level] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        align[:, level] = np.abs(left).sum(axis=1) / np.sqrt(width)
        left = left - np.where(bits, 1.0, -1.0) * (align[:, level] / np.sqrt(width))[:, None]
    return codes, length, align, np.sqrt((left * left).sum(axis=1))


class QueryBlock:
    """Rotated queries, rounded to PLANES bits, that bound their inner products with coded rows."""

    def __init__(self, q: np.ndarray, turn: np.ndarray):
        y = q @ turn.T
        self.width = y.shape[1]
        self.length = np.sqrt((y * y).sum(axis=1))
        self.low = y.min(axis=1, initial=0.0)
        self.step = np.maximum((y.max(axis=1, initial=0.0) - self.low) / (2**PLANES - 1), 1e-300)
        level = np.clip(np.rint((y - self.low[:, None]) / self.step[:, None]), 0, 2**PLANES - 1).astype(np.uint8)
        lost = y - (self.low[:, None] + self.step[:, None] * level)
        self.lost = np.sqrt((lost * lost).sum(axis=1))
        self.total = level.sum(axis=1, dtype=np.int64)
        padded = np.zeros((len(y), -(-self.width // 64) * 64), np.uint8)
        padded[:, : self.width] = level
        self.planes = [np.packbits((padded >> b) & 1, axis=1, bitorder="little").view(np.uint64) for b in range(PLANES)]

    def bounds(self, r: int, codes: np.ndarray, length: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of query ``r`` with the coded rows.

        A row's direction is the sum of its codes' directions, each times its alignment, and of a rest that is
        orthogonal to the last code c. The part of the query beside c has length sqrt(|q|^2 - <q,c>^2), so by
        Cauchy-Schwarz the rest adds at most the product of both lengths. Inner products with codes come from
        popcounts, up to what rounding the query lost. A margin far above rounding errors keeps the bounds safe.
        """
        middle, lost, along = np.zeros(len(codes)), np.zeros(len(codes)), np.zeros(len(codes))
        for level in range(codes.shape[1]):
            code = codes[:, level]
            on = np.zeros(len(codes), np.int64)
            for b, plane in enumerate(self.planes):
                on += np.bitwise_count(code & plane[r]).sum(axis=1, dtype=np.int64) << b
            signs = 2 * np.bitwise_count(code).sum(axis=1, dtype=np.int64) - self.width
            along = (self.low[r] * signs + self.step[r] * (2 * on - self.total[r])) / np.sqrt(self.width)
            middle += align[:, level] * along
            lost += align[:, level] * self.lost[r]
        least = np.maximum(np.abs(along) - self.lost[r], 0.0)
        beside = np.sqrt(np.maximum(self.length[r] ** 2 - least**2, 0.0)) * rest
        gap = (lost + beside) * (1 + 1e-9) + 1e-7 * self.length[r] + 1e-9
        return (middle - gap) * length, (middle + gap) * length


def kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_rows(block: QueryBlock, r: int, rows: tuple, allowed: np.ndarray, k: int) -> np.ndarray:
    """The allowed rows that can be among the ``k`` best of query ``r``."""
    low, high = block.bounds(r, *rows)
    return np.nonzero(allowed & (high >= kth_largest(low[allowed], k)))[0]


def band_rows(low: np.ndarray, high: np.ndarray, allowed: np.ndarray, band: tuple[float, float], k: int) -> np.ndarray:
    """Whether a row can be among the ``k`` best with a score in the band (both ends count)."""
    least, most = band
    may = allowed & (low <= most) & (high >= least)
    sure = may & (low >= least) & (high <= most)
    return may & (high >= kth_largest(low[sure], k))


def first_places(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -score))[:k]


def mine(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", every: int = 100,
         positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256, anchor_block: int = 512, row_block: int = 4096) -> DataFrame:
    """Hard negatives of anchors: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); scores are integer inner products, ties go to smaller ids. Anchors are the
    rows whose id is divisible by ``every``, positives an anchor's ``positives`` best other rows of its label. For each
    of them the ``negatives`` best rows of other labels are returned whose score, in percent of the positive's, lies
    in ``band``.

    Each row is stored with its length, the signs of its rotated vector and its alignment with that code, and LEVELS
    such codes in all, each of what the ones before left. Blocks of anchors meet blocks of rows, for positives only those of their label, which may hold any share of all rows.
    Intervals from popcounts drop rows that cannot be wanted; the rest is scored in integers, and only the best of a
    block leave its task. Nothing else decides, so results are exact.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. Shorter vectors, empty ones
    too, count as padded with zeros. Repeated rows are rows of their own, also as anchors and as each other's
    positives. Scores beyond 64 bits are compared exactly and returned as the nearest long. An empty table, or one
    without anchors, gives no rows. Other columns are ignored.
    """
    rows = vectors.where(F.col(label_column).isNotNull()).where(usable(F.col(id_column), F.col(vector_column)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), whole_numbers(F.col(vector_column), scale).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = settle(rows, "mining-vectors")
    n_rows, width, top, n_anchors = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0)), F.count_if(F.col("id") % every == 0)).first()
    width, wide = max(width, 1), 100.0 * top * top * max(width, 1) >= 2.0**62
    unit = 2.0 ** max(0, int(np.log2(top)) - 100) if top > 0 else 1.0  # keeps squares of huge components within doubles

    def add_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(width)
        for batch in batches:
            codes, length, align, rest = encode(matrix(batch.column("v").to_pylist(), width) / unit, turn)
            extra = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(list(align), pa.list_(pa.float64())), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["id", "label", "v", "row", "code", "length", "align", "rest"])

    coded = settle(rows.mapInArrow(lean(add_codes), "id long, label long, v array<double>, row long, code binary, length double, align array<double>, rest double"), "mining-codes")
    anchors = coded.where(F.col("id") % every == 0).select("id", "label", "v", "row")

    def stored(xs: pd.DataFrame) -> tuple:
        codes = np.frombuffer(b"".join(xs["code"]), np.uint64).reshape(len(xs), LEVELS, -1)
        return codes, xs["length"].to_numpy(), np.stack(xs["align"].to_numpy()), xs["rest"].to_numpy()

    def nearest(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("row", "other", "score", "key")}
        if len(qs) and len(xs):
            q, x, ids = matrix(qs["v"], width), matrix(xs["v"], width), xs["id"].to_numpy()
            block, held, others = QueryBlock(q / unit, rotation(width)), stored(xs), xs["row"].to_numpy()
            for r, own in enumerate(qs["row"].to_numpy()):
                found = best_rows(block, r, held, others != own, positives)
                score = exact_products(q[r], x[found], top)
                best = first_places(score, ids[found], positives)
                out["row"] += [own] * len(best)
                out["other"] += ids[found[best]].tolist()
                out["score"] += [long_score(s) for s in score[best]]
                out["key"] += [key_of_score(s) if wide else None for s in score[best]]
        return pd.DataFrame(out).astype({"row": "int64", "other": "int64", "score": "int64", "key": "object"})

    by_label = small(settle(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("m")), "mining-labels"))

    def deal(df: DataFrame, block: str, own: str, size: int, met: str, other: str, other_size: int) -> DataFrame:
        """Rows in blocks of their label, once for each block of the other side."""
        parts = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.lit(1))
        there = df.join(by_label, "label").where("m > 0").withColumn(block, F.pmod(F.xxhash64("row", F.lit(1 if block == "ab" else 2)), parts(own, size)))
        return there.withColumn(met, F.explode(F.sequence(F.lit(0).cast("long"), parts(other, other_size) - 1))).drop("n", "m")

    left = deal(anchors, "ab", "m", anchor_block, "rb", "n", row_block).select(*[F.col(c).alias(c) for c in ("id", "v", "row", "label", "ab", "rb")])
    right = deal(coded, "rb", "n", row_block, "ab", "m", anchor_block)
    near = left.groupBy("label", "ab", "rb").cogroup(right.groupBy("label", "ab", "rb")).applyInPandas(nearest, "row long, other long, score long, key string")
    place = Window.partitionBy("row").orderBy(F.desc("key"), F.desc("score"), "other")
    near = near.withColumn("k", F.row_number().over(place)).where(F.col("k") <= positives)
    near = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "other", "score", "key"))).alias("positives"))  # at most `positives` each
    ready = settle(anchors.join(near, "row"), "mining-positives")

    def harder(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        names = ("row", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score", "key")
        out: dict[str, list] = {c: [] for c in names}
        if len(qs) and len(xs):
            q, x, ids, labels = matrix(qs["v"], width), matrix(xs["v"], width), xs["id"].to_numpy(), xs["label"].to_numpy()
            block, held = QueryBlock(q / unit, rotation(width)), stored(xs)
            for r, (own, anchor, label, wanted) in enumerate(zip(qs["row"], qs["id"], qs["label"], qs["positives"], strict=True)):
                low, high = block.bounds(r, *held)
                allowed = labels != label
                bands = []
                for p in wanted:
                    score = score_of_key(p["key"]) if wide else int(p["score"])
                    bands.append((-(-band[0] * score // 100), band[1] * score // 100))
                may = [band_rows(low, high, allowed, (a / unit**2, b / unit**2), negatives) if a <= b else np.zeros(len(x), bool) for a, b in bands]
                found = np.nonzero(np.logical_or.reduce(may))[0]
                score = exact_products(q[r], x[found], top)
                for p, (a, b) in zip(wanted, bands, strict=True):
                    inside = np.nonzero(((score >= a) & (score <= b)).astype(bool))[0]
                    best = inside[first_places(score[inside], ids[found[inside]], negatives)]
                    for c, value in zip(names[:5], (own, p["k"], anchor, p["other"], p["score"]), strict=True):
                        out[c] += [value] * len(best)
                    out["negative_id"] += ids[found[best]].tolist()
                    out["negative_score"] += [long_score(s) for s in score[best]]
                    out["key"] += [key_of_score(s) if wide else None for s in score[best]]
        return pd.DataFrame(out).astype({c: "object" if c == "key" else "int64" for c in names})

    n_blocks, n_groups = max(1, -(-n_rows // row_block)), max(1, -(-n_anchors // anchor_block))
    left = ready.select(*[F.col(c).alias(c) for c in ("id", "label", "v", "row", "positives")]).withColumn("ab", spread("row", n_groups, 1)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = coded.withColumn("rb", spread("row", n_blocks, 2)).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    schema = "row long, k long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, key string"
    found = left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInPandas(harder, schema)
    place = Window.partitionBy("row", "k").orderBy(F.desc("key"), F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
