"""Exact top-k inner product search by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoset.llm.common import settle
from chronoset.llm.vectors import exact_products, key_of_score, long_score, matrix, spread, usable, whole_numbers

#: Shares of each list that are read one after the other.
DEPTHS = (1 / 64, 1 / 24, 1 / 8)
#: Components whose contributions differ most are read; a query whose rows stay beyond this share reads all lists.
HOPELESS = 0.5


def _kind(q: np.ndarray, x: np.ndarray):
    """A number type in which every inner product of the two blocks is exact; they fit in 64 bits."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    return np.float32 if top < 2**23 else np.float64 if top < 2**52 else np.int64


def huge_block(q: np.ndarray, own: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, top: float) -> tuple[list[int], list[int], list[int]]:
    """(query rows, rows of x, scores) of the ``k`` best where scores leave 64 bits: the whole product, in Python's integers."""
    rows, cols, scores = [], [], []
    for r, every in enumerate(exact_products(q, x, top)):
        best = sorted((c for c in range(len(x)) if c != own[r]), key=lambda c: (-every[c], x_ids[c]))[:k]
        rows += [r] * len(best)
        cols += best
        scores += [int(every[c]) for c in best]
    return rows, cols, scores


def nra_block(q: np.ndarray, own: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, depths=DEPTHS):
    """Top ``k`` rows of ``x`` for every row of ``q``: arrays (query row, row of x, score), ties to smaller ids, and
    the number of list entries read.

    ``own`` is the row of x that a query itself is, or -1. There is one sorted list of the block's rows for each
    component. A query reads those of its components that are not zero, from the top for a positive one and from the
    end for a negative one, in growing prefixes. What it read of a row is known; the rest of a list lies between its
    frontier and its far end, which bounds the scores of rows from both sides, those of rows it has not seen too. It
    stops once no row other than its k best lower bounds can reach the k-th of them; the rows that still can are
    resolved by their missing entries. A query most of whose rows can still qualify reads all lists to the end, which
    is one product for all such queries.
    """
    kind = _kind(q, x)
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)
    n, read = len(x), 0
    rows, cols, scores, rest = [], [], [], []
    for r in range(len(q)):
        live = np.nonzero(q[r])[0]
        if n - (own[r] >= 0) <= 4 * k:
            rest.append(r)
            continue
        w = q[r, live].astype(np.int64)
        ends = np.where(w > 0, lists[0, live], lists[-1, live]) * w  # the least that a list adds
        known, done = np.zeros(n, np.int64), 0  # what was read of each row, over the far ends of its lists
        room, lost = np.zeros(n, np.int64), 0
        low, qualify = None, None
        for part in depths:
            depth = min(n, max(k + 1, int(np.ceil(n * part))))
            if depth >= n:
                break
            for c, weight, end in zip(live.tolist(), w.tolist(), ends.tolist(), strict=True):
                places = slice(done, depth) if weight < 0 else slice(n - depth, n - done)
                known[order[places, c]] += lists[places, c] * weight - end
            read += (depth - done) * len(live)
            done = depth
            frontier = np.where(w > 0, lists[n - depth, live], lists[depth - 1, live]) * w
            slack = frontier - ends  # an unread entry adds at most this to the lower bound
            room[:] = slack.sum()
            for c, gap in zip(live.tolist(), slack.tolist(), strict=True):
                # entries that were read have no room left
                places = slice(0, depth) if q[r, c] < 0 else slice(n - depth, n)
                room[order[places, c]] -= gap
            low = known.copy()
            if own[r] >= 0:
                low[own[r]] = -1
            kth = np.partition(low, n - k)[n - k]
            qualify = (known + room >= kth) & (np.arange(n) != own[r])
            lost = int(qualify.sum())
            if lost <= k or lost > HOPELESS * n:
                break
        if low is None or lost > HOPELESS * n / 4:
            rest.append(r)
            continue
        found = np.nonzero(qualify)[0]
        read += found.size * len(live)
        rows.append(np.full(len(found), r))
        cols.append(found)
        scores.append(x[found] @ q[r].astype(np.int64))
    if rest:
        every = (q[rest].astype(kind) @ x.T.astype(kind)).astype(np.int64)
        read += every.size * q.shape[1]
        top = every.copy()
        mine = own[rest] >= 0
        least = np.iinfo(np.int64).min
        top[np.nonzero(mine)[0], own[rest][mine]] = least
        kth = np.partition(top, n - k, axis=1)[:, n - k] if n > k else np.full(len(rest), least + 1)
        at, found = np.nonzero(top >= np.maximum(kth, least + 1)[:, None])
        rows.append(np.asarray(rest)[at])
        cols.append(found)
        scores.append(every[at, found])
    rows, cols, scores = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (rows, cols, scores))
    order = np.lexsort((x_ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(q)))[rows] < k
    return rows[keep], cols[keep], scores[keep], read


def search(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, query_block: int = 1024, row_block: int = 4096) -> DataFrame:
    """The ``k`` best rows for every query row, as (query_id, rank, vec_id, score).

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every``, candidates all rows
    but the query's own. Query blocks meet row blocks pairwise; each pair is one group of bounded size, and only its
    k best rows for each query leave it.

    Vectors that are null or hold a null or non-finite component take no part, nor do null ids. Shorter vectors, empty
    ones too, count as padded with zeros. Repeated rows are queries and candidates of their own, so a repeated id has
    a list for each of its rows. Scores beyond 64 bits are compared exactly and returned as the nearest long. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows = vectors.where(usable(F.col(id_column), F.col(vector_column)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), whole_numbers(F.col(vector_column), scale).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = settle(rows, "topk-vectors")
    top, most_width = rows.agg(F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wide = top * top * max(most_width, 1) >= 2.0**62
    queries = rows.where(F.col("id") % every == 0)
    n_rows, n_queries = rows.count(), queries.count()
    blocks, q_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    left = queries.select("id", "v", "row", spread("row", q_blocks, 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"))
    right = rows.select("id", "v", "row", spread("row", blocks, 2).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def meet(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        names = ("row", "query_id", "vec_id", "score")
        if not len(qs) or not len(xs):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names} | {"key": np.zeros(0, object)})
        width = max(max(map(len, qs["v"])), max(map(len, xs["v"])), 1)
        x_rows = xs["row"].to_numpy()
        order = np.argsort(x_rows)
        at = np.minimum(np.searchsorted(x_rows[order], qs["row"].to_numpy()), len(xs) - 1)
        own = np.where(x_rows[order][at] == qs["row"].to_numpy(), order[at], -1)
        q, x, ids, key = matrix(qs["v"], width), matrix(xs["v"], width), xs["id"].to_numpy(), None
        if wide:
            r, c, exact = huge_block(q, own, x, ids, k, top)
            s, key = [long_score(v) for v in exact], [key_of_score(v) for v in exact]
        else:
            r, c, s, _ = nra_block(q.astype(np.int64), own, x.astype(np.int64), ids, k)
        return pd.DataFrame({"row": qs["row"].to_numpy()[r], "query_id": qs["id"].to_numpy()[r], "vec_id": ids[c], "score": np.asarray(s, np.int64)}).assign(key=key)

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, "row long, query_id long, vec_id long, score long, key string")
    best = Window.partitionBy("row").orderBy(F.desc("key"), F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
