"""Small trees over a list of leaves, and choices of subsamples: lists on the driver."""

from __future__ import annotations

from itertools import combinations

import numpy as np

Edge = tuple[str, str, float]


def paired_tree(leaves: list[str], length) -> list[Edge]:
    """A binary tree that joins the first two nodes of a queue until one is left; ``length()`` gives edge lengths."""
    queue, out, n = list(leaves), [], 0
    while len(queue) > 1:
        a, b, *queue = queue
        n += 1
        name = "root" if not queue else f"node{n}"
        out += [(a, name, length()), (b, name, length())]
        queue.append(name)
    return out


def even_tree(leaves: list[str], edge_length: float = 1.0) -> list[Edge]:
    return paired_tree(leaves, lambda: edge_length)


def random_tree(leaves: list[str], mean: float = 0.0, sigma: float = 1.0, seed: int = 1) -> list[Edge]:
    """The same with log-normal edge lengths."""
    rng = np.random.default_rng(seed)
    return paired_tree(leaves, lambda: float(rng.lognormal(mean, sigma)))


def uneven_tree(leaves: list[str], edge_length: float = 1.0) -> list[Edge]:
    """A comb: each leaf in turn joins what came before."""
    out, top = [], leaves[0]
    for i, leaf in enumerate(leaves[1:], 1):
        name = "root" if i == len(leaves) - 1 else f"node{i}"
        out += [(top, name, edge_length), (leaf, name, edge_length)]
        top = name
    return out


def spread_choice(candidates: list[int], k: int, n: int) -> tuple[int, ...]:
    """The k of ``candidates`` (positions below n) that lie most evenly: least sum of 1 / gap², ends at -1 and n."""
    cost = lambda c: sum(1 / (b - a) ** 2 for a, b in zip((-1, *c), (*c, n + 1), strict=True))
    return min(combinations(sorted(candidates), k), key=cost)


def nested_choices(n: int, sizes: list[int]) -> dict[int, tuple[int, ...]]:
    """Time points for each size, largest first, each nested in the one before."""
    left, out = list(range(n)), {}
    for k in sorted(sizes, reverse=True):
        left = list(spread_choice(left, min(k, len(left)), n))
        out[k] = tuple(left)
    return out
