"""A small random forest trained on the driver from a bounded list of findings, and compiled to a column expression."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    share: float  # of true findings among those that came here
    feature: str | None = None
    most: float = 0.0
    low: Node | None = None  # feature <= most
    high: Node | None = None


def _gini(n: int, true: int) -> float:
    return 0.0 if n == 0 else 2 * true / n * (1 - true / n) * n


def _grow(rows: list[tuple[dict[str, float], int]], names: list[str], depth: int, rng: random.Random, least: int) -> Node:
    true = sum(y for _, y in rows)
    node = Node(true / len(rows))
    if depth == 0 or true in (0, len(rows)) or len(rows) < 2 * least:
        return node
    best, cut = _gini(len(rows), true) - 1e-9, None
    for f in rng.sample(names, max(2, round(len(names) ** 0.5) + 1)):
        ordered = sorted((x[f], y) for x, y in rows)
        left = 0
        for i in range(1, len(ordered)):
            left += ordered[i - 1][1]
            if ordered[i][0] > ordered[i - 1][0] and least <= i <= len(rows) - least:
                g = _gini(i, left) + _gini(len(rows) - i, true - left)
                if g < best:
                    best, cut = g, (f, (ordered[i][0] + ordered[i - 1][0]) / 2)
    if cut is None:
        return node
    node.feature, node.most = cut
    node.low = _grow([r for r in rows if r[0][node.feature] <= node.most], names, depth - 1, rng, least)
    node.high = _grow([r for r in rows if r[0][node.feature] > node.most], names, depth - 1, rng, least)
    return node


def train(rows: list[tuple[dict[str, float], int]], *, trees: int = 15, depth: int = 6, least: int = 4, seed: int = 11) -> list[Node]:
    """Trees on bootstrap samples, a random subset of features at each split (Gini)."""
    names = sorted(rows[0][0])
    rng = random.Random(seed)
    return [_grow([rows[rng.randrange(len(rows))] for _ in rows], names, depth, rng, least) for _ in range(trees)]


def score(forest: list[Node], x: dict[str, float]) -> float:
    """The mean share over the trees, on plain numbers."""
    total = 0.0
    for node in forest:
        while node.feature is not None:
            node = node.low if x[node.feature] <= node.most else node.high
        total += node.share
    return total / len(forest)


def _tree(node: Node, x: Column) -> Column:
    if node.feature is None:
        return F.lit(float(node.share))
    return F.when(x[node.feature] <= F.lit(float(node.most)), _tree(node.low, x)).otherwise(_tree(node.high, x))


def expression(forest: list[Node], x: Column) -> Column:
    """The same on a struct column with the features."""
    total = _tree(forest[0], x)
    for node in forest[1:]:
        total = total + _tree(node, x)
    return total / F.lit(float(len(forest)))
