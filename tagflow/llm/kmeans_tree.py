"""A hierarchical k-means tree: fitted on a sample, descended greedily by points, best bin first by queries."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

BRANCH, ROUNDS, SEED = 8, 12, 11


@dataclass(frozen=True)
class Tree:
    centres: np.ndarray  # a row for each node; the root is node 0
    children: tuple[tuple[int, ...], ...]  # of each node; none: a leaf
    leaf: np.ndarray  # number of the leaf at a node, -1 inside

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances but for the points' own squares."""
    return (centres ** 2).sum(axis=1)[None] - 2 * points @ centres.T


def split(points: np.ndarray, branch: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of some points: the cluster of each. Centres start at points drawn far from those before."""
    centres = points[[int(rng.integers(len(points)))]]
    near = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < branch and near.max() > 1e-18:
        centres = np.concatenate((centres, points[[int(rng.choice(len(points), p=near / near.sum()))]]))
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(axis=1))
    for _ in range(ROUNDS):
        own = squares(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return squares(points, centres).argmin(axis=1)


def fit(sample: np.ndarray, leaf_size: int, branch: int = BRANCH) -> Tree:
    """Splits every node with more than leaf_size points of the sample, if they aren't all alike."""
    rng = np.random.default_rng(SEED)
    centres, children, leaf = [sample.mean(axis=0)], [()], [-1]
    todo = [(0, np.arange(len(sample)))]
    leaves = 0
    while todo:
        node, rows = todo.pop()
        own = split(sample[rows], branch, rng) if len(rows) > leaf_size else np.zeros(len(rows), dtype=int)
        parts = [rows[own == k] for k in range(branch)]
        parts = [p for p in parts if len(p)]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        children[node] = tuple(range(len(centres), len(centres) + len(parts)))
        for p in parts:
            todo.append((len(centres), p))
            centres.append(sample[p].mean(axis=0))
            children.append(())
            leaf.append(-1)
    return Tree(np.array(centres), tuple(children), np.array(leaf))


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf that each point reaches by way of the nearest child."""
    found = np.zeros(len(points), dtype=np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        below = tree.children[node]
        if not below:
            found[rows] = tree.leaf[node]
            continue
        own = squares(points[rows], tree.centres[list(below)]).argmin(axis=1)
        todo += [(child, rows[own == k]) for k, child in enumerate(below) if (own == k).any()]
    return found


def best_bin_first(tree: Tree, queries: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
    """For each query its leaves in the order of the search, visits of them, and more while they hold fewer than least points.

    A priority queue holds the branches not taken, by the distance of their centres; the nearest
    one is descended to a leaf, and its siblings on the way join the queue.
    """
    out = []
    for at in range(0, len(queries), 256):
        for far in squares(queries[at:at + 256], tree.centres).tolist():
            queue, order, held = [(0.0, 0)], [], 0
            while queue and (len(order) < visits or held < least):
                node = heapq.heappop(queue)[1]
                while below := tree.children[node]:
                    ranked = sorted((far[c], c) for c in below)
                    node = ranked[0][1]
                    for x in ranked[1:]:
                        heapq.heappush(queue, x)
                order.append(int(tree.leaf[node]))
                held += int(sizes[order[-1]]) if sizes is not None else least
            out.append(order)
    return out
