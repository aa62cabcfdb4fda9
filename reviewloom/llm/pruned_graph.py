"""Robust-pruned directed graph over the vectors of one shard, built and searched in batches.

Vectors get one more component that brings all of them to the same length, so the nearest vector by distance is the
one of largest inner product, and a query (whose own extra component is 0) finds its largest inner products by the same
walk. The graph is grown by greedy searches: what a search for a vector expands on its way is proposed as its
neighbours, and of the proposals those are kept that no closer kept one stands before, with a factor that lets some
longer edges live. Edges go both ways as long as a node has room, else its neighbours are pruned again.

Where lengths differ, the longest vectors answer most queries but lie far from all others, so few edges lead to them.
A node then also keeps some edges to what is found by a search for it in the place of a query, pruned in the same way.
"""

from __future__ import annotations

import numpy as np

DEGREE = 32
BUILD_BEAM = 64
FACTORS = (1.0, 1.2)
BATCH = 256
ASKED_EDGES = 12  # edges of a node that a search in the place of a query proposes, if lengths differ
EXPAND = 4  # nodes of a beam that are expanded in one step


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a component that makes their lengths equal, in single precision."""
    vectors = vectors / np.abs(vectors).max()
    squares = np.einsum("ij,ij->i", vectors, vectors)
    most = squares.max()
    scaled = np.column_stack([vectors, np.sqrt(np.maximum(most - squares, 0.0))]) / np.sqrt(most)
    return scaled.astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int,
                trail: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes of the final beams, best first (-1: none), their inner products, and what was expanded."""
    n, b = len(points), len(queries)
    nodes = np.full((b, beam), -1, np.int64)
    near = np.full((b, beam), -np.inf, np.float32)
    fresh = np.zeros((b, beam), bool)
    seen = np.zeros((b, n), bool)
    nodes[:, 0], near[:, 0], fresh[:, 0], seen[:, start] = start, queries @ points[start], True, True
    steps = []
    active = np.arange(b)
    while len(active):
        # The best nodes of each beam that were not expanded yet.
        order = np.argsort(~fresh[active], axis=1, kind="stable")[:, :EXPAND]
        chosen = np.take_along_axis(fresh[active], order, 1)
        at = np.where(chosen, np.take_along_axis(nodes[active], order, 1), -1)
        np.put_along_axis(fresh_rows := fresh[active], order, False, 1)
        fresh[active] = fresh_rows
        if trail:
            step = np.full((b, order.shape[1]), -1, np.int64)
            step[active] = at
            steps.append(step)
        reached = np.where(at[:, :, None] >= 0, edges[at], -1).reshape(len(active), -1)
        row, place = np.nonzero(reached >= 0)
        keys = active[row] * n + reached[row, place]
        keys = np.unique(keys[~seen.ravel()[keys]])
        seen.ravel()[keys] = True
        row, node = keys // n, keys % n
        value = np.einsum("ij,ij->i", queries[row], points[node])
        # New nodes side by side, a row per query.
        rows, first, many = np.unique(row, return_index=True, return_counts=True)
        if len(rows):
            column = np.arange(len(row)) - np.repeat(first, many)
            line = np.repeat(np.arange(len(rows)), many)
            more = np.full((len(rows), many.max()), -1, np.int64)
            more_near = np.full(more.shape, -np.inf, np.float32)
            more[line, column], more_near[line, column] = node, value
            all_nodes = np.concatenate([nodes[rows], more], 1)
            all_near = np.concatenate([near[rows], more_near], 1)
            all_fresh = np.concatenate([fresh[rows], more >= 0], 1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            nodes[rows] = np.take_along_axis(all_nodes, best, 1)
            near[rows] = np.take_along_axis(all_near, best, 1)
            fresh[rows] = np.take_along_axis(all_fresh, best, 1)
        active = active[fresh[active].any(1)]
    return nodes, near, steps


def prune(points: np.ndarray, at: np.ndarray, proposed: np.ndarray, factor: float, degree: int,
          heads: np.ndarray | None = None) -> np.ndarray:
    """Kept neighbours (-1: none) of the nodes `at`, from proposals (-1: none), repeated ones allowed.

    `heads` are the places from which to look at the proposals, those of the nodes if not given.
    """
    heads = points[at] if heads is None else heads
    proposed = np.sort(np.where(proposed == at[:, None], -1, proposed), axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    vectors = points[proposed]
    far = 2 - 2 * np.einsum("ij,ikj->ik", heads, vectors)
    far = np.where(proposed >= 0, far, np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    proposed, far = np.take_along_axis(proposed, order, 1), np.take_along_axis(far, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = 2 - 2 * (vectors @ vectors.transpose(0, 2, 1))
    alive = proposed >= 0
    kept = np.full((len(at), degree), -1, np.int32)
    line = np.arange(len(at))
    for k in range(degree):
        pick = alive.argmax(1)
        some = alive[line, pick]
        if not some.any():
            break
        kept[some, k] = proposed[some, pick[some]]
        alive &= factor * factor * between[line, pick] > far
        alive[line, pick] = False
    return kept


def _add_back(points: np.ndarray, edges: np.ndarray, at: np.ndarray, factor: float) -> None:
    """Edges from the neighbours of `at` back to it; nodes without room are pruned again."""
    degree = edges.shape[1]
    line, place = np.nonzero(edges[at] >= 0)
    to, back = edges[at][line, place].astype(np.int64), at[line]
    known = (edges[to] == back[:, None]).any(1)
    to, back = to[~known], back[~known]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first, many = np.unique(to, return_index=True, return_counts=True)
    # Nodes with a similar number of new edges together, so that little is padded.
    for some in np.array_split(np.argsort(many, kind="stable"), max(1, len(nodes) // BATCH + 1)):
        if not len(some):
            continue
        new = np.full((len(some), many[some].max()), -1, np.int64)
        for j, i in enumerate(some):
            new[j, :many[i]] = back[first[i]:first[i] + many[i]]
        both = np.concatenate([edges[nodes[some]], new], 1)
        full = (both >= 0).sum(1) > degree
        room = np.sort(both[~full], axis=1)[:, ::-1][:, :degree]
        edges[nodes[some][~full]] = room
        if full.any():
            edges[nodes[some][full]] = prune(points, nodes[some][full], both[full], factor, degree)


def _neighbours(points: np.ndarray, edges: np.ndarray, start: int, at: np.ndarray, beam: int, factor: float,
                degree: int, heads: np.ndarray) -> np.ndarray:
    """Neighbours of the nodes `at` among what searches from the places `heads` expand."""
    _, _, steps = beam_search(points, edges, start, heads, beam, True)
    proposed = np.concatenate([*steps, edges[at]], 1)
    # Columns without a proposal go.
    proposed = -np.sort(-proposed, axis=1)[:, :max(1, int((proposed >= 0).sum(1).max()))]
    return prune(points, at, proposed, factor, degree, heads)


def _distinct(nodes: np.ndarray) -> np.ndarray:
    """Each row without repeated nodes, -1 at the end."""
    nodes = -np.sort(-nodes, axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    return -np.sort(-nodes, axis=1)


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, factors: tuple = FACTORS,
          seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (node x degree, -1: none) and the node where searches start, from lifted vectors."""
    n = len(points)
    start = int(np.argmax(points @ points.mean(0)))
    asked = points.copy()
    asked[:, -1] = 0
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    differ = bool((points[:, -1] > 1e-3).any())
    own = degree - ASKED_EDGES if differ else degree
    edges = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for turn, factor in enumerate(factors):
        done = 1 if turn == 0 else 0
        while done < n:
            # The first turn inserts no more nodes at once than the graph has.
            size = min(BATCH, n - done, done if turn == 0 else n)
            at = order[done:done + size]
            kept = [_neighbours(points, edges, start, at, beam, factor, own, points[at])]
            if differ:
                kept.append(_neighbours(points, edges, start, at, beam, factor, ASKED_EDGES, asked[at]))
            edges[at] = _distinct(np.concatenate(kept, 1))
            _add_back(points, edges, at, factor)
            done += size
    return edges, start
