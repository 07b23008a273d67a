"""BK-trees over fingerprints of 64-bit words: many trees at once, as arrays.

A node's children are keyed by their integer Hamming distance to it. A search follows
only those edges whose key lies within the radius of the distance just measured.
"""

from __future__ import annotations

import numpy as np

def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One tree for each group of fingerprints; ``tree[i]`` is the tree of row i of ``values``."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        n = len(values)
        self.keys = 64 * values.shape[1] + 1  # distances 0, 1, ...
        _, first, inverse = np.unique(tree, return_index=True, return_inverse=True)
        self.tree_ids = tree[first]
        self.roots = first
        at = first[inverse]  # the node each fingerprint stands at while it goes down
        waiting = np.setdiff1d(np.arange(n), first)
        edges, nodes = [], []
        while len(waiting):
            key = at[waiting] * self.keys + distances(values[waiting], values[at[waiting]])
            # the first to arrive becomes the child, the others go on below it
            keys, winner, inverse = np.unique(key, return_index=True, return_inverse=True)
            children = waiting[winner]
            edges.append(keys)
            nodes.append(children)
            at[waiting] = children[inverse]
            stay = np.ones(len(waiting), bool)
            stay[winner] = False
            waiting = waiting[stay]
        self.edges = np.concatenate(edges) if edges else np.empty(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        order = np.argsort(self.edges, kind="stable")
        self.edges, self.nodes = self.edges[order], self.nodes[order]

    def search(self, queries: np.ndarray, tree: np.ndarray, radius: int):
        """(query, node) index pairs within the radius, in the query's own tree."""
        place = np.searchsorted(self.tree_ids, tree)
        place[place == len(self.tree_ids)] = 0
        who = np.flatnonzero(self.tree_ids[place] == tree) if len(self.tree_ids) else np.empty(0, np.int64)
        node = self.roots[place[who]] if len(who) else who
        found_q, found_n = [], []
        while len(who):
            distance = distances(queries[who], self.values[node])
            near = distance <= radius
            found_q.append(who[near])
            found_n.append(node[near])
            low = np.searchsorted(self.edges, node * self.keys + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.edges, node * self.keys + np.minimum(distance + radius, self.keys - 1), "right")
            count = high - low
            start = np.cumsum(count) - count
            step = np.arange(count.sum()) - np.repeat(start, count)
            who, node = np.repeat(who, count), self.nodes[np.repeat(low, count) + step]
        if not found_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_n)
