"""A prefix tree of ordered sets, in flat numpy arrays.

Sets are written in one order, the global one from its end: elements with the highest place first, those without a
place by descending hash. Frequent elements come first, so similar sets share long paths.
Runs without branches are one node. A query goes down level by level over all nodes that are still alive:
the overlap with a shared path is counted once, and a subtree is dropped when even its longest set
can't make up what is missing, given how many elements are left on either side.
"""

from __future__ import annotations

import numpy as np


def needed(nx, ny):
    """The smallest overlap of sets of these sizes with 100 * intersection >= 75 * union."""
    return -((-3 * (nx + ny)) // 7)


class PrefixTree:
    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, places=lambda elements: np.zeros(len(elements), np.int64)):
        """sets: arrays of distinct uint64; sizes: of the whole sets (elements that no other set has may be left out);
        places: the places of elements in the global order, 0 for those that go by their hash."""
        lengths = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.universe, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((-np.arange(len(counts)), -places(self.universe)))] = np.arange(len(counts))
        self.rank, self.frequency = rank, counts
        ranked, at = rank[inverse], np.concatenate([[0], np.cumsum(lengths)])
        docs = [np.sort(ranked[at[i] : at[i + 1]]) for i in range(len(sets))]
        order = sorted(range(len(docs)), key=lambda i: docs[i].astype(">i8").tobytes())
        docs = [docs[i] for i in order]
        shared = np.zeros(len(docs) + 1, np.int64)
        for i in range(1, len(docs)):
            k = min(len(docs[i - 1]), len(docs[i]))
            differ = np.flatnonzero(docs[i - 1][:k] != docs[i][:k])
            shared[i] = differ[0] if len(differ) else k
        sizes = np.asarray(sizes, np.int64)[order]
        elements, node_at, node_len, deep, n_min, n_max, last = [], [], [], [], [], [], []
        child_lo, child_hi, ends = [], [], []
        total, queue, head = 0, [(0, len(docs), 0)] if docs else [], 0
        lens = np.array([len(d) for d in docs], np.int64)
        while head < len(queue):
            lo, hi, depth = queue[head]
            head += 1
            common = int(lens[lo]) if hi - lo == 1 else int(min(lens[lo], shared[lo + 1 : hi].min()))
            part = docs[lo][depth:common]
            elements.append(part)
            node_at.append(total)
            node_len.append(len(part))
            last.append(int(part[-1]) if len(part) else -1)
            total += len(part)
            deep.append(int(lens[lo:hi].max()) - common)
            n_min.append(int(sizes[lo:hi].min()))
            n_max.append(int(sizes[lo:hi].max()))
            done = lo  # sets that end here come first in their order
            while done < hi and lens[done] == common:
                done += 1
            ends.append((lo, done))
            child_lo.append(len(queue))
            if done < hi:
                cuts = [done, *(np.flatnonzero(shared[done + 1 : hi] == common) + done + 1).tolist(), hi]
                queue.extend((a, z, common) for a, z in zip(cuts, cuts[1:]))
            child_hi.append(len(queue))
        self.elements = np.concatenate(elements) if elements else np.empty(0, np.int64)
        as_int = lambda x: np.array(x, np.int64)
        self.node_at, self.node_len, self.deep, self.last = map(as_int, (node_at, node_len, deep, last))
        self.n_min, self.n_max, self.child_lo, self.child_hi = map(as_int, (n_min, n_max, child_lo, child_hi))
        ends_ = as_int(ends).reshape(-1, 2)
        self.end_lo, self.end_hi = ends_[:, 0], ends_[:, 1]
        self.order, self.sizes = np.array(order, np.int64), sizes
        self._mark = np.zeros(len(counts) + 1, np.int64)

    def query(self, items: np.ndarray, size: int) -> np.ndarray:
        """Indexes of the sets that link with this one (itself included, if it is in the tree)."""
        if not len(self.node_at) or not len(items):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.universe, items)
        at[at == len(self.universe)] = 0
        mine = self.rank[at[self.universe[at] == items]]
        self._mark[:] = 0
        self._mark[mine] = 1
        upto = np.concatenate([[0], np.cumsum(self._mark)])
        least = -((-3 * size) // 4)
        nodes, over, found = np.array([0]), np.array([0]), []
        while len(nodes):
            n = self.node_len[nodes]
            if n.sum():
                start = np.cumsum(n) - n
                pick = np.repeat(self.node_at[nodes] - start, n) + np.arange(n.sum())
                hits = np.concatenate([[0], np.cumsum(self._mark[self.elements[pick]])])
                over = over + hits[start + n] - hits[start]
            left = np.minimum(self.deep[nodes], len(mine) - upto[self.last[nodes] + 1] if len(mine) else 0)
            left = np.where(self.last[nodes] < 0, self.deep[nodes], left)
            alive = (over + left >= needed(size, np.maximum(self.n_min[nodes], least))) & (self.n_max[nodes] >= least)
            nodes, over = nodes[alive], over[alive]
            n = self.end_hi[nodes] - self.end_lo[nodes]
            if n.sum():
                here = np.repeat(self.end_lo[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append(here[np.repeat(over, n) >= needed(size, self.sizes[here])])
            n = self.child_hi[nodes] - self.child_lo[nodes]
            over = np.repeat(over, n)
            nodes = np.repeat(self.child_lo[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.order[np.concatenate(found)] if found else np.empty(0, np.int64)
