"""Tandem repeats of integer sequences by the linear-time method of Gusfield and Stoye.

Three phases over strings that are joined with separators, each of them unique, so that nothing matches across them:

1. The Lempel-Ziv blocks of a string, and for each block, by longest common extensions from its borders, pairs (start,
   root length) of squares that cover the leftmost occurrence of every square.
2. The pairs' end points are marked in the suffix tree.
3. From each mark a walk over suffix links visits the rotations of the square, until one isn't there or is marked already.
   Then the whole vocabulary of squares is marked, and the leaves below a mark are all its occurrences.

Squares whose root is itself a power are left out from the start: their occurrences are those of shorter squares.
"""

from __future__ import annotations

import numpy as np


class Names:
    """Names of all substrings of length 1, 2, 4, ...: equal names, equal substrings, and names sort as substrings do."""

    def __init__(self, text: np.ndarray) -> None:
        """``text`` ends with an element that is nowhere else, or its suffixes can't be told apart."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank.astype(np.int32)]
        while n and rank.max() + 1 < n:
            step = 1 << (len(self.levels) - 1)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.levels.append(rank.astype(np.int32))
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.rank = rank

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of positions ``a`` and ``b``, which differ."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a += same
            b += same
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the left, positions ``a`` and ``b`` included; -1 is before the start."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            from_a, from_b = a - (1 << k) + 1, b - (1 << k) + 1
            same = (from_a >= 0) & (from_b >= 0)
            same &= self.levels[k][np.maximum(from_a, 0)] == self.levels[k][np.maximum(from_b, 0)]
            a -= same.astype(np.int64) << k
            b -= same.astype(np.int64) << k
        return start - a

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """One number for each substring of a length: substrings of equal length have equal numbers if they are equal."""
        level = np.frexp(length)[1] - 1
        made = np.empty(len(start), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            made[at] = self.levels[k][start[at]].astype(np.int64) * (len(self.rank) + 1) + self.levels[k][start[at] + length[at] - (1 << k)]
        return made


def longest_previous(names: Names) -> np.ndarray:
    """For each position, the length of the longest factor that also starts further left."""
    order = names.order.tolist()
    n = len(order)
    stack: list[int] = []
    left, right = [-1] * n, [-1] * n
    for p in order:
        while stack and stack[-1] > p:
            right[stack.pop()] = p
        if stack:
            left[p] = stack[-1]
        stack.append(p)
    longest = np.zeros(n, np.int64)
    for other in (np.array(left, np.int64), np.array(right, np.int64)):
        at = np.flatnonzero(other >= 0)
        longest[at] = np.maximum(longest[at], names.ahead(at, other[at]))
    return longest


def lz_blocks(longest: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, end of the next block) of the Lempel-Ziv blocks of the strings [starts, ends)."""
    step = np.maximum(longest, 1).tolist()
    blocks = []
    for at, end in zip(starts.tolist(), ends.tolist(), strict=True):
        cuts = []
        while at < end:
            cuts.append(at)
            at += step[at]
        cuts += [end, end]
        blocks += zip(cuts, cuts[1:], cuts[2:], strict=False)
    return np.array(blocks, np.int64).reshape(-1, 3)


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes, the group of each member and its number in the group, from 1."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def covering_pairs(names: Names, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (start, root length) of squares so that the leftmost occurrence of every square is a pair or right of one by
    shifts through squares."""
    first, then, last = blocks.T
    found = []
    group, k = _counted(then - first)
    border = then[group]
    at = border - k
    ahead, behind = names.ahead(border, at), names.behind(border - 1, at - 1)
    start = np.maximum(at - behind, at - k + 1)
    good = (ahead + behind >= k) & (ahead > 0)
    found.append((start[good], k[good]))
    group, k = _counted(last - first)
    border = first[group]
    at = border + k
    ahead, behind = names.ahead(border, at), names.behind(border - 1, at - 1)
    start = np.maximum(border - behind, border - k + 1)
    good = (ahead + behind >= k) & (ahead > 0) & (behind > 0) & (start + k <= then[group])
    found.append((start[good], k[good]))
    start, k = (np.concatenate(x) for x in zip(*found, strict=True))
    primitive = _primitive(names, start, k)
    return start[primitive], k[primitive]


def _primitive(names: Names, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the root of the square at ``start`` is no power of a shorter word."""
    good, left = np.ones(len(k), bool), k.copy()
    least = np.arange(int(k.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            least[p * p :: p] = np.minimum(least[p * p :: p], p)
    while (at := np.flatnonzero(left > 1)).size:
        prime = least[left[at]]
        part = k[at] // prime
        good[at] &= names.ahead(start[at], start[at] + part) < 2 * k[at] - part
        left[at] //= prime
    return good


class SuffixTree:
    """The suffix tree of a text as arrays. Leaves are 0 to n - 1 in suffix order, the root is n, inner nodes follow."""

    def __init__(self, text: np.ndarray, names: Names) -> None:
        order, n = names.order, len(text)
        self.text, self.order, self.n = text, order, n
        shared = np.zeros(n + 1, np.int64)
        if n > 1:
            shared[1:n] = names.ahead(order[:-1], order[1:])
        parent, depth, low, high, least = [0] * (n + 1), (n - order).tolist() + [0], list(range(n)) + [0], list(range(n)) + [n - 1], order.tolist() + [n]
        stack = [n]
        for leaf, d in enumerate(shared[1:].tolist()):
            # The path from the root to the leaf; what is deeper than its border with the next leaf is complete.
            done = leaf
            while depth[stack[-1]] > d:
                node = stack.pop()
                parent[done] = node
                least[node] = min(least[node], least[done])
                high[node], done = leaf, node
            if depth[stack[-1]] < d:
                parent.append(0)
                depth.append(d)
                low.append(low[done])
                high.append(leaf)
                least.append(n)
                stack.append(len(parent) - 1)
            parent[done] = stack[-1]
            least[stack[-1]] = min(least[stack[-1]], least[done])
        self.parent, self.depth, self.low, self.high, self.least = parent, depth, low, high, least
        self._link(names)

    def _link(self, names: Names) -> None:
        """Children by first element, and the suffix links of the inner nodes."""
        n, size = self.n, len(self.parent)
        parent, depth = np.array(self.parent), np.array(self.depth)
        at = self.order[np.array(self.low)]
        nodes = np.delete(np.arange(size), n)
        self.width = int(self.text.max(initial=0)) + 1
        first = self.text[at[nodes] + depth[parent[nodes]]]
        self.child = dict(zip((parent[nodes] * self.width + first).tolist(), nodes.tolist(), strict=True))
        inner = np.arange(n + 1, size)
        self.link = [n] * size
        deep = inner[depth[inner] > 1]
        if len(deep):
            own = names.of(at[inner], depth[inner])
            wanted = names.of(at[deep] + 1, depth[deep] - 1)
            lengths, words = np.concatenate([depth[inner], depth[deep] - 1]), np.concatenate([own, wanted])
            asks = np.arange(len(words)) >= len(inner)
            by = np.lexsort((asks, words, lengths))
            last = np.maximum.accumulate(np.where(asks[by], -1, np.arange(len(by))))
            for node, to in zip(deep[by[asks[by]] - len(inner)].tolist(), inner[by[last[asks[by]]]].tolist(), strict=True):
                self.link[node] = to


def vocabulary(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phases 2 and 3: (node, root length) of every square that covering pairs cover; the square ends on the edge to the node."""
    parent, depth, least = tree.parent, tree.depth, tree.least
    marks: dict[tuple[int, int], None] = {}
    by = np.lexsort((k, start))
    start, k = start[by], k[by]
    cuts = np.flatnonzero(np.diff(start, prepend=-1))
    rank = np.empty(tree.n, np.int64)
    rank[tree.order] = np.arange(tree.n)
    for position, node, lengths in zip(start[cuts].tolist(), rank[start[cuts]].tolist(), np.split(k, cuts[1:]), strict=True):
        left = lengths.tolist()
        # Up from the leaf, as long as no smaller position lies below: a square further up occurs further left.
        while left and least[node] == position:
            above = depth[parent[node]]
            while left and 2 * left[-1] > above:
                marks[node, left.pop()] = None
            node = parent[node]
    for mark in list(marks):
        _rotate(tree, *mark, marks)
    found = np.array(list(marks), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _rotate(tree: SuffixTree, node: int, k: int, marks: dict) -> None:
    """Mark the rotations of a marked square to the right, as far as they occur and are new."""
    text, order, parent, depth, low, link, child, width = tree.text, tree.order, tree.parent, tree.depth, tree.low, tree.link, tree.child, tree.width
    size = 2 * k
    while True:
        at = order[low[node]]
        above = link[parent[node]]
        done = depth[above]
        below = above
        # Down by whole edges to where the square without its first element ends.
        while done < size - 1:
            below = child[above * width + text[at + 1 + done]]
            if depth[below] > size - 1:
                break
            above, done = below, depth[below]
        if done == size - 1:
            found = child.get(above * width + text[at])
            if found is None:
                return
            below = found
        elif text[order[low[below]] + size - 1] != text[at]:
            return
        if (below, k) in marks:
            return
        marks[below, k] = None
        node = below


def runs(strings: list[np.ndarray], min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (string, start, length, period) of the maximal runs of at least ``min_length`` elements and ``min_exponent`` (2 or
    more) periods, period being the smallest, ordered by string, start and period."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if not len(strings):
        return np.empty((0, 4), np.int64)
    joined = np.concatenate([np.append(s, -1) for s in strings])
    text = np.unique(joined, return_inverse=True)[1].astype(np.int64)
    text[ends] = text.max() + 1 + np.arange(len(ends))
    names = Names(text)
    start, k = covering_pairs(names, lz_blocks(longest_previous(names), starts, ends))
    if not len(k):
        return np.empty((0, 4), np.int64)
    tree = SuffixTree(text, names)
    node, k = vocabulary(tree, start, k)
    low, high = np.array(tree.low)[node], np.array(tree.high)[node]
    which, nth = _counted(high - low + 1)
    at, period = names.order[low[which] + nth - 1], k[which]
    # Squares of one period at neighbouring positions are one run.
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(period, prepend=0) != 0))
    last = np.append(new[1:], len(at)) - 1
    start, period = at[new], period[new]
    length = at[last] - start + 2 * period
    long = (length >= np.maximum(min_length, min_exponent * period)).nonzero()[0]
    of = np.searchsorted(starts, start[long], "right") - 1
    found = np.stack([of, start[long] - starts[of], length[long], period[long]], axis=1)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
