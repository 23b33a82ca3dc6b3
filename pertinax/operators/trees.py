"""Numerics of tree ensembles: random draws, histograms, splits, growing of one subtree, scoring.

Everything here works on the rows of one task.  ``ensembles`` deals rows and trees over the cluster.

A row has one byte per feature, the number of quantile bounds below its value (``MISSING``: none).
Two sums decide a split.  A forest sums the weights of class 0 and of class 1 (Gini impurity); boosting
sums gradients and hessians of the log loss (second-order gain with L1, L2 and a least gain).

Nodes are numbered as in a heap: the root is 1, the children of ``i`` are ``2i`` (value at most the
threshold) and ``2i + 1``.  So a tree is a set of rows ``(node, feature, threshold, value)`` in any
order, and parts of it that grew in different tasks fit together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

MISSING = 255
#: Spark ML's default number of bins.
MAX_BINS = 32
#: Node numbers are 64-bit and levels are counted from 0.
MAX_DEPTH = 60
#: Least gain of a split, relative to what the node contributes: below it lies rounding.
EPS = 1e-10
TINY = 1e-300
#: Bits of each of three sums that fit one exact double.
SUM_BITS = 17

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


@dataclass(frozen=True)
class TreeSpec:
    """Sizes and limits of an ensemble; defaults are those of the production forest."""
    kind: str = "forest"            # forest | boost
    trees: int = 500                # boost: rounds
    depth: int = 20
    min_split: int = 5              # drawn rows a node needs to be split
    min_leaf: int = 2               # drawn rows of either child
    node_columns: float = 0.0       # columns drawn per node: share; 0: the square root (forest), all (boost)
    tree_columns: float = 1.0       # columns drawn per tree: share
    subsample: float = 1.0          # boost: share of rows drawn per round
    bootstrap: bool = True          # forest: Poisson(1) draws per row and tree
    step: float = 0.05
    l2: float = 0.0                 # lambda
    l1: float = 0.0                 # alpha
    min_gain: float = 0.0           # gamma
    min_hessian: float = 0.0        # least sum of hessians in a child
    seed: int = 42


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close numbers get unrelated results."""
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _key(*parts) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = mix(out + np.asarray(p, np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def uniform(*parts) -> np.ndarray:
    """In [0, 1), determined by the parts (numbers or arrays that broadcast)."""
    return (_key(*parts) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def draws(row: np.ndarray, spec: TreeSpec, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree; the row's number and the tree decide."""
    if spec.kind == "forest":
        if not spec.bootstrap:
            return np.ones(len(row))
        return np.searchsorted(_POISSON, uniform(spec.seed, tree, row), "right").astype(np.float64)
    if spec.subsample >= 1:
        return np.ones(len(row))
    return (uniform(spec.seed, tree, row) < spec.subsample).astype(np.float64)


def columns(spec: TreeSpec, tree: int, nodes: np.ndarray, p: int) -> np.ndarray:
    """The features that each node may split on, ascending: one row a node."""
    share = max(1, int(round(spec.tree_columns * p)))
    allowed = np.sort(np.argsort(uniform(spec.seed, tree, -1, np.arange(p)), kind="stable")[:share])
    if spec.node_columns:
        m = max(1, int(spec.node_columns * share))
    else:
        m = max(1, int(math.sqrt(share))) if spec.kind == "forest" else share
    if m >= share:
        return np.broadcast_to(allowed, (len(nodes), share))
    rank = uniform(spec.seed, tree, np.asarray(nodes)[:, None], allowed[None, :])
    return np.sort(allowed[np.argpartition(rank, m - 1, axis=1)[:, :m]], axis=1)


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def goodness(a, b, spec: TreeSpec):
    """What a node contributes to the score of a split; higher is better."""
    if spec.kind == "forest":
        return (a * a + b * b) / np.maximum(a + b, TINY)      # no weight: 0
    under = b + spec.l2
    return np.where(under > 0, soft(a, spec.l1) ** 2 / np.where(under > 0, under, 1), 0.0)


def gain(score, a, b, spec: TreeSpec):
    """The score of the two children over that of their parent."""
    if spec.kind == "forest":
        return score - goodness(a, b, spec)
    return 0.5 * (score - goodness(a, b, spec)) - spec.min_gain


def worth(score, a, b, spec: TreeSpec):
    """The gain of a split; -inf where it is rounding only."""
    g = gain(score, a, b, spec)
    return np.where(g > EPS * (1 + goodness(a, b, spec)), g, -np.inf)


def leaf_value(a, b, spec: TreeSpec):
    """Share of class 1, or the shrunken Newton step."""
    if spec.kind == "forest":
        return np.where(a + b > 0, b / np.where(a + b > 0, a + b, 1), 0.5)
    under = b + spec.l2
    return np.where(under > 0, -spec.step * soft(a, spec.l1) / np.where(under > 0, under, 1), 0.0)


def final(a, b, n, depth: int, spec: TreeSpec):
    """Which nodes are leaves whatever the features say."""
    stop = (n < max(spec.min_split, 2)) | (depth >= spec.depth)
    return stop | (a <= 0) | (b <= 0) if spec.kind == "forest" else stop


def best_bins(h_a, h_b, h_n, spec: TreeSpec):
    """Per node (rows of the histograms): the best bin to split behind and its score; -inf if none."""
    return _best_cuts(*(np.cumsum(h, axis=1) for h in (h_a, h_b, h_n)), spec)


def _best_cuts(a, b, n, spec: TreeSpec):
    """:func:`best_bins` from sums up to and with each bin."""
    ta, tb, tn = (c[:, -1:] for c in (a, b, n))
    least = max(spec.min_leaf, 1)
    a, b, n = (c[:, :-1] for c in (a, b, n))                 # behind the last bin there is nothing
    ra, rb = ta - a, tb - b
    ok = (n >= least) & (tn - n >= least)
    if spec.kind == "boost" and spec.min_hessian > 0:
        ok &= (b >= spec.min_hessian) & (rb >= spec.min_hessian)
    score = np.where(ok, goodness(a, b, spec) + goodness(ra, rb, spec), -np.inf)
    bins = score.argmax(axis=1)
    return bins, score[np.arange(len(bins)), bins]


@dataclass
class Nodes:
    """Rows of a node table; ``feature`` is -1 and ``bin`` 0 in a leaf."""
    node: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    n: np.ndarray


#: Drawn rows from which on a node of a forest is read by itself.
NODE_ROWS = 768
#: Cells that columns of one node may be read as jointly.
JOINT_CELLS = 4096


class Bits:
    """Columns of one table side by side in 64-bit words: a node's columns are read from its rows' words by
    shifts, which is sequential."""

    def __init__(self, x: np.ndarray, bins: int = MAX_BINS):
        p = x.shape[1]
        self.wide = x.max(axis=0, initial=0) > 1       # the other columns have two bins and one cut
        self.bits = np.where(self.wide, max((bins - 1).bit_length(), 1), 1).tolist()
        self.word, self.shift, used = [0] * p, [0] * p, [0]
        for c in range(p):
            if used[-1] + self.bits[c] > 63:
                used.append(0)
            self.word[c], self.shift[c] = len(used) - 1, used[-1]
            used[-1] += self.bits[c]
        self.words = [np.zeros(len(x), np.uint64) for _ in used]
        for s in range(0, len(x), 65_536):
            for c in range(p):
                self.words[self.word[c]][s:s + 65_536] |= x[s:s + 65_536, c].astype(np.uint64) << np.uint64(self.shift[c])

    def of(self, words: list, c: int) -> np.ndarray:
        """A column's bins."""
        return words[self.word[c]] >> np.uint64(self.shift[c]) & np.uint64((1 << self.bits[c]) - 1)

    def sums(self, words: list, values: np.ndarray, drawn: list, out: np.ndarray) -> None:
        """(column, bin) sums of the values; columns are read jointly while their cells are few."""
        most, j = min(JOINT_CELLS, max(len(values) // 4, 32)), 0
        while j < len(drawn):
            cell, of = self.of(words, drawn[j]), j
            size = self.bits[drawn[j]]
            j += 1
            while j < len(drawn) and 1 << (size + self.bits[drawn[j]]) <= most:
                cell <<= np.uint64(self.bits[drawn[j]])
                cell |= self.of(words, drawn[j])
                size += self.bits[drawn[j]]
                j += 1
            h = np.bincount(cell.view(np.int64), values, 1 << size)
            left = size
            for i in range(of, j):
                width = 1 << self.bits[drawn[i]]
                left -= self.bits[drawn[i]]
                out[i, :width] = h if j - of == 1 else h.reshape(-1, width, 1 << left).sum(axis=(0, 2))


def _big_nodes(bits: Bits, rows, place, units, step: int, spec: TreeSpec, tree: int, root: int, bins: int):
    """Splits every node of more than NODE_ROWS drawn rows.  Returns these nodes (and leaves among them) by
    level, and the smaller nodes below them with the places of their rows.  ``step`` rows have sums that fit."""
    packed, unit_a, unit_b = units
    low = (1 << SUM_BITS) - 1
    big, small, out = [(root, place, [w.take(rows) for w in bits.words], packed)], [], []
    depth, p = int(root).bit_length() - 1, len(bits.bits)
    while big:
        nodes = np.array([b[0] for b in big], np.int64)
        drawn = columns(spec, tree, nodes, p)
        first = np.cumsum([0] + [-(-len(b[1]) // step) for b in big])
        h = np.zeros((first[-1], drawn.shape[1], max(bins, 2)))
        for k, (_, _, words, v) in enumerate(big):
            cols = drawn[k].tolist()
            for c, s in enumerate(range(0, len(v), step)):
                part = slice(s, s + step)
                bits.sums([w[part] for w in words], v[part], cols, h[first[k] + c])
        h = h.astype(np.int64)
        a, b, n = (np.add.reduceat(v, first[:-1], axis=0) for v in (h & low, h >> SUM_BITS & low, h >> 2 * SUM_BITS))
        ta, tb, tn = a[:, 0].sum(axis=1) * unit_a, b[:, 0].sum(axis=1) * unit_b, n[:, 0].sum(axis=1)
        k, m = drawn.shape
        a, b, n = (np.cumsum(v.reshape(k * m, -1), axis=1) for v in (a, b, n))
        where, score = _best_cuts(a * unit_a, b * unit_b, n, spec)
        chosen, cut, _ = _chosen(where.reshape(k, m), score.reshape(k, m), drawn, ta, tb, spec)
        stop = final(ta, tb, tn, depth, spec)
        chosen, cut = np.where(stop, -1, chosen), np.where(stop, 0, cut)
        out.append((nodes, chosen, cut, leaf_value(ta, tb, spec), tn))
        below = []
        for (node, at, words, v), c, edge in zip(big, chosen.tolist(), cut.tolist()):
            if c < 0:
                continue
            right = bits.of(words, c) > np.uint64(edge)
            for child, mine in ((2 * node, np.flatnonzero(~right)), (2 * node + 1, np.flatnonzero(right))):
                if len(mine) > NODE_ROWS:
                    below.append((child, at.take(mine), [w.take(mine) for w in words], v.take(mine)))
                else:
                    small.append((child, at.take(mine)))
        big, depth = below, depth + 1
    return out, small


def grow(x: np.ndarray, a: np.ndarray, b: np.ndarray, spec: TreeSpec, tree: int, root: int = 1,
         bins: int = MAX_BINS, rows: np.ndarray | None = None, bits: Bits | None = None) -> Nodes:
    """All nodes at and below ``root`` from its drawn rows: those of ``x``, or the given ones.

    A large node of a forest is read by itself; the small ones grow together, level by level."""
    rows = np.arange(len(a)) if rows is None else rows
    if spec.kind == "boost" and not spec.node_columns:
        return grow_boosted(Columns(x, bins), rows, a, b, spec, tree, root)[0]
    out, p = [], x.shape[1]
    frontier, at = np.array([root], np.int64), np.zeros(len(a), np.int64)
    flat = x.ravel()
    units = _units(a, b) if spec.kind == "forest" else None
    most = 0 if units is None else int(max(a.max(initial=0) / units[1], b.max(initial=0) / units[2], 1) + 0.5)
    if 0 < most <= 32 and len(a) > NODE_ROWS:      # else a few rows would overflow one sum
        bits = bits or Bits(x, bins)
        place = np.arange(len(a))
        out, small = _big_nodes(bits, rows, place, units, ((1 << SUM_BITS) - 1) // most, spec, tree, root, bins)
        small.sort(key=lambda s: s[0])
        frontier = np.array([s[0] for s in small], np.int64)
        at = np.repeat(np.arange(len(small)), [len(s[1]) for s in small])
        take = np.concatenate([s[1] for s in small]) if small else place[:0]
        rows, a, b, units = rows.take(take), a.take(take), b.take(take), (units[0].take(take), *units[1:])
    wide = bits.wide if bits is not None else x.max(axis=0, initial=0) > 1
    depth = np.array([int(n).bit_length() - 1 for n in frontier])
    while len(frontier):
        k = len(frontier)
        ta, tb = np.bincount(at, a, k), np.bincount(at, b, k)
        tn = np.bincount(at, minlength=k)
        best, chosen, cut = np.full(k, -np.inf), np.full(k, -1, np.int64), np.zeros(k, np.int64)
        leaf = final(ta, tb, tn, depth, spec)
        if not leaf.all():
            if leaf.any():
                open_rows = np.flatnonzero((~leaf).take(at))
                rows, a, b, at = (v.take(open_rows) for v in (rows, a, b, at))
                units = units and (units[0].take(open_rows), *units[1:])
            mine, number = np.flatnonzero(~leaf), np.cumsum(~leaf) - 1
            drawn = columns(spec, tree, frontier[mine], p)
            chosen[mine], cut[mine], best[mine] = _split(flat, p, rows, a, b, number[at], drawn, ta[mine], tb[mine], tn[mine],
                                                         spec, bins, wide, units)
        out.append((frontier, chosen, cut, leaf_value(ta, tb, spec), tn))
        split = chosen >= 0
        if not split.all():
            keep = np.flatnonzero(split.take(at))
            rows, a, b, at = (v.take(keep) for v in (rows, a, b, at))
            units = units and (units[0].take(keep), *units[1:])
        right = flat.take(rows * p + chosen.take(at)) > cut.take(at)
        number = 2 * np.cumsum(split) - 2
        at = number.take(at) + right
        frontier = np.stack([2 * frontier[split], 2 * frontier[split] + 1], axis=1).ravel()
        depth = np.repeat(depth[split] + 1, 2)
    out = [np.concatenate(c) for c in zip(*out)]
    order = np.argsort(out[0], kind="stable")
    return Nodes(*(c[order] for c in out))


def _units(a, b):
    """How often each row counts for class 0 and class 1 and the weights of both, if a class has one weight."""
    out = []
    for v in (a, b):
        some = v[v > 0]
        unit = float(some.min()) if len(some) else 1.0
        times = np.rint(v / unit)
        if not np.array_equal(times * unit, v):
            return None
        out.append((times, unit))
    return (out[0][0] + out[1][0] * 2.0 ** SUM_BITS + 2.0 ** (2 * SUM_BITS)), out[0][1], out[1][1]


def _split(flat, p: int, rows, a, b, at, drawn, ta, tb, tn, spec: TreeSpec, bins: int, wide, units):
    """The best split of each node (feature, bin, gain; feature -1 if none), from the columns drawn for it.

    A column that is not wide takes two cells.  Where each class has one weight, the three sums of a
    cell are added up as one number."""
    k, m = drawn.shape
    broad = wide[drawn].ravel()
    many = int(broad.sum())
    start = np.where(broad, (np.cumsum(broad) - 1) * bins, many * bins + (np.cumsum(~broad) - 1) * 2).reshape(k, m)
    size = many * bins + (k * m - many) * 2
    cell, base = np.empty((m, len(rows)), np.int64), rows * p
    for j, (first, column) in enumerate(zip(np.ascontiguousarray(start.T), np.ascontiguousarray(drawn.T))):
        np.take(first, at, out=cell[j], mode="clip")
        cell[j] += flat.take(base + column.take(at))
    once = units is not None and max(ta.max() / units[1], tb.max() / units[2], tn.max()) < 2 ** SUM_BITS - 1
    values = [units[0]] if once else [a, b, None]
    if size <= 2 * len(rows):
        sums = [sum(np.bincount(c, w, size) for c in cell) for w in values]
    else:
        sums = [np.bincount(cell.ravel(), None if w is None else np.tile(w, m), size) for w in values]
    sums = [s.astype(np.int64) if once else s for s in sums]
    where, score = np.zeros(k * m, np.int64), np.full(k * m, -np.inf)
    for of, part, width in ((broad, slice(0, many * bins), bins), (~broad, slice(many * bins, size), 2)):
        c = [np.cumsum(s[part].reshape(-1, width), axis=1) for s in sums]
        if not len(c[0]):
            continue
        if once:
            low = (1 << SUM_BITS) - 1
            c = [(c[0] & low) * units[1], ((c[0] >> SUM_BITS) & low) * units[2], c[0] >> (2 * SUM_BITS)]
        where[of], score[of] = _best_cuts(*c, spec)
    where, score = where.reshape(k, m), score.reshape(k, m)
    return _chosen(where, score, drawn, ta, tb, spec)


def _chosen(where, score, drawn, ta, tb, spec: TreeSpec):
    node, top = np.arange(len(score)), score.argmax(axis=1)
    best = worth(score[node, top], ta, tb, spec)
    good = best > -np.inf
    return np.where(good, drawn[node, top], -1), np.where(good, where[node, top], 0), best


class Columns:
    """Histograms of columns that all nodes share, for any rows of one table.  Columns are read jointly:
    while nodes are few, two wide ones as one and ten of two bins as one; then each wide one and five."""

    def __init__(self, x: np.ndarray, bins: int = MAX_BINS):
        self.n, self.p, self.bins, self.flat = len(x), x.shape[1], bins, x.ravel()
        self.is_wide = x.max(axis=0, initial=0) > 1
        wide, narrow = np.flatnonzero(self.is_wide), np.flatnonzero(~self.is_wide)
        self.joint = [self._join(x, wide, narrow, many, ten) for many, ten in ((2, 10), (1, 5))]

    def _join(self, x, wide, narrow, many: int, ten: int):
        out = []
        for features, size, base in ((wide, many, max(self.bins, 3)), (narrow, ten, 2)):
            for s in range(0, len(features), size):
                f = features[s:s + size]
                joint = np.zeros(self.n, np.int16)
                for c in f:
                    joint = joint * np.int16(base) + x[:, c]
                out.append((f, base, joint))
        return out

    def sums(self, rows, values: list, slot, k: int, allowed: np.ndarray) -> np.ndarray:
        """(value, node, cell): sums of each value, ``None`` counts.  Cells are the bins of each allowed
        wide column, then bin 0 of each other allowed column; columns ascend."""
        wide, narrow = np.flatnonzero(allowed & self.is_wide), np.flatnonzero(allowed & ~self.is_wide)
        out = np.empty((len(values), k, len(wide) * self.bins + len(narrow)))
        of_wide = out[:, :, :len(wide) * self.bins].reshape(len(values), k, len(wide), self.bins)
        of_narrow = out[:, :, len(wide) * self.bins:]
        few = k * self.bins * self.bins <= max(len(rows), 4096)
        for features, base, joint in self.joint[0 if few else 1]:
            mine = allowed[features]
            if not mine.any():
                continue
            size = base ** len(features)
            cell = slot * size
            cell += joint if len(rows) == self.n else joint.take(rows)
            if base == 2:
                bits = np.arange(size)[:, None] >> np.arange(len(features))[::-1]
                zero, to = 1.0 - (bits[:, mine] & 1), np.searchsorted(narrow, features[mine])
            for v, w in enumerate(values):
                h = np.bincount(cell, w, k * size)
                if base == 2:
                    of_narrow[v][:, to] = h.reshape(k, size) @ zero
                elif len(features) == 1:
                    of_wide[v, :, np.searchsorted(wide, features[0])] = h.reshape(k, size)
                else:
                    h = h.reshape(k, base, base)
                    for j in np.flatnonzero(mine):
                        of_wide[v, :, np.searchsorted(wide, features[j])] = h.sum(axis=2 - j)
        return out


def _on_grid(v: np.ndarray) -> np.ndarray:
    """The values as multiples of one power of two, fine enough (2^-52 of their sum) to lose nothing that counts
    and coarse enough that any sum or difference of sums is exact, in any order.  No value becomes 0."""
    total = float(np.abs(v).sum())
    if not 0 < total < math.inf:
        return v
    unit = 2.0 ** max(math.frexp(total)[1] - 52, -1000)
    out = np.rint(v / unit)
    return np.where((out == 0) & (v != 0), np.sign(v), out) * unit


#: Cells of one level's histograms that are kept for the next.
KEEP_CELLS = 4_000_000


def grow_boosted(table: Columns, rows, a, b, spec: TreeSpec, tree: int, root: int = 1) -> tuple[Nodes, np.ndarray]:
    """All nodes at and below ``root`` from its drawn rows (numbers of rows of the table), and the value of
    the leaf that each row comes to.

    Of two children only the smaller is read; the other is what is left of their parent's sums, which is
    exact, as the sums are.  The sums of nodes come from their parent's cut."""
    out, worth_of, place = [], np.zeros(len(rows)), np.arange(len(rows))
    a, b = _on_grid(a), _on_grid(b)
    counted = max(spec.min_leaf, 1) > 1 or not (b > 0).all()     # else a side has rows if it has hessians
    drawn = columns(spec, tree, np.array([root]), table.p)[0]
    allowed = np.zeros(table.p, bool)
    allowed[drawn] = True
    wide, narrow = np.flatnonzero(allowed & table.is_wide), np.flatnonzero(allowed & ~table.is_wide)
    cells = len(wide) * table.bins + len(narrow)
    frontier, at, depth = np.array([root], np.int64), np.zeros(len(rows), np.int64), int(root).bit_length() - 1
    ta, tb, tn = a.sum(keepdims=True), b.sum(keepdims=True), np.array([len(rows)])
    before = None                                               # the sums of the parents, in order
    while len(frontier):
        k = len(frontier)
        chosen, cut = np.full(k, -1, np.int64), np.zeros(k, np.int64)
        left = np.zeros((2, k))
        leaf = final(ta, tb, tn, depth, spec)
        here = None
        if not leaf.all():
            mine = np.flatnonzero(~leaf)
            step = max(1, KEEP_CELLS // max(cells, 1))
            if len(mine) <= step:
                here = _level(table, rows, a, b, at, leaf, tn, before, allowed, counted, k)
                found = [_cuts(table, here, wide, narrow, ta[mine], tb[mine], tn[mine], counted, spec)]
            else:                                               # part by part; nothing is kept
                number, found = np.cumsum(~leaf) - 1, []
                for s in range(0, len(mine), step):
                    some = mine[s:s + step]
                    r = np.flatnonzero(~leaf[at] & (number[at] >= s) & (number[at] < s + step))
                    h = table.sums(rows[r], [a[r], b[r]] + [None] * counted, number[at[r]] - s, len(some), allowed)
                    found.append(_cuts(table, h, wide, narrow, ta[some], tb[some], tn[some], counted, spec))
            chosen[mine], cut[mine], left[0, mine], left[1, mine] = (np.concatenate(c) for c in zip(*found))
        value = leaf_value(ta, tb, spec)
        out.append((frontier, chosen, cut, value, tn))
        split = chosen >= 0
        if not split.all():
            goes = split.take(at)
            ends, keep = np.flatnonzero(~goes), np.flatnonzero(goes)
            worth_of[place.take(ends)] = value.take(at.take(ends))
            place, rows, a, b, at = (v.take(keep) for v in (place, rows, a, b, at))
        if here is not None:
            before = here[:, split[~leaf]]
        else:
            before = None
        right = table.flat.take(rows * table.p + chosen.take(at)) > cut.take(at)
        at = (2 * np.cumsum(split) - 2).take(at) + right
        frontier = np.stack([2 * frontier[split], 2 * frontier[split] + 1], axis=1).ravel()
        ta, tb = (np.stack([v[split], t[split] - v[split]], axis=1).ravel() for v, t in zip(left, (ta, tb)))
        tn = np.bincount(at, minlength=len(frontier))
        depth += 1
    return Nodes(*(np.concatenate(c) for c in zip(*out))), worth_of


def _level(table: Columns, rows, a, b, at, leaf, tn, before, allowed, counted: bool, k: int) -> np.ndarray:
    """The sums of the nodes of a level that are no leaves; ``before`` has those of their parents."""
    if before is None:
        number = np.cumsum(~leaf) - 1
        r = np.flatnonzero(~leaf[at]) if leaf.any() else slice(None)
        return table.sums(rows[r], [a[r], b[r]] + [None] * counted, number[at[r]], k - int(leaf.sum()), allowed)
    pairs = ~(leaf[::2] & leaf[1::2])
    number = np.cumsum(pairs) - 1
    is_right = tn[1::2] < tn[::2]                               # the smaller child
    lesser = np.zeros(k, bool)
    lesser[2 * np.flatnonzero(pairs) + is_right[pairs]] = True
    r = np.flatnonzero(lesser.take(at))
    small = table.sums(rows.take(r), [a.take(r), b.take(r)] + [None] * counted, number.take(at.take(r) >> 1), int(pairs.sum()), allowed)
    both = np.empty((len(small), small.shape[1], 2, small.shape[2]))
    where, side = np.arange(small.shape[1]), is_right[pairs].astype(np.int64)
    both[:, where, side] = small
    both[:, where, 1 - side] = before[:, pairs] - small
    return both.reshape(len(small), -1, small.shape[2])[:, ~leaf[np.repeat(pairs, 2)]]


def _cuts(table: Columns, h, wide, narrow, ta, tb, tn, counted: bool, spec: TreeSpec):
    """Of each node: feature (-1 if none), bin and both sums left of its best cut."""
    k, edge = len(ta), len(wide) * table.bins
    least = max(spec.min_leaf, 1)
    kinds = []
    if len(wide):
        kinds.append((wide, np.cumsum(h[:, :, :edge].reshape(len(h), k, len(wide), table.bins), axis=3)[..., :-1]))
    if len(narrow):
        kinds.append((narrow, h[:, :, edge:, None]))
    features = np.concatenate([wide, narrow])
    order = np.argsort(features, kind="stable")
    score, where, la, lb = (np.empty((k, len(features))) for _ in range(4))
    start = 0
    for f, s in kinds:
        a, b = s[0], s[1]
        ra, rb = ta[:, None, None] - a, tb[:, None, None] - b
        if counted:
            ok = (s[2] >= least) & (tn[:, None, None] - s[2] >= least)
        else:
            ok = (b > 0) & (rb > 0)
        if spec.min_hessian > 0:
            ok &= (b >= spec.min_hessian) & (rb >= spec.min_hessian)
        of = np.where(ok, goodness(a, b, spec) + goodness(ra, rb, spec), -np.inf)
        best = of.argmax(axis=2)[:, :, None]
        part = slice(start, start + len(f))
        where[:, part] = best[:, :, 0]
        for target, v in ((score, of), (la, a), (lb, b)):
            target[:, part] = np.take_along_axis(v, best, 2)[:, :, 0]
        start += len(f)
    score = score[:, order]
    node, top = np.arange(k), score.argmax(axis=1)
    good = worth(score[node, top], ta, tb, spec) > -np.inf
    top = order[top]
    return (np.where(good, features[top], -1), np.where(good, where[node, top], 0).astype(np.int64),
            la[node, top], lb[node, top])


class Packed:
    """Trees as flat arrays, for scoring: children stand side by side.

    A value is compared by its place among the bounds of its feature; what a step needs to know of a
    node (first child, column, place of its bound) is one number.  A leaf leads to itself."""

    def __init__(self, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, bound: np.ndarray, value: np.ndarray):
        order = np.lexsort((node, tree))
        tree, node = tree[order], node[order]
        feature, bound = feature[order].astype(np.int64), bound[order]
        self.value = value[order].astype(np.float64)
        self.trees, self.root = np.unique(tree, return_index=True)
        end = np.append(self.root[1:], len(node))
        self.levels = [int(node[s:e].max()).bit_length() - 1 for s, e in zip(self.root, end)]
        inner = feature >= 0
        left, column, place = np.arange(len(node)), np.zeros(len(node), np.int64), np.full(len(node), 0xFFFF)
        for start, stop in zip(self.root, end):
            mine = start + np.flatnonzero(inner[start:stop])
            left[mine] = start + np.searchsorted(node[start:stop], 2 * node[mine])
        self.features, column[inner] = np.unique(feature[inner], return_inverse=True)
        self.ends = []
        for c in range(len(self.features)):
            mine = np.flatnonzero(inner & (column == c))
            ends, place[mine] = np.unique(bound[mine], return_inverse=True)
            self.ends.append(ends)
        if max([len(self.ends), *map(len, self.ends)]) >= 0xFFFF:
            raise ValueError("a step holds 65,534 columns and as many bounds of each")
        self.step = left << 32 | column << 16 | place

    def _places(self, x: np.ndarray) -> np.ndarray:
        """Columns by rows: how many bounds of its feature lie below each value."""
        out = np.empty((max(len(self.ends), 1), len(x)), np.uint16)
        for c, (f, ends) in enumerate(zip(self.features, self.ends)):
            if x.dtype == np.uint8:
                out[c] = np.searchsorted(ends, np.arange(256)).astype(np.uint16)[x[:, f]]
            else:
                out[c] = np.searchsorted(ends, x[:, f])
        return out

    def leaves(self, places: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of every row in one tree."""
        n, flat, step = places.shape[1], places.ravel(), self.step
        out = at = np.full(n, self.root[tree], np.int64)
        row, all_rows = np.arange(n), True
        for level in range(self.levels[tree]):
            if level % 4 == 0 and level:
                moving = np.flatnonzero((step[at] & 0xFFFF) != 0xFFFF)
                if len(moving) < 0.75 * len(at):
                    if all_rows:
                        out, all_rows = at.copy(), False
                    else:
                        out[row] = at
                    row, at = row[moving], at[moving]
            s = step[at]
            at = (s >> 32) + (flat[(s >> 16 & 0xFFFF) * n + row] > (s & 0xFFFF))
        if all_rows:
            return at
        out[row] = at
        return out

    def sums(self, x: np.ndarray, rows: int = 8192) -> np.ndarray:
        """Sum of the trees' values per row."""
        out = np.zeros(len(x))
        for k in range(0, len(x), rows):
            places = self._places(x[k:k + rows])
            for tree in range(len(self.root)):
                out[k:k + rows] += self.value[self.leaves(places, tree)]
        return out


def route(x: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node that each row has come to in a tree whose splits so far are given (nodes ascending)."""
    at = np.ones(len(x), np.int64)
    active = np.arange(len(x)) if len(node) else np.zeros(0, np.int64)
    while len(active):
        k = np.searchsorted(node, at[active])
        k[k == len(node)] = 0
        found = node[k] == at[active]
        active, k = active[found], k[found]
        at[active] = 2 * at[active] + (x[active, feature[k]] > cut[k])
    return at


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
