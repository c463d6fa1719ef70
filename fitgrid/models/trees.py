"""Classification trees and forests with exact Gini cuts, of any depth.

Large nodes grow level by level, all trees in the same passes. A pass counts classes per node, feature
and bin between common quantiles; every bin border is a candidate. A better cut can hide inside a bin
only if the bound for it (least impurity over the corners of the bin's class counts, impurity being
concave) does not exceed the best border's, and only such bins are looked at value by value, or cut
again where they hold too many rows. So a level costs a scan of counts and one of a few bins, and the cut
found is the best among all values.

A node whose rows fit a task is finished there, to the end. A model has the top of every tree, whose
size is bounded by the number of large nodes, and a written table of finished subtrees.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sums import rows_as_matrix
from ..plans.vectors import complete_vectors
from ..session import materialise
from .kmeans import PRIME, _key_halves, draw_factors
from .svm import as_array

SUBTREE_VALUES = 1 << 20
BINS = 256
INSIDE_ROWS = 1 << 20
NODES_AT_ONCE = 256
CORNER_CLASSES = 8
DIGITS = 12
MODEL_NODES = 1 << 20
ROWS_PER_COPY = 1 << 20
LEAF = -1


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def root_name(seed: int, tree: int) -> str:
    """Nodes are named by hashes: a child by its parent's name and L or R."""
    return _md5(f"{seed}:{tree}")


def feature_order(name: str, width: int) -> list[int]:
    """The order in which a node of a forest looks at features."""
    return sorted(range(width), key=lambda f: _md5(f"{name}:{f}"))


#: Chances of drawing a row at most 0, 1, … times in a sample with replacement of a large table's own size.
DRAWN = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def draws(h0: np.ndarray, h1: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample, from the two halves of its key's hash."""
    f0, f1 = draw_factors(seed, tree)
    share = (h0 * f0 % PRIME + (h1 * f1 % PRIME + 0.5) / PRIME) / PRIME
    return np.searchsorted(DRAWN, share, side="right").astype(np.float64)


def middle(low: float, high: float) -> float:
    """The border between two neighbouring values; rows up to it go left."""
    found = low + (high - low) / 2
    return found if low <= found < high else low


def impurity(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Mean Gini impurity of both sides for class counts on the left, one row each."""
    right = total - left
    n_left, n_right = left.sum(axis=-1), right.sum(axis=-1)
    parts = [n - np.divide(np.square(s).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0) for s, n in ((left, n_left), (right, n_right))]
    return (parts[0] + parts[1]) / total.sum()


@dataclass(frozen=True)
class Cut:
    """The best cut seen: rows with ``value`` and less go left; ``after`` is the next value."""

    score: float
    value: float
    after: float
    left: tuple

    @property
    def border(self) -> float:
        return middle(self.value, self.after)


def best_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, before: np.ndarray, total: np.ndarray) -> Cut | None:
    """Best cut between neighbouring values of ``x``; ``before`` are class counts left of them all.

    Sums of squared class counts on both sides follow from running sums, so classes cost nothing.
    """
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    cuts = np.flatnonzero(x[:-1] < x[1:])
    if not len(cuts):
        return None
    by_class = np.argsort(y, kind="stable")
    sums = np.cumsum(w[by_class]) - w[by_class]
    starts = np.flatnonzero(np.diff(y[by_class], prepend=-1))
    prior = np.empty(len(x))
    prior[by_class] = sums - np.repeat(sums[starts], np.diff(starts, append=len(x)))
    squares = np.square(before).sum() + np.cumsum(w * (2 * (before[y] + prior) + w))
    mixed = (total * before).sum() + np.cumsum(total[y] * w)
    n_left = before.sum() + np.cumsum(w)
    n = total.sum()
    n_right = n - n_left
    rest = np.square(total).sum() - 2 * mixed + squares
    score = (n_left[cuts] - squares[cuts] / n_left[cuts] + n_right[cuts] - rest[cuts] / n_right[cuts]) / n
    pick = int(np.round(score, DIGITS).argmin())
    at = cuts[pick]
    left = before + np.bincount(y[: at + 1], weights=w[: at + 1], minlength=len(total))
    return Cut(float(score[pick]), float(x[at]), float(x[at + 1]), tuple(left))


@dataclass
class Plan:
    """What decides how trees grow."""

    classes: int
    width: int
    trees: int
    tried: int
    depth: int | None
    seed: int
    bootstrap: bool

    def order(self, name: str) -> Sequence[int]:
        return range(self.width) if self.tried >= self.width else feature_order(name, self.width)

    def choose(self, name: str, cuts: dict[int, Cut]) -> tuple[int, Cut] | None:
        """The best of the first ``tried`` features that vary; the first feature on ties."""
        varying = [f for f in self.order(name) if f in cuts][: self.tried]
        if not varying:
            return None
        feature = min(varying, key=lambda f: (round(cuts[f].score, DIGITS), f))
        return feature, cuts[feature]

    def ends(self, counts: np.ndarray, depth: int) -> bool:
        return int((counts > 0).sum()) <= 1 or (self.depth is not None and depth >= self.depth)

    def weights(self, batch: pa.RecordBatch, tree: int) -> np.ndarray:
        if not self.bootstrap:
            return np.ones(batch.num_rows)
        return draws(*(batch.column(h).to_numpy() for h in ("h0", "h1")), self.seed, tree)


@dataclass
class Nodes:
    """A tree, or the part of one that a task finishes; ``counts`` are class weights of every node."""

    feature: list[int] = field(default_factory=list)
    border: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def add(self, name: str, depth: int, counts: np.ndarray) -> int:
        self.feature.append(LEAF)
        self.border.append(0.0)
        self.left.append(-1)
        self.name.append(name)
        self.depth.append(depth)
        self.counts.append(counts)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: Cut) -> tuple[int, int]:
        """Two children side by side."""
        left, name, below = np.array(cut.left), self.name[node], self.depth[node] + 1
        self.feature[node], self.border[node] = feature, cut.border
        self.left[node] = self.add(_md5(name + "L"), below, left)
        return self.left[node], self.add(_md5(name + "R"), below, self.counts[node] - left)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.border), np.array(self.left)


def walk(points: np.ndarray, arrays: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of the node without children that each row reaches."""
    feature, border, left = arrays
    at = np.zeros(len(points), dtype=np.int64)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        here = at[going]
        at[going] = left[here] + (points[going, feature[here]] > border[here])
        going = going[feature[at[going]] >= 0]
    return at


def by_place(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows at each place."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    return zip(places.tolist(), np.split(order, first[1:]))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, plan: Plan, name: str, depth: int) -> Nodes:
    """The whole subtree over rows in memory; a stack instead of recursion, so depth is free."""
    nodes = Nodes()
    nodes.add(name, depth, np.bincount(y, weights=w, minlength=plan.classes))
    stack = [(0, np.arange(len(y)))]
    none = np.zeros(plan.classes)
    while stack:
        node, rows = stack.pop()
        total = nodes.counts[node]
        if plan.ends(total, nodes.depth[node]):
            continue
        cuts = {}
        for f in plan.order(nodes.name[node]):
            if len(cuts) == plan.tried:
                break
            cut = best_cut(x[rows, f], y[rows], w[rows], none, total)
            if cut:
                cuts[f] = cut
        found = plan.choose(nodes.name[node], cuts)
        if not found:
            continue
        low, high = nodes.split(node, *found)
        goes_left = x[rows, found[0]] <= nodes.border[node]
        stack += [(low, rows[goes_left]), (high, rows[~goes_left])]
    return nodes


@dataclass
class Part:
    """Values of one feature in one node above ``low`` and up to ``high``, with what lies left of them."""

    tree: int
    node: int
    feature: int
    low: float
    high: float
    before: np.ndarray
    cuts: np.ndarray | None = None


class Grower:
    """Grows the tops of all trees over ``rows`` (x, y, h0, h1)."""

    def __init__(self, rows: DataFrame, plan: Plan, subtree_rows: int, inside_rows: int, bins: int):
        self.rows, self.plan = rows, plan
        self.subtree_rows, self.inside_rows, self.bins = subtree_rows, inside_rows, bins
        self.tops = [Nodes() for _ in range(plan.trees)]
        self.small: list[tuple[int, int]] = []
        self.open: list[tuple[int, int]] = []

    def grow(self) -> None:
        for tree, counts in enumerate(self._roots()):
            self._place(tree, self.tops[tree].add(root_name(self.plan.seed, tree), 0, counts))
        if self.open:
            self.quantiles = self._quantiles()
        while self.open:
            now, self.open = self.open[:NODES_AT_ONCE], self.open[NODES_AT_ONCE:]
            for (tree, node), cuts in self._cuts(now).items():
                found = self.plan.choose(self.tops[tree].name[node], cuts)
                for child in self.tops[tree].split(node, *found) if found else ():
                    self._place(tree, child)

    def _place(self, tree: int, node: int) -> None:
        top = self.tops[tree]
        if self.plan.ends(top.counts[node], top.depth[node]):
            return
        # rows are drawn once at least, so the weight is no less than their number
        (self.small if top.counts[node].sum() <= self.subtree_rows else self.open).append((tree, node))

    def _roots(self) -> list[np.ndarray]:
        plan = self.plan

        def run(batches):
            total = np.zeros((plan.trees, plan.classes))
            for batch in batches:
                y = batch.column("y").to_numpy()
                for tree in range(plan.trees):
                    total[tree] += np.bincount(y, weights=plan.weights(batch, tree), minlength=plan.classes)
            tree, cls = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(cls), pa.array(total[tree, cls])], ["tree", "cls", "n"])

        found = self.rows.mapInArrow(run, "tree bigint, cls bigint, n double").groupBy("tree", "cls").agg(F.sum("n").alias("n"))
        roots = np.zeros((plan.trees, plan.classes))
        for r in found.collect():
            roots[r["tree"], r["cls"]] = r["n"]
        return list(roots)

    def _quantiles(self) -> list[np.ndarray]:
        probs = [i / self.bins for i in range(1, self.bins)]
        wanted = [F.percentile_approx(F.get("x", F.lit(f)), probs, 50 * self.bins) for f in range(self.plan.width)]
        return [np.unique(np.array(q, dtype=float)) for q in self.rows.agg(F.array(*wanted)).first()[0]]

    def _values(self, parts: list[Part]) -> DataFrame:
        """All rows inside the parts, which do not overlap: part, x, y, w."""
        plan, tops = self.plan, [t.arrays() for t in self.tops]
        ranges = defaultdict(list)
        for i, p in enumerate(parts):
            ranges[p.tree, p.node, p.feature].append((p.low, p.high, i))
        by_node = defaultdict(list)
        for (tree, node, f), found in ranges.items():
            by_node[tree, node].append((f, *map(np.array, zip(*sorted(found)))))
        trees = sorted({t for t, _ in by_node})

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                points, y = rows_as_matrix(batch.column("x")), batch.column("y").to_numpy()
                for tree in trees:
                    w = plan.weights(batch, tree)
                    for node, rows in by_place(np.where(w > 0, walk(points, tops[tree]), -1)):
                        for f, lows, highs, numbers in by_node.get((tree, node), ()):
                            x = points[rows, f]
                            place = np.searchsorted(lows, x, side="left") - 1
                            some = np.flatnonzero((place >= 0) & (x <= highs[place]))
                            if len(some):
                                columns = [numbers[place[some]], x[some], y[rows[some]].astype(np.int64), w[rows[some]]]
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "x", "y", "w"])

        return self.rows.mapInArrow(run, "part bigint, x double, y bigint, w double")

    def _counts(self, parts: list[Part]) -> DataFrame:
        """Class weights, least and greatest value of every bin of the parts: part, bin, y, w, low, high."""
        plan, tops = self.plan, [t.arrays() for t in self.tops]
        by_node = defaultdict(list)
        for i, p in enumerate(parts):
            by_node[p.tree, p.node].append((i, p.feature, p.low, p.high, p.cuts))
        trees = sorted({t for t, _ in by_node})
        classes = plan.classes

        def run(batches):
            held: dict[int, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                points, y = rows_as_matrix(batch.column("x")), batch.column("y").to_numpy()
                for tree in trees:
                    w = plan.weights(batch, tree)
                    for node, rows in by_place(np.where(w > 0, walk(points, tops[tree]), -1)):
                        for i, f, low, high, cuts in by_node.get((tree, node), ()):
                            some = rows[(points[rows, f] > low) & (points[rows, f] <= high)]
                            if not len(some):
                                continue
                            if i not in held:
                                size = len(cuts) + 1
                                held[i] = [np.zeros(size * classes), np.full(size, np.inf), np.full(size, -np.inf)]
                            x = points[some, f]
                            which = np.searchsorted(cuts, x, side="left")
                            counts, lows, highs = held[i]
                            counts += np.bincount(which * classes + y[some], weights=w[some], minlength=len(counts))
                            np.minimum.at(lows, which, x)
                            np.maximum.at(highs, which, x)
            for i, (counts, lows, highs) in held.items():
                cell = np.flatnonzero(counts)
                which, cls = cell // classes, cell % classes
                columns = [np.full(len(cell), i), which, cls, counts[cell], lows[which], highs[which]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "bin", "y", "w", "low", "high"])

        found = self.rows.mapInArrow(run, "part bigint, bin bigint, y bigint, w double, low double, high double")
        return found.groupBy("part", "bin", "y").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("high").alias("high"))

    def _cuts(self, now: list[tuple[int, int]]) -> dict[tuple[int, int], dict[int, Cut]]:
        """The best cut of every feature that varies, for every node."""
        plan = self.plan
        best: dict[tuple[int, int], dict[int, Cut]] = {key: {} for key in now}
        none = np.zeros(plan.classes)
        parts = [Part(t, n, f, -math.inf, math.inf, none, self.quantiles[f]) for t, n in now for f in range(plan.width)]
        while parts:
            inside = self._narrow(parts, best)
            # only features that the node may use, and of them only what can still win
            usable = {}
            for (tree, node), cuts in best.items():
                chosen = [f for f in plan.order(self.tops[tree].name[node]) if f in cuts][: plan.tried]
                usable[tree, node] = set(chosen), min((cuts[f].score for f in chosen), default=math.inf)
            parts, exact = [], []
            for bound, rows, part in inside:
                names, least = usable[part.tree, part.node]
                if part.feature in names and round(bound, DIGITS) <= round(least, DIGITS):
                    (exact if rows <= self.inside_rows else parts).append(part)
            if exact:
                self._finish(exact, best)
            if parts:
                self._cut_again(parts)
        return best

    def _better(self, best: dict, part: Part, cut: Cut) -> None:
        cuts = best[part.tree, part.node]
        old = cuts.get(part.feature)
        if old is None or (round(cut.score, DIGITS), cut.value) < (round(old.score, DIGITS), old.value):
            cuts[part.feature] = cut

    def _narrow(self, parts: list[Part], best: dict) -> list[tuple[float, float, Part]]:
        """Try all borders of bins; return the bins that hold several values, each with its bound and rows."""
        tops, classes = self.tops, self.plan.classes
        known = {i: (p.before, tops[p.tree].counts[p.node]) for i, p in enumerate(parts)}

        def run(group):
            part = group.column("part")[0].as_py()
            before, total = known[part]
            bins, y, w, low, high = (group.column(c).to_numpy() for c in ("bin", "y", "w", "low", "high"))
            there, place = np.unique(bins, return_inverse=True)
            counts = np.bincount(place * classes + y, weights=w, minlength=len(there) * classes).reshape(-1, classes)
            lows, highs = np.full(len(there), np.inf), np.full(len(there), -np.inf)
            np.minimum.at(lows, place, low)
            np.maximum.at(highs, place, high)
            upto = before + np.cumsum(counts, axis=0)
            scores = impurity(upto, total)
            rows = []
            least = math.inf
            if len(there) > 1:
                pick = int(np.round(scores[:-1], DIGITS).argmin())
                least = scores[pick]
                rows.append((part, "cut", scores[pick], highs[pick], lows[pick + 1], 0.0, upto[pick].tolist()))
            for i in np.flatnonzero(lows < highs):
                start = upto[i] - counts[i]
                bound = _bound(start, counts[i], total)
                if round(bound, DIGITS) <= round(least, DIGITS):
                    rows.append((part, "bin", bound, lows[i], highs[i], counts[i].sum(), start.tolist()))
            return _found(rows)

        found = self._counts(parts).groupBy("part").applyInArrow(run, FOUND).collect()
        inside = []
        for r in found:
            part = parts[r["part"]]
            if r["kind"] == "cut":
                self._better(best, part, Cut(r["score"], r["low"], r["high"], tuple(r["before"])))
            else:
                below = math.nextafter(r["low"], -math.inf)
                inside.append((r["score"], r["n"], Part(part.tree, part.node, part.feature, below, r["high"], np.array(r["before"]))))
                # a bin with several values: the feature varies, though no border may be known yet
                if part.feature not in best[part.tree, part.node]:
                    best[part.tree, part.node][part.feature] = Cut(math.inf, math.inf, math.inf, ())
        return inside

    def _finish(self, parts: list[Part], best: dict) -> None:
        """The best cut between neighbouring values inside each part; a part's values fit a task."""
        tops = self.tops
        known = {i: (p.before, tops[p.tree].counts[p.node]) for i, p in enumerate(parts)}

        def run(group):
            part = group.column("part")[0].as_py()
            x, y, w = (group.column(c).to_numpy() for c in ("x", "y", "w"))
            cut = best_cut(x, y, w, *known[part])
            return _found([(part, "cut", cut.score, cut.value, cut.after, 0.0, list(cut.left))] if cut else [])

        for r in self._values(parts).groupBy("part").applyInArrow(run, FOUND).collect():
            self._better(best, parts[r["part"]], Cut(r["score"], r["low"], r["high"], tuple(r["before"])))

    def _cut_again(self, parts: list[Part]) -> None:
        probs = [i / self.bins for i in range(1, self.bins)]
        found = self._values(parts).groupBy("part").agg(F.percentile_approx("x", probs, 50 * self.bins).alias("cuts"))
        for r in found.collect():
            parts[r["part"]].cuts = np.unique(np.array(r["cuts"]))

    def subtrees(self) -> DataFrame:
        """Finished small nodes as rows: tree, top, node, feature, border, left, name, depth, cls, n."""
        plan, tops = self.plan, [t.arrays() for t in self.tops]
        wanted, known = defaultdict(list), {}
        for tree, node in self.small:
            wanted[tree].append(node)
            known[tree, node] = self.tops[tree].name[node], self.tops[tree].depth[node]

        def send(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                points, y = rows_as_matrix(batch.column("x")), batch.column("y").to_numpy()
                for tree, names in wanted.items():
                    w = plan.weights(batch, tree)
                    at = walk(points, tops[tree])
                    some = np.flatnonzero((w > 0) & np.isin(at, names))
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(some), tree)),
                                pa.array(at[some]),
                                batch.column("x").take(pa.array(some)).cast(pa.list_(pa.float64())),
                                pa.array(y[some].astype(np.int64)),
                                pa.array(w[some]),
                            ],
                            ["tree", "top", "x", "y", "w"],
                        )

        def finish(group):
            tree, top = (group.column(c)[0].as_py() for c in ("tree", "top"))
            points = rows_as_matrix(group.column("x"))
            nodes = grow(points, group.column("y").to_numpy(), group.column("w").to_numpy(), plan, *known[tree, top])
            size = len(nodes.feature)
            held = [np.flatnonzero(c) for c in nodes.counts]
            columns = [
                pa.array([tree] * size, pa.int64()), pa.array([top] * size, pa.int64()), pa.array(range(size), pa.int64()),
                pa.array(nodes.feature, pa.int64()), pa.array(nodes.border, pa.float64()), pa.array(nodes.left, pa.int64()), pa.array(nodes.name), pa.array(nodes.depth, pa.int64()),
                pa.array([h.tolist() for h in held], pa.list_(pa.int64())),
                pa.array([c[h].tolist() for c, h in zip(nodes.counts, held)], pa.list_(pa.float64())),
            ]
            return pa.Table.from_arrays(columns, names=SUBTREE_NAMES)

        sent = self.rows.mapInArrow(send, "tree bigint, top bigint, x array<double>, y bigint, w double")
        return sent.groupBy("tree", "top").applyInArrow(finish, SUBTREE)


NAMES = ["part", "kind", "score", "low", "high", "n", "before"]
FOUND = "part bigint, kind string, score double, low double, high double, n double, before array<double>"
SUBTREE = (
    "tree bigint, top bigint, node bigint, feature bigint, border double, left bigint, name string, depth bigint, "
    "cls array<bigint>, n array<double>"
)
SUBTREE_NAMES = [c.split()[0] for c in SUBTREE.split(", ")]
KINDS = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(KINDS)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, KINDS)], names=NAMES)


def _bound(start: np.ndarray, counts: np.ndarray, total: np.ndarray) -> float:
    """No cut inside a bin is purer than the purest corner of its class counts."""
    some = np.flatnonzero(counts)
    if len(some) > CORNER_CLASSES:
        return 0.0
    corners = np.repeat(start[None, :], 1 << len(some), axis=0)
    for i, taken in enumerate(itertools.product((0, 1), repeat=len(some))):
        corners[i, some] += counts[some] * taken
    return float(impurity(corners, total).min())


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1.0)


class Forest(Estimator):
    """Trees over class codes 0..classes-1; one tree without sampling is a plain tree.

    ``tried`` features per node (all by default), in an order hashed from seed, tree and path; a feature
    that does not vary in the node does not count. With ``bootstrap`` a row is in a tree's sample as
    often as its key's hash draws it (the limit of sampling with replacement); without ``key`` rows are
    named by their vector. Cuts lie halfway between neighbouring values. Rows without label are not used;
    vectors have to be complete.
    """

    def __init__(
        self, features="features", label="label", classes=2, trees=1, tried=None, max_depth=None, seed=42, bootstrap=False, key=None,
        subtree_values=SUBTREE_VALUES, inside_rows=INSIDE_ROWS, bins=BINS,
    ):
        super().__init__()
        self.features, self.label, self.classes, self.trees, self.tried = features, label, classes, trees, tried
        self.max_depth, self.seed, self.bootstrap, self.key = max_depth, seed, bootstrap, key
        self.subtree_values, self.inside_rows, self.bins = subtree_values, inside_rows, bins

    def _fit(self, df: DataFrame) -> ForestModel:
        x = as_array(df, self.features)
        name = F.col(self.key) if self.key else F.to_json(F.array(x))
        halves = _key_halves(name) if self.bootstrap else [F.lit(0).cast("bigint").alias("h0"), F.lit(0).cast("bigint").alias("h1")]
        rows = df.filter(F.col(self.label).isNotNull()).select(x.alias("x"), F.col(self.label).cast("int").alias("y"), *halves)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _, width = complete_vectors(rows)
            plan = Plan(self.classes, width, self.trees, min(self.tried or width, width), self.max_depth, self.seed, self.bootstrap)
            grower = Grower(rows, plan, max(1, self.subtree_values // max(1, width)), self.inside_rows, self.bins)
            grower.grow()
            spark = df.sparkSession
            subtrees = grower.subtrees() if grower.small else spark.createDataFrame([], SUBTREE)
            subtrees = materialise(subtrees, "subtrees")
        finally:
            rows.unpersist()
        return ForestModel(plan, grower.tops, subtrees, self.features)


class ForestModel(Model):
    """Adds ``probability`` (mean of the trees' class shares) and ``prediction`` (the first of the largest)."""

    def __init__(self, plan: Plan, tops: list[Nodes], subtrees: DataFrame, features="features", prediction="prediction", model_nodes=MODEL_NODES):
        super().__init__()
        self.plan, self.tops, self.subtrees = plan, tops, subtrees
        self.features, self.prediction, self.model_nodes = features, prediction, model_nodes
        self._size = None

    def size(self) -> int:
        """Nodes of all trees; a finished subtree's root is the same node as the one it hangs on."""
        if self._size is None:
            self._size = self.subtrees.filter("node > 0").count()
        return self._size + sum(len(t.feature) for t in self.tops)

    def nodes(self) -> DataFrame:
        """All nodes: tree, name, depth, feature and border (null for leaves), class codes and their weights."""
        spark = self.subtrees.sparkSession
        rows = [
            (t, n, d, f if f >= 0 else None, b if f >= 0 else None, np.flatnonzero(c).tolist(), c[c > 0].tolist())
            for t, top in enumerate(self.tops)
            for n, d, f, b, c in zip(top.name, top.depth, top.feature, top.border, top.counts)
        ]
        schema = "tree bigint, name string, depth bigint, feature bigint, border double, cls array<bigint>, n array<double>"
        inner = F.col("feature") >= 0
        values = {c: F.when(inner, F.col(c)) for c in ("feature", "border")}
        finished = self.subtrees.withColumns(values).select("tree", "name", "depth", "feature", "border", "cls", "n")
        tops = spark.createDataFrame(rows, schema).join(finished.select("tree", "name"), ["tree", "name"], "left_anti")
        return tops.select(*finished.columns).unionByName(finished)

    def _transform(self, df: DataFrame) -> DataFrame:
        shares = self._in_memory(df) if self.size() <= self.model_nodes else self._streamed(df)
        best = F.array_position("probability", F.array_max("probability")) - 1
        return shares.withColumn(self.prediction, best.cast("double"))

    def _in_memory(self, df: DataFrame) -> DataFrame:
        """All trees travel with the task; the number of their nodes has been checked."""
        whole = [Nodes(list(t.feature), list(t.border), list(t.left), counts=list(t.counts)) for t in self.tops]
        pieces = defaultdict(list)
        for r in self.subtrees.collect():
            pieces[r["tree"], r["top"]].append(r)
        for (tree, top), rows in pieces.items():
            into, rows = whole[tree], sorted(rows, key=lambda r: r["node"])
            base = len(into.feature) - 1
            for r in rows:
                counts = np.zeros(self.plan.classes)
                counts[r["cls"]] = r["n"]
                place = top if r["node"] == 0 else into.add("", 0, counts)
                into.feature[place], into.border[place] = r["feature"], r["border"]
                into.left[place] = base + r["left"] if r["feature"] >= 0 else -1
        trees = [(t.arrays(), _shares(np.array(t.counts))) for t in whole]

        @F.arrow_udf("array<double>")
        def score(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            points = rows_as_matrix(x)
            total = sum(shares[walk(points, arrays)] for arrays, shares in trees) / len(trees)
            ends = np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(ends, total.ravel())

        return df.withColumn("probability", score(as_array(df, self.features)))

    def _streamed(self, df: DataFrame) -> DataFrame:
        """Rows meet the subtrees they reach in sorted tasks; a subtree that many rows reach is sent several times."""
        spark, classes = df.sparkSession, self.plan.classes
        held = materialise(df.drop("probability").withColumn("_id", F.monotonically_increasing_id()), "scored")
        given = held.select(F.col("_id").alias("id"), as_array(held, self.features).alias("x"))
        tops = [t.arrays() for t in self.tops]

        def count(batches):
            found = defaultdict(int)
            for batch in batches:
                points = rows_as_matrix(batch.column("x")) if batch.num_rows else np.empty((0, 1))
                for tree, arrays in enumerate(tops):
                    for node, n in zip(*np.unique(walk(points, arrays), return_counts=True)):
                        found[tree, int(node)] += int(n)
            keys = list(found)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [found[k] for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tree", "top", "n"])

        reached = given.mapInArrow(count, "tree bigint, top bigint, n bigint").groupBy("tree", "top").agg(F.sum("n").alias("n"))
        copies = [np.ones(len(t.feature), dtype=np.int64) for t in self.tops]
        for r in reached.collect():  # one row per node of the tops, which are on the driver anyway
            copies[r["tree"]][r["top"]] = max(1, math.ceil(r["n"] / ROWS_PER_COPY))

        def send(batches):
            for batch in batches:
                points = rows_as_matrix(batch.column("x")) if batch.num_rows else np.empty((0, 1))
                ids = batch.column("id").to_numpy()
                for tree, arrays in enumerate(tops):
                    at = walk(points, arrays)
                    columns = [np.full(len(at), tree), at, ids % copies[tree][at], np.ones(len(at), dtype=np.int64), ids]
                    arrow = [pa.array(c, pa.int64()) for c in columns]
                    yield pa.RecordBatch.from_arrays([*arrow, batch.column("x").cast(pa.list_(pa.float64()))], ["tree", "top", "copy", "kind", "node", "x"])

        # a top node that ends is a subtree of one node
        ends = [
            (t, i, 0, LEAF, 0.0, -1, np.flatnonzero(c).tolist(), c[c > 0].tolist())
            for t, top in enumerate(self.tops)
            for i, (f, c) in enumerate(zip(top.feature, top.counts))
            if f < 0
        ]
        columns = ["tree", "top", "node", "feature", "border", "left", "cls", "n"]
        closed = spark.createDataFrame(ends, "tree bigint, top bigint, node bigint, feature bigint, border double, left bigint, cls array<bigint>, n array<double>")
        closed = closed.join(self.subtrees.select("tree", "top").distinct(), ["tree", "top"], "left_anti").select(*columns)
        table = self.subtrees.select(*columns).unionByName(closed)
        sizes = spark.createDataFrame([(t, i, int(c)) for t, many in enumerate(copies) for i, c in enumerate(many)], "tree bigint, top bigint, copies bigint")
        table = table.join(sizes, ["tree", "top"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
        both = table.withColumn("kind", F.lit(0).cast("bigint")).unionByName(
            given.mapInArrow(send, "tree bigint, top bigint, copy bigint, kind bigint, node bigint, x array<double>"), allowMissingColumns=True
        )

        def meet(batches):
            at, nodes, arrays, shares = None, [], None, None
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("tree", "top", "copy", "kind")], axis=1)
                cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
                for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if start == stop:
                        continue
                    piece, key = batch.slice(start, stop - start), tuple(keys[start])
                    if key[:3] != at:
                        at, nodes, arrays = key[:3], [], None
                    if key[3] == 0:
                        nodes += piece.select(["feature", "border", "left", "cls", "n"]).to_pylist()
                        continue
                    if arrays is None:
                        arrays = tuple(np.array([n[c] for n in nodes]) for c in ("feature", "border", "left"))
                        counts = np.zeros((len(nodes), classes))
                        for i, n in enumerate(nodes):
                            counts[i, n["cls"]] = n["n"]
                        shares, nodes = _shares(counts), []
                    found = shares[walk(rows_as_matrix(piece.column("x")), arrays)]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("node"), piece.column("tree"), pa.array(found.tolist(), pa.list_(pa.float64()))], ["id", "tree", "p"]
                    )

        met = both.repartition("tree", "top", "copy").sortWithinPartitions("tree", "top", "copy", "kind", "node")
        votes = met.mapInArrow(meet, "id bigint, tree bigint, p array<double>").groupBy("id")
        each = F.sort_array(F.collect_list(F.struct("tree", "p")))  # one entry per tree, in their order
        zero = F.array_repeat(F.lit(0.0), classes)
        total = F.aggregate(each, zero, lambda a, v: F.zip_with(a, v["p"], lambda x, y: x + y), lambda a: F.transform(a, lambda x: x / len(self.tops)))
        shared = votes.agg(total.alias("probability")).withColumnRenamed("id", "_id")
        return held.join(shared, "_id").drop("_id")
