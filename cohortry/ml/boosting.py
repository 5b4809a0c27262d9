"""Multi-class gradient boosting: softmax loss, second-order leaf values, histograms summed by Spark.

Rows are binned once and kept in blocks of arrays with their margins and, for
the length of a round, their gradients. A pass over them gives the sums of
gradients, second derivatives and rows per (candidate node, feature, bin): each
task adds up its rows, Spark adds up the tasks, and the driver gets one small
table. Gradients are rounded to multiples of 2**-20 and summed as whole
numbers, so neither the number of tasks nor a task that runs again changes a
tree.

Three ways to grow, all from the same passes:

level      every node of a level is split at its own best place
leaf       the leaf with the greatest gain is split next, up to a number of leaves
symmetric  one place for a whole level; a row's leaf number is its answers read as bits

Only the smaller child of a split is counted; its sibling is the parent less
the child. What reaches the driver is bounded by classes * nodes of a level (or
leaves) * features * bins.
"""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.plans.session import cut_lineage, spread

SCALE = 1 << 20       # gradients are whole multiples of 1 / SCALE
LEAST_HESSIAN = 1e-6
STORED_EVERY = 10     # rounds after which margins are written again
ROWS_AT_ONCE = 1 << 16  # of a task's rows that are counted together
ROWS_IN_MEMORY = 1 << 21  # for each core; a round's rows of more are kept on disk, as in memory they take about twice their size
SUMS_AT_ONCE = 64     # tasks whose sums the driver adds up; those of more are added up by Spark first
QUANTILE_ACCURACY = 10_000
ROWS = "bins binary, y int, held boolean, draw bigint, margins array<double>"
TRAIN_LOSS, HELD_LOSS = -1, -2


@dataclass(frozen=True)
class Settings:
    """``patience`` counts rounds without a better loss on held rows; it has no effect without such rows."""

    growth: str = "level"
    rounds: int = 100
    rate: float = 0.1
    depth: int = 6            # 0: no bound (growth by leaf)
    leaves: int = 31          # growth by leaf only
    bins: int = 64
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    row_share: float = 1.0
    feature_share: float = 1.0
    patience: int = 10
    seed: int = 42

    def __post_init__(self) -> None:
        if self.growth not in ("level", "leaf", "symmetric"):
            raise ValueError(f"unknown growth: {self.growth}")
        if not 2 <= self.bins <= 256:
            raise ValueError("bins must be from 2 to 256")
        if self.growth != "leaf" and self.depth < 1:
            raise ValueError("a depth is needed")


GROWTHS = {
    "boosted": Settings(),
    "leafwise": Settings(growth="leaf", depth=0, l2=0.0, least_hessian=1e-3, least_rows=20),
    "symmetric": Settings(growth="symmetric", l2=3.0, least_hessian=0.0),
}


@dataclass
class Tree:
    """Nodes by number, root 0; ``feature`` is -1 at a leaf. ``value`` has a column per class it adds to."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    order: list[int] = field(default_factory=lambda: [-1])  # the how-manieth split of the tree this was
    value: list[list[float]] = field(default_factory=lambda: [[0.0]])
    depth: int = 0

    def split(self, node: int, feature: int, place: int, gain: float, values: tuple[list, list], level: int) -> tuple[int, int]:
        first = len(self.feature)
        self.order[node] = sum(o >= 0 for o in self.order)
        for value in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.right.append(0)
            self.gain.append(0.0)
            self.order.append(-1)
            self.value.append(value)
        self.feature[node], self.bin[node], self.gain[node] = feature, place, gain
        self.left[node], self.right[node] = first, first + 1
        self.depth = max(self.depth, level + 1)
        return first, first + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        n, whole = len(bins), self._one_place_a_level()
        if whole is not None:
            places, nodes = whole
            number = np.zeros(n, np.int64)
            for f, place in places:
                number = 2 * number + (bins[:, f] > place)
            return np.asarray(nodes)[number]
        own = np.arange(len(self.feature))
        feature, place, left, right = (np.asarray(a) for a in (self.feature, self.bin, self.left, self.right))
        leaf = feature < 0  # a leaf leads to itself on both sides
        child = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).ravel()
        first = np.where(leaf, 0, feature) * n
        flat, every, node = bins.T.ravel(), np.arange(n), np.zeros(n, np.int64)
        for _ in range(self.depth):
            node = child[2 * node + (flat[first[node] + every] > place[node])]
        return node

    def _one_place_a_level(self) -> tuple[list[tuple[int, int]], list[int]] | None:
        """(feature, bin) of each level, and the leaves in order, if all nodes of every level are split there."""
        nodes, places = [0], []
        while self.feature[nodes[0]] >= 0:
            at = {(self.feature[n], self.bin[n]) for n in nodes}
            if len(at) > 1:
                return None
            places += at
            nodes = [c for n in nodes for c in (self.left[n], self.right[n])]
        return (places, nodes) if all(self.feature[n] < 0 for n in nodes) else None


def add_margins(margins: np.ndarray, bins: np.ndarray, rounds: Sequence[Sequence[Tree]]) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            value = np.asarray(tree.value)[tree.leaf_of(bins)]
            if value.shape[1] == 1:
                margins[:, k] += value[:, 0]
            else:
                margins += value
    return margins


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each margin, as whole multiples of 1 / SCALE."""
    first = p.copy()
    first[np.arange(len(y)), y] -= 1.0
    return np.rint(first * SCALE), np.rint(np.maximum(p * (1.0 - p), LEAST_HESSIAN) * SCALE)


def drawn(draw: np.ndarray, number: int, share: float) -> np.ndarray:
    """Whether each row takes part in a round: a multiplicative mix of its own number and the round's."""
    mixed = (draw.view(np.uint64) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


@dataclass(frozen=True)
class Candidate:
    """Rows of ``node`` (of the round's tree number ``tree``) on one side of a place; all of them if ``feature`` is -1."""

    tree: int
    node: int
    feature: int = -1
    place: int = 0
    left: bool = True


def _read(batch: pa.RecordBatch, n_features: int):
    n, packed = batch.num_rows, batch.column(0)
    at = packed.offset  # all of a column's bins lie in one buffer, a row after the other
    start = int(np.frombuffer(packed.buffers()[1], np.int32, 1, 4 * at)[0])
    values = np.frombuffer(packed.buffers()[2] or b"", np.uint8, n * n_features, start).reshape(n, n_features)
    values = np.asfortranarray(values)
    flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
    return (values, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False),
            batch.column(3).to_numpy(zero_copy_only=False), flat.reshape(n, -1).copy())


def _together(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, of about ``rows`` each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@dataclass
class _Block:
    """Some of the rows as they are in one round; ``first`` and ``second`` are derivatives by each margin."""

    bins: np.ndarray
    y: np.ndarray
    held: np.ndarray
    draw: np.ndarray
    margins: np.ndarray
    first: np.ndarray | None = None
    second: np.ndarray | None = None
    used: np.ndarray | None = None
    losses: np.ndarray | None = None  # summed loss and number of rows, of those to learn from and of held ones

    def next(self, number: int, trees: Sequence[Tree], share: float) -> _Block:
        """The rows at the start of a round, with the trees of the one before taken in."""
        margins = add_margins(self.margins.copy(), self.bins, [trees])
        p = softmax(margins)
        loss = np.rint(-np.log(np.maximum(p[np.arange(len(self.y)), self.y], 1e-15)) * SCALE)
        losses = np.array([[loss[part].sum(), part.sum()] for part in (~self.held, self.held)])
        used = ~self.held & drawn(self.draw, number, share) if share < 1.0 else ~self.held
        first, second = (np.asfortranarray(a, np.int32) for a in gradients(p, self.y))
        return _Block(self.bins, self.y, self.held, self.draw, margins, first, second, used, losses)

    def bare(self) -> _Block:
        return _Block(self.bins, self.y, self.held, self.draw, self.margins)


class Histograms:
    """The passes over the stored rows."""

    def __init__(self, rows: DataFrame, n_features: int, n_classes: int, settings: Settings,
                 level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> None:
        self.spark, self.n_features, self.n_classes, self.settings = rows.sparkSession, n_features, n_classes, settings
        self.level = level

        def blocks(batches):
            for batch in _together(batches):
                block = pickle.dumps(_Block(*_read(batch, n_features)))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

        self.rows: RDD = _unpacked(rows.mapInArrow(blocks, "block binary"))
        self.waiting: list[Tree] = []  # trees of the last round, which the margins don't hold yet
        self.kept = 0
        self.round: RDD | None = None

    def begin(self, number: int) -> None:
        """The rows of a round are kept for its passes; those of the round before are let go once they are read."""
        trees, share, before = self.waiting, self.settings.row_share, self.rows
        self.round = before.map(lambda block: block.next(number, trees, share)).persist(self.level)

    def sums(self, trees: Sequence[Tree], candidates: Sequence[Candidate]) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
        """(candidate, class or 1, feature, bin, 3) sums of gradients, second derivatives and rows; and the losses.

        A candidate of a tree that adds to all classes has sums for each class.
        """
        shared = len(trees) == 1 and self.n_classes > 1
        width = self.n_classes if shared else 1
        shape = (len(candidates), width, self.n_features, self.settings.bins)
        size = int(np.prod(shape))
        n_features, bins = self.n_features, self.settings.bins

        def each(blocks):
            total, losses = np.zeros((3, size)), np.zeros((2, 2))
            for block in blocks:
                losses += block.losses
                if not candidates:
                    continue
                every_row = block.used.all()
                g, h = (np.asfortranarray(a if every_row else a[block.used]) for a in (block.first, block.second))
                values = block.bins if every_row else np.asfortranarray(block.bins[block.used])
                for t, tree in enumerate(trees):
                    own = [(i, c) for i, c in enumerate(candidates) if c.tree == t]
                    if not own:
                        continue
                    leaf = tree.leaf_of(values)
                    slot = np.full(len(tree.feature), -1)
                    feature, place, left = (np.zeros(len(tree.feature), np.int64) for _ in range(3))
                    for i, c in own:
                        slot[c.node], feature[c.node], place[c.node], left[c.node] = i, c.feature, c.place, c.left
                    at = slot[leaf]
                    counted = np.flatnonzero(at >= 0)
                    own_leaf = leaf[counted]
                    f = feature[own_leaf]
                    on_left = values[counted, f] <= place[own_leaf]
                    counted = counted[(f < 0) | (on_left == left[own_leaf].astype(bool))]
                    # a tree's candidates follow each other: its cells are a stretch of all
                    low, cells = own[0][0], len(own) * width * n_features * bins
                    stretch = slice(low * width * n_features * bins, low * width * n_features * bins + cells)
                    first = (at[counted] - low) * width * n_features * bins
                    taken = [first + (j * bins + values[:, j][counted].astype(np.int64)) for j in range(n_features)]
                    rows_in = [np.bincount(cell, minlength=cells) for cell in taken]
                    for w in range(width):
                        k = w if shared else t
                        weights = [a[:, k][counted].astype(np.float64) for a in (g, h)]
                        moved = w * n_features * bins
                        for cell, n_in in zip(taken, rows_in):
                            for part, weight in zip(total, weights):
                                part[stretch][moved:] += np.bincount(cell, weight, cells)[:cells - moved]
                            total[2, stretch][moved:] += n_in[:cells - moved]
            yield total, losses

        tasks = self.round.getNumPartitions()
        total, losses = np.zeros((3, size)), np.zeros((2, 2))
        if tasks:
            depth = 1 if tasks <= SUMS_AT_ONCE else 2
            total, losses = self.round.mapPartitions(each).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), depth)
        if self.rows is not self.round:
            self.rows.unpersist()
            self.rows = self.round
        found = {cell: (int(a), int(n)) for cell, (a, n) in zip((TRAIN_LOSS, HELD_LOSS), losses)}
        return np.ascontiguousarray(total.T).reshape(*shape, 3), found

    def keep(self, trees: list[Tree]) -> None:
        """Take a round's trees into the margins; written from time to time, so that lost rows cost few rounds."""
        self.waiting, self.kept = trees, self.kept + 1
        if self.kept % STORED_EVERY == 0:
            packed = self.rows.map(lambda block: (pickle.dumps(block.bare()),))
            stored = cut_lineage(self.spark.createDataFrame(packed, "block binary"), "margins")
            self.rows.unpersist()
            self.rows = _unpacked(stored)

    def release(self) -> None:
        for rows in (self.rows, self.round):
            if rows is not None:
                rows.unpersist()


def _unpacked(rows: DataFrame) -> RDD:
    return rows.rdd.map(lambda row: pickle.loads(row[0]))


def leaf_value(sums: np.ndarray, settings: Settings) -> list[float]:
    """A step of Newton's method for each class, from sums (class, 3)."""
    g, h = sums[:, 0], sums[:, 1] + settings.l2 * SCALE
    return [float(v) for v in np.where(h > 0, -settings.rate * g / np.where(h > 0, h, 1.0), 0.0)]


def gains(hist: np.ndarray, settings: Settings, features: np.ndarray) -> np.ndarray:
    """(feature, bin): what the loss falls by, to second order, if rows with at most that bin go left.

    ``hist`` is (class, feature, bin, 3); gains of classes are added. Places
    that leave a side too small, or use a feature that is not drawn, are -inf.
    """
    left = hist.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left

    def score(s):
        h = s[..., 1] / SCALE + settings.l2
        return np.where(h > 0, (s[..., 0] / SCALE) ** 2 / np.where(h > 0, h, 1.0), 0.0)

    gain = 0.5 * (score(left) + score(right) - score(whole)).sum(axis=0)
    small = np.minimum(left[..., 1], right[..., 1]).min(axis=0) < max(settings.least_hessian * SCALE, 1)
    few = np.minimum(left[..., 2], right[..., 2])[0] < max(settings.least_rows, 1)
    gain[small | few] = -np.inf
    gain[~features] = -np.inf
    return gain


def best_place(gain: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin); the first of equals by feature, then bin."""
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def _sides(hist: np.ndarray, feature: int, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (class, 3) left and right of a place."""
    left = hist[:, feature, :place + 1].sum(axis=1)
    return left, hist[:, feature].sum(axis=1) - left


@dataclass
class _Leaf:
    """An open leaf: its sums, its level, its best place, and its children's sums once they are counted."""

    hist: np.ndarray
    level: int
    gain: float
    feature: int
    place: int
    children: tuple[np.ndarray, np.ndarray] | None = None


def _open(hist: np.ndarray, level: int, settings: Settings, features: np.ndarray) -> _Leaf:
    return _Leaf(hist, level, *best_place(gains(hist, settings, features)))


def _candidate(t: int, node: int, leaf: _Leaf) -> Candidate:
    left, right = _sides(leaf.hist, leaf.feature, leaf.place)
    return Candidate(t, node, leaf.feature, leaf.place, bool(left[0, 2] <= right[0, 2]))


def _count_children(passes: Histograms, trees: list[Tree], wanted: list[tuple[int, int, _Leaf]]) -> None:
    """One pass for all the given leaves' children; the larger of two is the leaf less the smaller."""
    candidates = [_candidate(*w) for w in wanted]
    if not candidates:
        return
    sums, _ = passes.sums(trees, candidates)
    for (_, _, leaf), c, small in zip(wanted, candidates, sums):
        leaf.children = (small, leaf.hist - small) if c.left else (leaf.hist - small, small)


def _split(tree: Tree, node: int, leaf: _Leaf, settings: Settings) -> tuple[int, int]:
    values = tuple(leaf_value(s, settings) for s in _sides(leaf.hist, leaf.feature, leaf.place))
    return tree.split(node, leaf.feature, leaf.place, leaf.gain, values, leaf.level)


def _grow_levels(passes, trees, roots, settings, features) -> None:
    frontier = [(t, 0, root) for t, root in enumerate(roots)]
    for level in range(settings.depth):
        frontier = [(t, node, leaf) for t, node, leaf in frontier if leaf.gain > 0]
        if level + 1 < settings.depth:
            _count_children(passes, trees, frontier)
        after = []
        for t, node, leaf in frontier:
            children = _split(trees[t], node, leaf, settings)
            if leaf.children:
                after += [(t, c, _open(h, level + 1, settings, features[t])) for c, h in zip(children, leaf.children)]
        frontier = after


def _grow_leaves(passes, trees, roots, settings, features) -> None:
    """Best leaf first, all classes' trees side by side.

    The children of every open leaf that may still be split are counted in one
    pass, before it is known whether its turn comes: the order of splits is
    that of one split at a time, in about as many passes as the tree is deep.
    """
    open_leaves = [{0: root} for root in roots]
    queues = [[(-root.gain, 0)] for root in roots]
    left = [settings.leaves - 1] * len(roots)
    deep = lambda leaf: settings.depth and leaf.level >= settings.depth
    while True:
        wanted = []
        for t, queue in enumerate(queues):
            best = heapq.nsmallest(left[t], queue)
            wanted += [(t, n, open_leaves[t][n]) for gain, n in best if gain < 0 and open_leaves[t][n].children is None and not deep(open_leaves[t][n])]
        if not wanted:
            return
        _count_children(passes, trees, wanted)
        for t, queue in enumerate(queues):
            while queue and left[t]:
                gain, node = queue[0]
                leaf = open_leaves[t][node]
                if gain >= 0 or deep(leaf):
                    heapq.heappop(queue)
                    continue
                if leaf.children is None:
                    break
                heapq.heappop(queue)
                del open_leaves[t][node]
                left[t] -= 1
                for child, hist in zip(_split(trees[t], node, leaf, settings), leaf.children):
                    opened = open_leaves[t][child] = _open(hist, leaf.level + 1, settings, features[t])
                    heapq.heappush(queue, (-opened.gain, child))


def _grow_symmetric(passes, trees, roots, settings, features) -> None:
    tree, level_nodes = trees[0], [(0, roots[0].hist)]
    for level in range(settings.depth):
        # nodes that a place doesn't part count as they are: their gain is 0
        each = [np.maximum(gains(hist, settings, features[0]), -1e300) for _, hist in level_nodes]
        gain = sum(np.where(g <= -1e300, 0.0, g) for g in each)
        gain[np.all([g <= -1e300 for g in each], axis=0)] = -np.inf
        best, feature, place = best_place(gain)
        if best <= 0:
            return
        leaves = [_Leaf(hist, level, best, feature, place) for _, hist in level_nodes]
        if level + 1 < settings.depth:
            _count_children(passes, trees, [(0, node, leaf) for (node, _), leaf in zip(level_nodes, leaves)])
        after = []
        for (node, _), leaf in zip(level_nodes, leaves):
            after += zip(_split(tree, node, leaf, settings), leaf.children or (None, None))
        level_nodes = after


_GROW = {"level": _grow_levels, "leaf": _grow_leaves, "symmetric": _grow_symmetric}


@dataclass
class BoostedModel:
    """Trees of every round, the bins' upper bounds, and the mean losses after 0, 1, .. rounds."""

    settings: Settings
    n_classes: int
    edges: list[list[float]]
    rounds: list[list[Tree]]
    losses: list[float]
    held_losses: list[float]

    def bins_of(self, values: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(np.asarray(e, float), values[:, j]) for j, e in enumerate(self.edges)]
        return np.stack(columns, axis=1).astype(np.uint8) if columns else np.empty((len(values), 0), np.uint8)

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Class probabilities (row, class) of raw feature values (row, feature)."""
        bins = self.bins_of(np.nan_to_num(values, nan=0.0))
        return softmax(add_margins(np.zeros((len(values), self.n_classes)), bins, self.rounds))

    def with_probabilities(self, df: DataFrame, features: str, name: str) -> DataFrame:
        """Add an array of class probabilities; ``features`` is a vector column."""
        shared, n = df.sparkSession.sparkContext.broadcast(self), len(self.edges)

        @F.arrow_udf("array<double>")
        def score(column: pa.Array) -> pa.Array:
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)
            p = shared.value.predict(values)
            offsets = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel()))

        return df.withColumn(name, score(vector_to_array(features)))

    def importance(self) -> np.ndarray:
        """Each feature's share of all gains."""
        total = np.zeros(len(self.edges))
        for trees in self.rounds:
            for tree in trees:
                for f, g in zip(tree.feature, tree.gain):
                    if f >= 0:
                        total[f] += g
        return total / total.sum() if total.sum() else total

    @staticmethod
    def places(tree: Tree) -> list[tuple[int, int]]:
        """(feature, bin) of each level of a symmetric tree."""
        out, node = [], 0
        while tree.feature[node] >= 0:
            out.append((tree.feature[node], tree.bin[node]))
            node = tree.left[node]
        return out

    def leaf_numbers(self, tree: Tree, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row in a symmetric tree: its answers as bits, the first level's the highest."""
        number = np.zeros(len(bins), np.int64)
        for feature, place in self.places(tree):
            number = 2 * number + (bins[:, feature] > place)
        return number

    def splits(self) -> list[tuple]:
        """(round, tree, order, node, feature, threshold, gain, left value, right value) of every split."""
        out = []
        for r, trees in enumerate(self.rounds):
            for t, tree in enumerate(trees):
                for node, f in enumerate(tree.feature):
                    if f >= 0:
                        values = [tree.value[c][0] for c in (tree.left[node], tree.right[node])]
                        out.append((r, t, tree.order[node], node, f, float(self.edges[f][tree.bin[node]]), tree.gain[node], *values))
        return out

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        lines = [json.dumps({"settings": asdict(self.settings), "n_classes": self.n_classes, "edges": self.edges,
                             "losses": self.losses, "held_losses": self.held_losses})]
        lines += [json.dumps([asdict(t) for t in trees]) for trees in self.rounds]
        rows = spark.createDataFrame(list(enumerate(lines)), "part int, value string")
        rows.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        lines = [r["value"] for r in spark.read.parquet(path).orderBy("part").collect()]
        about = json.loads(lines[0])
        about["settings"] = Settings(**about["settings"])
        return cls(rounds=[[Tree(**t) for t in json.loads(line)] for line in lines[1:]], **about)


def bin_edges(df: DataFrame, features: str, n_features: int, bins: int) -> list[list[float]]:
    """Upper bounds of all but the last bin of each feature: values that occur, near equal shares apart.

    A feature with few values has a bin for each value that is not rare.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.select(vector_to_array(features).alias("x")).agg(*[
        F.struct(F.percentile_approx(F.element_at("x", j + 1), shares, QUANTILE_ACCURACY).alias("q"),
                 F.max(F.element_at("x", j + 1)).alias("top")).alias(f"f{j}") for j in range(n_features)]).first()
    return [sorted({float(v) for v in c["q"] or [] if v < c["top"]}) for c in row] if n_features else []


def fit(df: DataFrame, features: str, n_features: int, label: str, n_classes: int, settings: Settings,
        held: DataFrame | None = None) -> BoostedModel:
    """Train on the rows of ``df``; the loss on ``held`` rows ends the rounds early.

    ``features`` is a vector column, ``label`` holds 0 .. n_classes - 1. With
    held rows the model keeps the rounds up to the least loss on them, the first
    round at least.
    """
    edges = bin_edges(df, features, n_features, settings.bins)
    model = BoostedModel(settings, n_classes, edges, [], [], [])

    def binned(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_features)
            starts = np.arange(batch.num_rows + 1, dtype=np.int32)
            rows = pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                None, pa.py_buffer(starts * np.int32(n_features)), pa.py_buffer(model.bins_of(values).tobytes())])
            margins = pa.ListArray.from_arrays(pa.array(starts * np.int32(n_classes)), pa.array(np.zeros(batch.num_rows * n_classes)))
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[1:], margins],
                                             names=["bins", "y", "held", "draw", "margins"])

    def part(rows: DataFrame, is_held: bool) -> DataFrame:
        x = vector_to_array(features)
        return rows.select(x.alias("x"), F.col(label).cast("int").alias("y"), F.lit(is_held).alias("held"),
                           F.xxhash64(x, F.col(label).cast("int")).alias("draw"))

    rows = part(df, False) if held is None else part(df, False).unionByName(part(held, True))
    # dealt over the cores: every pass reads these rows, and how they are dealt doesn't show in the trees
    few = rows.count() <= ROWS_IN_MEMORY * df.sparkSession.sparkContext.defaultParallelism
    passes = Histograms(cut_lineage(spread(rows.mapInArrow(binned, ROWS)), "binned"), n_features, n_classes, settings,
                        StorageLevel.MEMORY_AND_DISK if few else StorageLevel.DISK_ONLY)
    rng = np.random.default_rng(settings.seed)
    n_trees = 1 if settings.growth == "symmetric" else n_classes
    best = (np.inf, 0)
    for number in range(settings.rounds + 1):
        trees = [Tree(value=[[0.0] * (n_classes if n_trees == 1 else 1)]) for _ in range(n_trees)]
        last = number == settings.rounds
        passes.begin(number)
        sums, losses = passes.sums(trees, [] if last else [Candidate(t, 0) for t in range(n_trees)])
        for cell, to in ((TRAIN_LOSS, model.losses), (HELD_LOSS, model.held_losses)):
            loss, n = losses.get(cell, (0, 0))
            if n:
                to.append(loss / SCALE / n)
        if model.held_losses and number:
            best = min(best, (model.held_losses[-1], number))
            if number - best[1] >= settings.patience:
                break
        if last or not n_features or not model.losses:
            break
        chosen = np.ones((n_trees, n_features), bool)
        if settings.feature_share < 1.0:
            chosen = np.zeros((n_trees, n_features), bool)
            for t in range(n_trees):
                chosen[t, rng.permutation(n_features)[:max(1, round(settings.feature_share * n_features))]] = True
        roots = [_open(sums[t], 0, settings, chosen[t]) for t in range(n_trees)]
        for t, tree in enumerate(trees):
            tree.value[0] = leaf_value(sums[t][:, 0].sum(axis=1), settings)  # stays if the root is not split
        _GROW[settings.growth](passes, trees, roots, settings, chosen)
        model.rounds.append(trees)
        passes.keep(trees)
    passes.release()
    if model.held_losses:
        model.rounds = model.rounds[:best[1]]
    return model
