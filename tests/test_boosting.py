"""Boosted trees against a plain version that looks at every row for every place."""

import dataclasses

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortry.ml import boosting
from cohortry.ml.boosting import GROWTHS, BoostedModel, Settings, fit, gradients, softmax
from cohortry.ml.ensemble import EnsembleClassifier, EnsembleModel
from cohortry.ml.members import FEATURES as VECTOR
from cohortry.ml.members import Member, assemble

NAMES = ["a", "b", "c"]


def rows_of(n, seed, classes=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = np.round(rng.normal(size=(n, 3)) + np.eye(3)[y % 3] * 1.5, 1)
    x[:, 2] = rng.integers(0, 4, n)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(int(i), int(k), *map(float, v)) for i, (k, v) in enumerate(zip(y, x))]
    return assemble(spark.createDataFrame(rows, "id int, y int, a double, b double, c double").repartition(parts), NAMES)


class Plain:
    """One tree round on bins, straight from the formulas."""

    def __init__(self, settings, bins, y, margins):
        self.s, self.bins = settings, bins
        self.g, self.h = (a / boosting.SCALE for a in gradients(softmax(margins), y))

    def score(self, rows, k):
        h = self.h[rows, k].sum() + self.s.l2
        return self.g[rows, k].sum() ** 2 / h if h > 0 else 0.0

    def best(self, rows, classes):
        found = (-np.inf, 0, 0)
        for f in range(self.bins.shape[1]):
            for b in range(self.s.bins):
                left, right = rows & (self.bins[:, f] <= b), rows & (self.bins[:, f] > b)
                if min(left.sum(), right.sum()) < max(1, self.s.least_rows):
                    continue
                if min(self.h[p, k].sum() for p in (left, right) for k in classes) < self.s.least_hessian:
                    continue
                gain = 0.5 * sum(self.score(left, k) + self.score(right, k) - self.score(rows, k) for k in classes)
                if gain > found[0] + 1e-9:
                    found = (gain, f, b)
        return found

    def value(self, rows, k):
        h = self.h[rows, k].sum() + self.s.l2
        return -self.s.rate * self.g[rows, k].sum() / h if h > 0 else 0.0

    def level(self, rows, k, depth):
        gain, f, b = self.best(rows, [k])
        if depth == 0 or gain <= 0:
            return [(rows, None)]
        return [((f, b, round(gain, 5)), depth), *self.level(rows & (self.bins[:, f] <= b), k, depth - 1),
                *self.level(rows & (self.bins[:, f] > b), k, depth - 1)]

    def leafwise(self, k):
        """Splits in order, one at a time: always the open leaf with the greatest gain, the older of equals."""
        open_ = {0: np.ones(len(self.bins), bool)}
        done, last = [], 0
        while len(open_) < self.s.leaves:
            ranked = [(self.best(rows, [k]), -node) for node, rows in open_.items()]
            (gain, f, b), node = max(ranked, key=lambda r: (r[0][0], r[1]))
            if gain <= 0:
                break
            rows = open_.pop(-node)
            done.append((-node, f, b, round(gain, 5)))
            open_[last + 1], open_[last + 2] = rows & (self.bins[:, f] <= b), rows & (self.bins[:, f] > b)
            last += 2
        return done, open_

    def symmetric(self, classes):
        nodes, places = [np.ones(len(self.bins), bool)], []
        for _ in range(self.s.depth):
            best = (0.0, None, None)
            for f in range(self.bins.shape[1]):
                for b in range(self.s.bins):
                    gain = 0.0
                    for rows in nodes:
                        left, right = rows & (self.bins[:, f] <= b), rows & (self.bins[:, f] > b)
                        if left.any() and right.any():
                            gain += 0.5 * sum(self.score(left, k) + self.score(right, k) - self.score(rows, k) for k in classes)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, b)
            if best[1] is None:
                break
            places.append(best[1:])
            nodes = [part for rows in nodes for part in (rows & (self.bins[:, best[1]] <= best[2]), rows & (self.bins[:, best[1]] > best[2]))]
        return places, nodes


def in_level_order(tree, node=0):
    f = tree.feature[node]
    if f < 0:
        return [node]
    return [(f, tree.bin[node], round(tree.gain[node], 5)), *in_level_order(tree, tree.left[node]), *in_level_order(tree, tree.right[node])]


def test_levels_equal_plain_version(spark):
    settings = Settings(rounds=3, depth=3, bins=16)
    x, y = rows_of(300, 1)
    model = fit(frame(spark, x, y), VECTOR, 3, "y", 3, settings)
    bins, margins = model.bins_of(x), np.zeros((300, 3))
    for trees in model.rounds:
        plain = Plain(settings, bins, y, margins)
        for k, tree in enumerate(trees):
            want = plain.level(np.ones(300, bool), k, settings.depth)
            got = in_level_order(tree)
            assert [g for g in got if isinstance(g, tuple)] == [w[0] for w in want if w[1] is not None]
            leaf = tree.leaf_of(bins)
            for rows, _ in (w for w in want if w[1] is None):
                assert len(set(leaf[rows])) == 1 and tree.value[leaf[rows][0]][0] == pytest.approx(plain.value(rows, k), abs=1e-12)
        boosting.add_margins(margins, bins, [trees])
    assert model.losses[-1] == pytest.approx(-np.log(softmax(margins)[np.arange(300), y]).mean(), abs=1e-5)


def test_leaves_equal_plain_version(spark):
    settings = dataclasses.replace(GROWTHS["leafwise"], rounds=2, leaves=9, least_rows=5, bins=16)
    x, y = rows_of(300, 2)
    model = fit(frame(spark, x, y), VECTOR, 3, "y", 3, settings)
    bins, margins = model.bins_of(x), np.zeros((300, 3))
    for trees in model.rounds:
        plain = Plain(settings, bins, y, margins)
        for k, tree in enumerate(trees):
            want, leaves = plain.leafwise(k)
            order = sorted((o, n) for n, o in enumerate(tree.order) if o >= 0)
            # node numbers follow the order of splits, so that they agree too
            assert [(n, tree.feature[n], tree.bin[n], round(tree.gain[n], 5)) for _, n in order] == want
            leaf = tree.leaf_of(bins)
            assert all((leaf[rows] == n).all() and tree.value[n][0] == pytest.approx(plain.value(rows, k)) for n, rows in leaves.items())
        boosting.add_margins(margins, bins, [trees])


def test_symmetric_equals_plain_version(spark):
    settings = dataclasses.replace(GROWTHS["symmetric"], rounds=3, depth=4, bins=16)
    x, y = rows_of(250, 3)
    model = fit(frame(spark, x, y), VECTOR, 3, "y", 3, settings)
    bins, margins = model.bins_of(x), np.zeros((250, 3))
    for (tree,) in model.rounds:
        plain = Plain(settings, bins, y, margins)
        places, nodes = plain.symmetric(range(3))
        assert model.places(tree) == [(f, b) for f, b in places]
        bits = sum((bins[:, f] > b).astype(int) << (len(places) - 1 - i) for i, (f, b) in enumerate(places))
        assert (model.leaf_numbers(tree, bins) == bits).all()
        for number, rows in enumerate(nodes):
            if rows.any():
                value = tree.value[tree.leaf_of(bins)[rows][0]]
                assert (bits[rows] == number).all() and value == pytest.approx([plain.value(rows, k) for k in range(3)])
        boosting.add_margins(margins, bins, [[tree]])


@pytest.mark.parametrize("kind", sorted(GROWTHS))
def test_same_trees_however_rows_are_dealt(spark, kind):
    settings = dataclasses.replace(GROWTHS[kind], rounds=11, depth=3, leaves=6, row_share=0.7, feature_share=0.67)
    x, y = rows_of(400, 4)
    one, other = (fit(frame(spark, x, y, parts), VECTOR, 3, "y", 3, settings) for parts in (1, 7))
    assert one.rounds == other.rounds and one.losses == other.losses
    assert all(a > b for a, b in zip(one.losses, one.losses[1:]))


def test_held_rows_end_the_rounds(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 3, 400)  # nothing to learn
    settings = dataclasses.replace(GROWTHS["leafwise"], rounds=60, leaves=8, patience=3)
    model = fit(frame(spark, x[:300], y[:300]), VECTOR, 3, "y", 3, settings, frame(spark, x[300:], y[300:]))
    least = 1 + int(np.argmin(model.held_losses[1:]))
    assert len(model.rounds) == least < 57 and len(model.held_losses) == least + 4


def test_odd_tables(spark):
    empty = frame(spark, np.empty((0, 3)), np.empty(0, int), 1)
    assert fit(empty, VECTOR, 3, "y", 3, Settings(rounds=2)).rounds == []
    x = np.zeros((20, 3))
    same = fit(frame(spark, x, np.zeros(20, int)), VECTOR, 3, "y", 3, Settings(rounds=2))
    p = same.predict(np.array([[0.0, np.nan, 5.0]]))
    assert p.shape == (1, 3) and p[0, 0] > 1 / 3 and p.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        Settings(growth="sideways")
    with pytest.raises(ValueError):
        Settings(bins=500)


def test_members_in_an_ensemble(spark, tmp_path):
    x, y = rows_of(300, 8)
    df = frame(spark, x, y).drop(VECTOR)
    members = [Member(k, {"rounds": 4, "depth": 3}) for k in ("boosted", "leafwise", "symmetric")]
    model = EnsembleClassifier(members, weights=[0.4, 0.3, 0.3]).fit(df, NAMES, "y", df.limit(50))
    model.save(str(tmp_path / "m"))
    loaded = EnsembleModel.load(spark, str(tmp_path / "m"))
    a, b = (np.array([r[0] for r in m.transform(df).orderBy("id").select("probabilities").collect()]) for m in (model, loaded))
    assert (a == b).all() and (a.argmax(axis=1) == y).mean() > 0.5
    want = [m.predict(x) for m in model.models]
    assert a == pytest.approx(0.4 * want[0] + 0.3 * want[1] + 0.3 * want[2])
    assert {r["member"] for r in model.importance().collect()} == {"boosted", "leafwise", "symmetric"}
    assert isinstance(loaded.models[1], BoostedModel) and loaded.models[1].rounds == model.models[1].rounds


def test_rows_of_one_partition_are_dealt_over_the_cores(spark, monkeypatch):
    stored = []
    write = boosting.cut_lineage
    monkeypatch.setattr(boosting, "cut_lineage", lambda df, label: stored.append(df.rdd.getNumPartitions()) or write(df, label))
    rows = assemble(spark.createDataFrame([(float(i % 7), i % 3) for i in range(300)], "x double, y int").coalesce(1), ["x"])
    fit(rows, VECTOR, 1, "y", 3, Settings(rounds=1, depth=1))
    assert stored[0] >= spark.sparkContext.defaultParallelism > 1


def test_leaves_of_a_tree_with_one_place_a_level():
    tree = boosting.Tree()
    for node, feature in ((0, 0), (1, 1), (2, 1)):
        tree.split(node, feature, 3, 1.0, ([0.0], [0.0]), 0 if node == 0 else 1)
    bins = np.array([[0, 0], [0, 9], [9, 0], [9, 9]], np.uint8)
    assert tree.leaf_of(bins).tolist() == [3, 4, 5, 6]
    tree.bin[2] = 20  # no longer one place for the level
    assert tree.leaf_of(bins).tolist() == [3, 4, 5, 5]


def test_rows_of_a_round_are_kept_for_its_passes(spark, monkeypatch):
    stored, kept = [], []
    write, begin = boosting.cut_lineage, boosting.Histograms.begin
    monkeypatch.setattr(boosting, "cut_lineage", lambda df, label: stored.append(label) or write(df, label))
    monkeypatch.setattr(boosting.Histograms, "begin", lambda self, number: begin(self, number) or kept.append(self.round))
    rows = assemble(spark.createDataFrame([(float(i % 7), i % 3) for i in range(300)], "x double, y int"), ["x"])
    rounds = boosting.STORED_EVERY + 1
    model = fit(rows, VECTOR, 1, "y", 3, Settings(rounds=rounds, depth=2, least_hessian=0.0))
    assert stored == ["binned", "margins"] and len(model.rounds) == rounds and len(kept) == rounds + 1
    assert not any(r.is_cached for r in kept)  # all let go in the end
    assert (np.diff(model.losses) < 0).all()


@pytest.mark.parametrize("rows_for_a_core, memory", [(500, True), (499, False)])
def test_many_rows_are_kept_on_disk(spark, monkeypatch, rows_for_a_core, memory):
    x, y = rows_of(500 * spark.sparkContext.defaultParallelism, 11)
    kept, begin = [], boosting.Histograms.begin
    monkeypatch.setattr(boosting.Histograms, "begin", lambda self, number: begin(self, number) or kept.append(self.round.getStorageLevel().useMemory))
    want = fit(frame(spark, x, y), VECTOR, 3, "y", 3, Settings(rounds=3, depth=2))
    assert all(kept)
    kept.clear()
    monkeypatch.setattr(boosting, "ROWS_IN_MEMORY", rows_for_a_core)
    monkeypatch.setattr(boosting, "STORED_EVERY", 1)
    got = fit(frame(spark, x, y), VECTOR, 3, "y", 3, Settings(rounds=3, depth=2))
    assert got.rounds == want.rounds and got.losses == want.losses and kept == [memory] * 4


def test_blocks_of_megabytes_are_not_one_page(spark):
    blocks = boosting.cut_lineage(spark.range(40, numPartitions=1).select(F.expr("aes_encrypt(repeat(cast(10 + id AS string), 500000), repeat('k', 16))").alias("block")))
    [path] = [p.removeprefix("file://") for p in blocks.inputFiles()]
    assert pq.ParquetFile(path).metadata.num_row_groups > 1 and blocks.distinct().count() == 40
