"""Modelling queries: orders are the learning rows, their status the three classes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.catalog.registry import Tables, query
from cohortry.ml.boosting import GROWTHS, BoostedModel
from cohortry.ml.boosting import fit as fit_trees
from cohortry.ml.ensemble import EnsembleClassifier, EnsembleModel, side_by_side
from cohortry.ml.members import FEATURES as VECTOR
from cohortry.ml.members import KINDS, Member, assemble
from cohortry.ml.tuning import cross_validate, parzen_search, random_search
from cohortry.operators import vote
from cohortry.operators.split import parts, stratified_split
from cohortry.pipeline import train
from cohortry.plans.session import cut_lineage, scratch_path
from cohortry.sources import warehouse

FEATURES = ["o_totalprice", "o_custkey", "order_month", "order_day", "is_urgent"]
WEIGHTS = [0.3, 0.3, 0.2, 0.2]


def learning_rows(t: Tables) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t("orders").select(
        "o_orderkey", label.cast("int").alias("label"), "o_totalprice", "o_custkey",
        F.month("o_orderdate").alias("order_month"), F.day("o_orderdate").alias("order_day"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"))


_FITTED: dict[tuple, object] = {}  # (application, folder, kind) -> fitted member; a member is the same in all queries


def _parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from, and rows that end the rounds of the leafwise and symmetric members."""
    key = (t.spark.sparkContext.applicationId, t.folder, "rows")
    if key not in _FITTED:
        training, val, _ = parts(cut_lineage(stratified_split(learning_rows(t), "o_orderkey", "label")))
        _FITTED[key] = training, val
    return _FITTED[key]


def _fitted(t: Tables, kind: str):
    """A member as configured, fitted once per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, kind)
    if key not in _FITTED:
        training, val = _parts(t)
        _FITTED[key] = EnsembleClassifier([Member(kind)]).fit(training, FEATURES, "label", val).models[0]
    return _FITTED[key]


def _all_fitted(t: Tables, *kinds: str) -> list:
    _parts(t)
    return side_by_side(t.spark, kinds, lambda k: _fitted(t, k))


def _fit(t: Tables, *kinds: str, method: str = "weighted_voting", weights=None) -> EnsembleModel:
    return EnsembleModel(kinds, _all_fitted(t, *kinds), FEATURES, 3, method, weights)


def _member(t: Tables, kind: str) -> DataFrame:
    scored = _fit(t, kind).transform(learning_rows(t))
    return scored.select("o_orderkey", "label", "prediction", *[
        F.element_at("probabilities", i + 1).alias(f"p{i}") for i in range(3)])


@query("m1_boosted_trees")
def m1(t: Tables) -> DataFrame:
    return _member(t, "boosted")


@query("m2_leafwise_trees")
def m2_leafwise(t: Tables) -> DataFrame:
    return _member(t, "leafwise")


@query("m3_symmetric_trees")
def m3_symmetric(t: Tables) -> DataFrame:
    return _member(t, "symmetric")


@query("m1_m3_losses", """
SELECT member, true AS falls, member = 'boosted' AS all_rounds FROM (SELECT unnest(['boosted', 'leafwise', 'symmetric']) AS member)""")
def m1_m3_losses(t: Tables) -> DataFrame:
    # the loss on the learning rows falls each round; held rows end the rounds of two members
    kinds = ("boosted", "leafwise", "symmetric")
    rows = [(kind, i, float(loss)) for kind, model in zip(kinds, _all_fitted(t, *kinds)) for i, loss in enumerate(model.losses)]
    losses = t.spark.createDataFrame(rows, "member string, round int, loss double")
    before = F.lag("loss").over(Window.partitionBy("member").orderBy("round"))
    return losses.withColumn("fell", F.coalesce(F.col("loss") < before, F.lit(True))).groupBy("member").agg(
        F.bool_and("fell").alias("falls"), (F.max("round") == 100).alias("all_rounds"))


# Features with few values have a bin for each, so that SQL can try every place. At margins of 0 each class has
# probability 1/3; derivatives are multiples of 2 ** -20, as in the library.
PLAIN_FEATURES = ["order_month", "order_day", "is_urgent"]
_ROWS_SQL = """
r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
             CAST(month(o_orderdate) AS DOUBLE) AS x0, CAST(day(o_orderdate) AS DOUBLE) AS x1,
             CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS DOUBLE) AS x2 FROM orders),
x AS (SELECT *, CAST(round((1 / 3.0::DOUBLE - CASE WHEN y = k THEN 1 ELSE 0 END) * 1048576) AS BIGINT) AS g,
             CAST(round(2 / 9.0::DOUBLE * 1048576) AS BIGINT) AS h FROM r, (SELECT unnest([0, 1, 2]) AS k)),
v AS (SELECT id, k, 0 AS f, x0 AS v, g, h FROM x UNION ALL SELECT id, k, 1, x1, g, h FROM x UNION ALL SELECT id, k, 2, x2, g, h FROM x),
tops AS (SELECT f, max(v) AS top FROM v GROUP BY f),
places AS (SELECT DISTINCT v.f, v.v AS place FROM v JOIN tops ON v.f = tops.f AND v.v < tops.top)"""


def _sides_sql(cells: str, group: str = "") -> str:
    """Sums on the left of every place and in all, for each class and the further groups."""
    left = lambda c: f"sum(CASE WHEN v <= place THEN {c} ELSE 0 END)"
    return f"""SELECT p.f, p.place, k{group}, {left('g')} / 1048576.0::DOUBLE AS gl, {left('h')} / 1048576.0::DOUBLE AS hl, {left('n')} AS nl,
       sum(g) / 1048576.0::DOUBLE AS g, sum(h) / 1048576.0::DOUBLE AS h, sum(n) AS n
FROM places p JOIN {cells} c ON p.f = c.f GROUP BY p.f, p.place, k{group}"""


def _first_split_sql(l2: float, least_rows: int, least_hessian: float) -> str:
    return f"""WITH {_ROWS_SQL},
cells AS (SELECT k, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM v GROUP BY k, f, v),
sides AS ({_sides_sql('cells')}),
scored AS (SELECT k, f, place, 0.5 * (gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2})) AS gain,
                  -0.1 * gl / (hl + {l2}) AS low, -0.1 * (g - gl) / (h - hl + {l2}) AS high
           FROM sides WHERE least(nl, n - nl) >= {least_rows} AND least(hl, h - hl) >= {least_hessian}),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, place) AS i FROM scored)
SELECT CAST(k AS INTEGER) AS class, CAST(f AS INTEGER) AS feature, place AS threshold, round(gain, 6) AS gain, round(low, 9) AS left_value,
       round(high, 9) AS right_value FROM best WHERE i = 1"""


def _trees(t: Tables, kind: str, **params) -> BoostedModel:
    settings = replace(GROWTHS[kind], rounds=1, bins=256, **params)
    return fit_trees(assemble(learning_rows(t), PLAIN_FEATURES), VECTOR, len(PLAIN_FEATURES), "label", 3, settings)


def _splits(t: Tables, model: BoostedModel) -> DataFrame:
    return t.spark.createDataFrame(model.splits(), "round int, class int, place_in_order int, node int, feature int, threshold double, "
                                   "gain double, left_value double, right_value double")


def _first_splits(splits: DataFrame) -> DataFrame:
    return splits.where("round = 0 AND node = 0").select(
        "class", "feature", "threshold", F.round("gain", 6).alias("gain"), F.round("left_value", 9).alias("left_value"),
        F.round("right_value", 9).alias("right_value"))


@query("m1_first_split", _first_split_sql(1.0, 1, 1.0))
def m1_first_split(t: Tables) -> DataFrame:
    return _first_splits(_splits(t, _trees(t, "boosted", depth=1)))


@query("m2_first_split", _first_split_sql(0.0, 20, 0.001))
def m2_first_split(t: Tables) -> DataFrame:
    return _first_splits(_splits(t, _trees(t, "leafwise")))


@query("m2_split_order", "SELECT unnest([0, 1, 2])::INTEGER AS class, CAST(0 AS BIGINT) AS n_passed_over")
def m2_split_order(t: Tables) -> DataFrame:
    # a split passes over another if that had more gain and its leaf was open: made by an earlier split, split later
    splits = _splits(t, _trees(t, "leafwise"))
    later = splits.select("class", F.col("node").alias("other"), F.col("place_in_order").alias("later"), F.col("gain").alias("more"))
    # a node's number tells when it came to be: the i-th split makes nodes 2 i + 1 and 2 i + 2
    pairs = splits.join(later, "class").where((F.col("later") > F.col("place_in_order")) & (F.col("other") <= 2 * F.col("place_in_order")))
    return splits.groupBy("class").count().drop("count").join(
        pairs.where("more > gain").groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").select(
        "class", F.coalesce("n", F.lit(0)).alias("n_passed_over"))


_LEVEL_GAIN = "sum(gl * gl / (hl + 3) + (g - gl) * (g - gl) / (h - hl + 3) - g * g / (h + 3)) DESC, f, place LIMIT 1"
_ANSWER = "CASE {0}.f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END > {0}.place"


@query("m3_symmetric_leaves", f"""WITH {_ROWS_SQL},
cells AS (SELECT k, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM v GROUP BY k, f, v),
one AS (SELECT f, place FROM ({_sides_sql('cells')}) GROUP BY f, place ORDER BY {_LEVEL_GAIN}),
halves AS (SELECT id, CASE WHEN {_ANSWER.format('one')} THEN 1 ELSE 0 END AS half FROM r, one),
cells2 AS (SELECT k, f, v, half, sum(g) AS g, sum(h) AS h, count(*) AS n FROM v JOIN halves USING (id) GROUP BY k, f, v, half),
two AS (SELECT f, place FROM ({_sides_sql('cells2', ', half')}) GROUP BY f, place ORDER BY {_LEVEL_GAIN}),
leaves AS (SELECT 2 * half + CASE WHEN {_ANSWER.format('two')} THEN 1 ELSE 0 END AS leaf, k, g, h FROM x JOIN halves USING (id), two),
values AS (SELECT leaf, k, count(*) AS n, -0.1 * (sum(g) / 1048576.0::DOUBLE) / (sum(h) / 1048576.0::DOUBLE + 3) AS value FROM leaves GROUP BY leaf, k)
SELECT CAST(leaf AS INTEGER) AS leaf, max(n) AS n_rows, round(max(CASE WHEN k = 0 THEN value END), 9) AS value0,
       round(max(CASE WHEN k = 1 THEN value END), 9) AS value1, round(max(CASE WHEN k = 2 THEN value END), 9) AS value2
FROM values GROUP BY leaf""")
def m3_leaves(t: Tables) -> DataFrame:
    # the first symmetric tree with two levels: a row's leaf number is its two answers as bits
    model = _trees(t, "symmetric", depth=2)
    tree = model.rounds[0][0]
    values = {0: 0}
    for node in range(len(tree.feature)):  # a node's children come after it
        if tree.feature[node] >= 0:
            values |= {tree.left[node]: 2 * values[node], tree.right[node]: 2 * values[node] + 1}
    leaves = [(values[n], *(round(v, 9) for v in tree.value[n])) for n in values if tree.feature[n] < 0]
    number = F.lit(0)
    for feature, place in model.places(tree):
        number = 2 * number + (F.col(PLAIN_FEATURES[feature]).cast("double") > model.edges[feature][place]).cast("int")
    counts = learning_rows(t).groupBy(number.alias("leaf")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(t.spark.createDataFrame(leaves, "leaf int, value0 double, value1 double, value2 double"), "leaf")


@query("m2_forest")
def m2(t: Tables) -> DataFrame:
    return _member(t, "forest")


@query("m3_logistic")
def m3(t: Tables) -> DataFrame:
    return _member(t, "logistic")


@query("m4_network")
def m4(t: Tables) -> DataFrame:
    return _member(t, "network")


@query("m1_m4_predictions", """
SELECT member, count(*) AS n_rows, count(*) AS n_highest, count(*) AS n_sum_to_one
FROM orders, (SELECT unnest(['boosted', 'leafwise', 'symmetric', 'network', 'forest', 'logistic']) AS member) GROUP BY member""")
def m1_m4(t: Tables) -> DataFrame:
    # a member's prediction is the first class with its highest probability
    every, kinds = None, (*KINDS, "forest", "logistic")
    _all_fitted(t, *kinds)
    for kind in kinds:
        scored = _member(t, kind)
        p = F.array("p0", "p1", "p2")
        part = scored.select(
            F.lit(kind).alias("member"), (F.array_position(p, F.array_max(p)) - 1 == F.col("prediction")).alias("highest"),
            (F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) < 1e-9).alias("whole"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("member").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("highest").alias("n_highest"),
                                       F.count_if("whole").alias("n_sum_to_one"))


@query("m5_ensemble_fit")
def m5(t: Tables) -> DataFrame:
    model = _fit(t, *KINDS, weights=WEIGHTS)
    return model.evaluate(learning_rows(t), "label")


@query("m5_member_probabilities", """
SELECT member, count(*) AS n_rows, count(*) AS n_sum_to_one, count(*) AS n_in_range
FROM orders, (SELECT unnest(['boosted', 'leafwise', 'symmetric', 'network', 'forest', 'logistic']) AS member) GROUP BY member""")
def m5_members(t: Tables) -> DataFrame:
    kinds = [*KINDS, "forest", "logistic"]
    scored = _fit(t, *kinds).probabilities(learning_rows(t))
    arrays = F.array(*[F.struct(F.lit(k).alias("member"), F.col(f"p_{i}").alias("p")) for i, k in enumerate(kinds)])
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return scored.select(F.inline(arrays)).groupBy("member").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("n_sum_to_one"),
        F.count_if(F.forall("p", lambda x: (x >= 0) & (x <= 1)) & (F.size("p") == 3)).alias("n_in_range"))


def _voters(t: Tables) -> DataFrame:
    """Three rule-based voters and three probability arrays per order line."""
    a = (F.col("l_linenumber") % 3).cast("int")
    b = (F.col("l_partkey") % 3).cast("int")
    c = (F.col("l_suppkey") % 3).cast("int")

    def leaning(to, strength: float):
        return F.array(*[F.when(to == i, F.lit(strength)).otherwise(F.lit((1 - strength) / 2)) for i in range(3)])

    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("v0"), b.alias("v1"), c.alias("v2"),
        leaning(a, 0.5).alias("p0"), leaning(b, 0.6).alias("p1"), leaning(c, 0.7).alias("p2"))


@query("m6_hard_vote", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS INTEGER) AS vote
FROM (SELECT *, l_linenumber % 3 AS a, l_partkey % 3 AS b, l_suppkey % 3 AS c FROM lineitem)""")
def m6(t: Tables) -> DataFrame:
    return _voters(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             vote.hard_vote(["v0", "v1", "v2"]).alias("vote"))


def _soft_sql(weights: list[float]) -> str:
    total = sum(weights)
    cells = ", ".join(
        "round(({}) / {!r}, 9) AS s{}".format(" + ".join(
            f"CASE WHEN {v} = {i} THEN {s} ELSE {(1 - s) / 2!r} END::DOUBLE * {w!r}"
            for v, s, w in zip("abc", (0.5, 0.6, 0.7), weights)), total, i) for i in range(3))
    return f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s0, s1, s2,
       CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER) AS vote
FROM (SELECT *, {cells} FROM (SELECT *, l_linenumber % 3 AS a, l_partkey % 3 AS b, l_suppkey % 3 AS c FROM lineitem))"""


def _soft(t: Tables, weights: list[float] | None) -> DataFrame:
    joined = _voters(t).withColumn("s", F.transform(vote.soft_vote(["p0", "p1", "p2"], weights), lambda x: F.round(x, 9)))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         *[F.element_at("s", i + 1).alias(f"s{i}") for i in range(3)], vote.soft_class("s").alias("vote"))


@query("m7_soft_vote", _soft_sql([1.0, 1.0, 1.0]))
def m7(t: Tables) -> DataFrame:
    return _soft(t, None)


@query("m7_weighted_vote", _soft_sql([0.5, 0.3, 0.2]))
def m7_weighted(t: Tables) -> DataFrame:
    return _soft(t, [0.5, 0.3, 0.2])


@query("m9_cross_validation")
def m9(t: Tables) -> DataFrame:
    classifier = EnsembleClassifier([Member("logistic"), Member("forest")])
    return cross_validate(classifier, learning_rows(t), FEATURES, "o_orderkey", "label")


@query("m10_random_search")
def m10(t: Tables) -> DataFrame:
    split = cut_lineage(stratified_split(learning_rows(t), "o_orderkey", "label"))
    training, val, _ = parts(split)
    ranges = {"numTrees": (2, 6), "maxDepth": (2, 5)}
    return random_search("forest", training, val, FEATURES, "label", [0, 1, 2], trials=3, ranges=ranges)[1]


@query("m10_best_trial", "SELECT CAST(3 AS BIGINT) AS n_trials, true AS best_is_highest")
def m10_best(t: Tables) -> DataFrame:
    split = cut_lineage(stratified_split(learning_rows(t), "o_orderkey", "label"))
    training, val, _ = parts(split)
    best, trials = random_search("forest", training, val, FEATURES, "label", [0, 1, 2], trials=3,
                                 ranges={"numTrees": (2, 6), "maxDepth": (2, 5)})
    top = trials.orderBy(F.desc("f1_score"), "trial").limit(1)
    return trials.agg(F.count(F.lit(1)).alias("n_trials"),
                      (top.select("params").scalar() == F.lit(str(sorted(best.items())))).alias("best_is_highest"))


@query("m10_parzen_best", "SELECT CAST(6 AS BIGINT) AS n_trials, true AS best_is_highest, true AS in_ranges")
def m10_parzen(t: Tables) -> DataFrame:
    training, val = _parts(t)
    best, trials = parzen_search("forest", training, val, FEATURES, "label", [0, 1, 2], trials=6, ranges={"numTrees": (2, 6), "maxDepth": (2, 5)})
    top = trials.orderBy(F.desc("f1_score"), "trial").limit(1)
    number = lambda name: F.regexp_extract("params", rf"'{name}', (\d+)", 1).cast("int")
    return trials.agg(
        F.count(F.lit(1)).alias("n_trials"),
        (top.select("params").scalar() == F.lit(str(sorted(best.items())))).alias("best_is_highest"),
        F.bool_and(number("numTrees").between(2, 6) & number("maxDepth").between(2, 5)).alias("in_ranges"))


@query("m11_importance_ranks", """
SELECT member, CAST(5 AS BIGINT) AS n_features, 15 AS rank_sum, member <> 'logistic' AS sums_to_one, true AS in_order
FROM (SELECT unnest(['boosted', 'leafwise', 'symmetric', 'forest', 'logistic']) AS member)""")
def m11_ranks(t: Tables) -> DataFrame:
    found = _fit(t, "boosted", "leafwise", "symmetric", "forest", "logistic").importance()
    before = F.lag("importance").over(Window.partitionBy("member").orderBy("rank"))
    ordered = found.withColumn("falls", F.coalesce(before >= F.col("importance"), F.lit(True)))
    return ordered.groupBy("member").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("rank").cast("int").alias("rank_sum"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"), F.bool_and("falls").alias("in_order"))


@query("m11_feature_importance")
def m11(t: Tables) -> DataFrame:
    return _fit(t, "boosted", "leafwise", "symmetric", "forest", "logistic").importance()


@query("m12_train_end_to_end", """
SELECT 'v1' AS version, CAST(sum(round(n * 0.7::DOUBLE)) AS BIGINT) AS dataset_size, true AS has_metrics,
       '["o_totalprice", "o_custkey", "order_month", "order_day", "is_urgent"]' AS feature_names
FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus)""")
def m12(t: Tables) -> DataFrame:
    registry = scratch_path(t.spark, "registry")
    train(learning_rows(t), "o_orderkey", "label", members=[Member("forest"), Member("logistic")], weights=[0.6, 0.4],
          model_path=scratch_path(t.spark, "model"), registry=registry)
    return warehouse.model_info(t.spark, registry).select(
        "version", "dataset_size", F.get_json_object("metrics", "$.f1_score").isNotNull().alias("has_metrics"),
        "feature_names")


@query("m13_score_table")
def m13(t: Tables) -> DataFrame:
    model = _fit(t, *KINDS, weights=WEIGHTS)
    out = model.predict(learning_rows(t), patient_id="o_orderkey")
    first = F.element_at("alternative_treatments", 1)
    return out.select("o_orderkey", "predicted_treatment", "response_probability", "confidence",
                      first["treatment"].alias("second"), first["probability"].alias("second_probability"),
                      F.size("all_probabilities").alias("n_classes"))


@query("m13_score_invariants", """
SELECT count(*) AS n_rows, count(*) AS n_best_is_highest, count(*) AS n_alternatives_in_order, count(*) AS n_confident
FROM orders""")
def m13_invariants(t: Tables) -> DataFrame:
    out = _fit(t, *KINDS, weights=WEIGHTS).predict(learning_rows(t), patient_id="o_orderkey")
    every = F.map_values("all_probabilities")
    second, third = (F.element_at("alternative_treatments", i)["probability"] for i in (1, 2))
    best = F.col("response_probability")
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((best == F.array_max(every)) & (best == F.element_at("all_probabilities", F.col("predicted_treatment"))))
        .alias("n_best_is_highest"),
        F.count_if((best >= second) & (second >= third)).alias("n_alternatives_in_order"),
        F.count_if(F.col("confidence").between(0, 1)).alias("n_confident"))


@query("s12_model_round_trip", "SELECT true AS same, count(*) AS n FROM orders")
def s12(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "saved-model")
    model = _fit(t, *KINDS, weights=WEIGHTS)
    model.save(path)
    loaded = EnsembleModel.load(t.spark, path)
    before = model.transform(learning_rows(t)).select("o_orderkey", F.col("prediction").alias("before"))
    after = loaded.transform(learning_rows(t)).select("o_orderkey", F.col("prediction").alias("after"))
    return before.join(after, "o_orderkey").groupBy((F.col("before") == F.col("after")).alias("same")).agg(
        F.count(F.lit(1)).alias("n"))
