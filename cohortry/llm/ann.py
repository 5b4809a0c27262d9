"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import stored

SAMPLE = 8192          # rows the index is fitted on, expected number where there are more
NEIGHBOURS = 16        # of each sampled row in the graph
LARGEST = 256          # partitions at most
HIDDEN = 64            # units of the classifier's one hidden layer
EPOCHS = 20
SLACK = 1.05           # a partition may hold so many times the mean of sampled rows
ROUTE_MASS = 0.97      # a query goes to its most probable partitions until their probabilities add up to this
ROW_BLOCK = 16_384     # rows of a partition compared in one task
QUERY_BLOCK = 2_048


# -- fitting, on a bounded sample --------------------------------------------------------------------------------
def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's ``k`` nearest other rows, block by block."""
    k = min(k, len(x) - 1)
    norms, out = (x ** 2).sum(axis=1), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        apart = norms[None, :] - 2 * x[at:at + 1024] @ x.T
        apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = np.inf
        out[at:at + 1024] = np.argpartition(apart, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node: regions grown along the graph to equal size, then nodes moved to where most neighbours are.

    A node may move only while its new part has room, so parts stay balanced.
    """
    n, k = graph.shape
    room = math.ceil(n / parts)
    both: list[list[int]] = [row.tolist() for row in graph]
    for a, row in enumerate(graph.tolist()):
        for b in row:
            both[b].append(a)
    label, now, size, front, start = np.full(n, -1), 0, 0, [], 0
    for _ in range(n):  # one node after the other, breadth first
        while front and label[front[0]] >= 0:
            front.pop(0)
        if not front:
            while label[start] >= 0:
                start += 1
            front = [start]
        node = front.pop(0)
        label[node] = now
        size += 1
        front += [b for b in both[node] if label[b] < 0]
        if size == room and now < parts - 1:
            now, size, front = now + 1, 0, front[:1]
    sizes = np.bincount(label, minlength=parts)
    most = math.ceil(room * SLACK)
    for _ in range(rounds):
        moved = 0
        for node in range(n):
            votes = np.bincount(label[both[node]], minlength=parts)
            own = label[node]
            votes[(sizes >= most) & (np.arange(parts) != own)] = 0
            best = int(votes.argmax())
            if votes[best] > votes[own]:
                sizes[own] -= 1
                sizes[best] += 1
                label[node] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer, from a vector to the probabilities of the parts."""

    def __init__(self, mean, scale, weights) -> None:
        self.mean, self.scale, self.weights = mean, scale, weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        z = np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int) -> Router:
    """Learn the share of each part among a row and its neighbours, by Adam on shuffled batches with a fixed seed."""
    draw = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    for column in graph.T:
        np.add.at(target, (np.arange(len(x)), label[column]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    dims = x.shape[1]
    weights = [draw.normal(0, math.sqrt(2 / dims), (dims, HIDDEN)), np.zeros(HIDDEN),
               draw.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at:at + 256]
            hidden = np.maximum(z[rows] @ weights[0] + weights[1], 0)
            out = hidden @ weights[2] + weights[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = (out / out.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (error @ weights[2].T) * (hidden > 0)
            step += 1
            for i, slope in enumerate((z[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope ** 2
                weights[i] = weights[i] - 0.004 * (1 - epoch / EPOCHS) * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Router(mean, scale, weights)


# -- Spark ---------------------------------------------------------------------------------------------------------
def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, v as doubles; of an id's rows one counts, the one with the smallest vector.

    Null ids, null and zero vectors and those with null or non-finite
    components take no part, nor do those of another length than the most
    common one (the longer one of equals).
    """
    v = F.col(vector).cast("array<double>")
    good = (~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))) & F.exists(v, lambda c: c != 0)
    kept = (rows.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good)
            .groupBy("id").agg(F.min("v").alias("v")))
    kept = stored(kept, "vectors")
    length = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("v") == (length["d"] if length else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of one length as rows of a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _blocks(df: DataFrame, sizes: dict[int, int], block: int, name: str) -> DataFrame:
    """Deal the rows of each part to as many numbered blocks as its size asks for, by id."""
    counts = F.create_map(*[F.lit(x) for p, n in sorted(sizes.items()) for x in (p, max(1, math.ceil(n / block)))])
    return df.withColumn(name, F.pmod(F.xxhash64("id"), counts[F.col("part")]).cast("int"))


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int):
    """For each query: positions of its ``k`` nearest rows and their distances, ties to the smaller id.

    Distances by one matrix product pick what may be among the nearest, with
    room for rounding; those are measured again by differences.
    """
    norms, q_norms = (x ** 2).sum(axis=1), (q ** 2).sum(axis=1)
    rough = norms[None, :] + q_norms[:, None] - 2 * q @ x.T
    rough[own[:, None] == ids[None, :]] = np.inf
    for i in range(len(q)):
        row = rough[i]
        if len(row) > k:
            edge = np.partition(row, k - 1)[k - 1] + 1e-9 * (q_norms[i] + norms.max() + 1)
            near = np.flatnonzero(row <= edge)
        else:
            near = np.arange(len(row))
        near = near[np.isfinite(row[near])]
        apart = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], apart))[:k]
        yield near[order], apart[order]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, by Euclidean distance in doubles.

    ``queries`` has the same columns; a row with the query's own id is no
    candidate. See ``usable`` for rows that take no part. The index is fitted
    on a sample of about SAMPLE rows chosen by hash: their neighbour graph is
    cut into balanced parts and a small network learns a vector's part. Then
    every row goes to its most probable part, every query to the several most
    probable, where distances are exact. Parts are compared in blocks of
    ROW_BLOCK rows by QUERY_BLOCK queries, so copies of one vector don't fill
    a task. An empty side gives no rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    base = usable(rows, key, vector)
    asked = usable(queries, key, vector).join(base.limit(1).select(F.size("v").alias("d")).distinct(), F.size("v") == F.col("d")).drop("d")
    n = base.count()
    bound = (1 << 53) * min(SAMPLE, n) // max(1, n)
    sample = base.where(F.shiftrightunsigned(F.xxhash64("id"), 11) < bound).orderBy("id").select("v").toPandas()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    if len(sample) < 2:
        parts, router = 1, None
    else:
        parts = max(1, min(LARGEST, round(math.sqrt(n) / 4), len(sample) // 16))
        x = np.stack(sample["v"].to_numpy())
        graph = neighbour_graph(x, NEIGHBOURS)
        router = fit_router(x, graph, balanced_cut(graph, parts), parts) if parts > 1 else None
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def home(batches):
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int32)
            if shared.value is not None and batch.num_rows:
                part = shared.value.probabilities(_matrix(batch.column(1))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", "id", "v"])

    def routes(batches):
        for batch in batches:
            took, part = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            if shared.value is not None and batch.num_rows:
                chance = shared.value.probabilities(_matrix(batch.column(1)))
                order = np.argsort(-chance, axis=1, kind="stable")
                before = np.cumsum(np.take_along_axis(chance, order, axis=1), axis=1) - np.take_along_axis(chance, order, axis=1)
                took, place = np.nonzero(before < ROUTE_MASS)
                part = order[took, place]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0).take(pa.array(took)),
                                              batch.column(1).take(pa.array(took))], names=["part", "id", "v"])

    layout = f"part int, id {kind}, v array<double>"
    placed = stored(base.select("id", "v").mapInArrow(home, layout), "placed")
    sent = stored(asked.select("id", "v").mapInArrow(routes, layout), "sent")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    loads = {r["part"]: r["n"] for r in sent.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes or not loads:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    left = _blocks(placed.where(F.col("part").isin(list(loads))), sizes, ROW_BLOCK, "block")
    right = _blocks(sent.where(F.col("part").isin(list(sizes))), loads, QUERY_BLOCK, "queries")
    number = lambda counts, block: F.create_map(*[F.lit(x) for p, n in sorted(counts.items())
                                                  for x in (p, max(1, math.ceil(n / block)))])[F.col("part")]
    left = left.withColumn("queries", F.explode(F.sequence(F.lit(0), F.coalesce(number(loads, QUERY_BLOCK), F.lit(1)) - 1)))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(number(sizes, ROW_BLOCK), F.lit(1)) - 1)))
    meeting = ["part", "block", "queries"]

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [[], [], []]
        if one.num_rows and two.num_rows:
            x, ids = _matrix(one["v"].combine_chunks()), np.asarray(one["id"])
            for at in range(0, two.num_rows, 256):
                some = two.slice(at, 256)
                own = np.asarray(some["id"])
                for i, (near, apart) in enumerate(_nearest(x, ids, _matrix(some["v"].combine_chunks()), own, k)):
                    out[0].append(np.full(len(near), own[i]))
                    out[1].append(ids[near])
                    out[2].append(apart)
        columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (ids_type, ids_type, np.float64))]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    ids_type = np.int64 if kind == "bigint" else np.int32
    found = left.groupBy(*meeting).cogroup(right.groupBy(*meeting)).applyInArrow(compare, schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
