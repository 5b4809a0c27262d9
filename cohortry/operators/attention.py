"""Attention over a node's in-edges, in layers with given weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.join import endpoints_exist
from cohortry.plans.session import cut_lineage

SLOPE = 0.2      # of a score below zero
SUMS_AT_ONCE = 8  # places of a vector that are summed by one row


@dataclass
class Layer:
    """Weights of a layer: ``weight`` is heads x inputs x outputs, ``source`` and ``target`` are heads x outputs.

    Heads are laid side by side, or averaged if ``concat`` is false. With
    ``scale`` and ``shift`` (a normalisation with fixed moments) the result is
    scaled, shifted and cut at zero; dropout has no part in scoring.
    """

    weight: np.ndarray
    source: np.ndarray
    target: np.ndarray
    concat: bool = True
    bias: np.ndarray | None = None
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None
    heads: int = field(init=False)
    outputs: int = field(init=False)

    def __post_init__(self) -> None:
        self.weight, self.source, self.target = (np.asarray(x, float) for x in (self.weight, self.source, self.target))
        self.heads, _, self.outputs = self.weight.shape

    @property
    def width(self) -> int:
        return self.heads * self.outputs if self.concat else self.outputs

    def finish(self, rows: np.ndarray) -> np.ndarray:
        out = rows if self.bias is None else rows + np.asarray(self.bias, float)
        if self.scale is None:
            return out
        return np.maximum(0.0, out * np.asarray(self.scale, float) + (0.0 if self.shift is None else np.asarray(self.shift, float)))


def draw_layers(inputs: int, hidden: int, outputs: int, layers: int = 3, heads: int = 4, seed: int = 42) -> list[Layer]:
    """Layers with evenly drawn weights: ``heads`` heads side by side and normalised, the last one with a single head."""
    draw = np.random.default_rng(seed)

    def layer(width: int, n: int, out: int, last: bool) -> Layer:
        edge = np.sqrt(6 / (width + n * out))
        shape = lambda *s: draw.uniform(-edge, edge, s)
        ones = None if last else np.ones(n * out)
        return Layer(shape(n, width, out), shape(n, out), shape(n, out), not last, np.zeros(out if last else n * out), ones)

    widths = [inputs, *[hidden * heads] * (layers - 1)]
    return [layer(w, heads if i < layers - 1 else 1, hidden if i < layers - 1 else outputs, i == layers - 1)
            for i, w in enumerate(widths)]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as a matrix; what is null or missing is zero, what is over the width is left out."""
    found = np.zeros((len(column), width))
    for i, row in enumerate(column.to_pylist()):
        if row:
            values = [0.0 if x is None else x for x in row[:width]]
            found[i, :len(values)] = values
    return found


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def _projected(features: DataFrame, layer: Layer) -> DataFrame:
    """(id, z, s, t): the vectors of all heads side by side, and each head's two parts of a score."""
    kind = features.schema["id"].dataType.simpleString()

    def each(batches):
        for batch in batches:
            z = np.einsum("ni,hio->nho", _rows(batch.column(1), layer.weight.shape[1]), layer.weight)
            s, t = (np.einsum("nho,ho->nh", z, a) for a in (layer.source, layer.target))
            flat = z.reshape(len(z), layer.heads * layer.outputs)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(flat), _lists(s), _lists(t)], names=["id", "z", "s", "t"])

    return features.select("id", F.col("features").cast("array<double>")).mapInArrow(
        each, f"id {kind}, z array<double>, s array<double>, t array<double>")


def _bent(score: Column) -> Column:
    return F.when(score < 0, score * SLOPE).otherwise(score)


def attend(features: DataFrame, edges: DataFrame, layer: Layer) -> DataFrame:
    """(id, features) after one layer: softmax-weighted sums of a node's own vector and those of its in-edges' sources.

    Loops in ``edges`` are replaced by one loop per node, edges to or from
    missing nodes are left out, and an edge that is there twice counts twice.
    A node without in-edges keeps its own projected vector. ``features`` has
    one row per id.

    The greatest score of a node's in-edges follows from the greatest source
    part, as bending keeps order, so it takes one maximum per node before
    anything is compared. Weights are stored per edge, narrow rows; vectors
    then go to the edges of their source, and are summed by (node, head, stretch
    of places) before they are shuffled: a hub is summed in many tasks. Joins
    are between stored tables, which lets adaptive execution split a hub.
    """
    nodes = cut_lineage(_projected(features, layer), "attention-nodes")
    known = endpoints_exist(edges.select("src", "dst").where("src <> dst"), nodes)
    links = cut_lineage(known.unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))), "attention-links")
    heads = range(layer.heads)
    scored = links.join(nodes.select(F.col("id").alias("src"), "s"), "src")
    highest = scored.groupBy("dst").agg(*[F.max(F.get("s", F.lit(h))).alias(f"m{h}") for h in heads])
    highest = highest.join(nodes.select(F.col("id").alias("dst"), "t"), "dst")
    highest = cut_lineage(highest.select("dst", "t", F.array(*[f"m{h}" for h in heads]).alias("m")), "attention-highest")

    part = lambda name, h: F.get(name, F.lit(h))
    share = [F.exp(_bent(part("s", h) + part("t", h)) - _bent(part("m", h) + part("t", h))) for h in heads]
    weighed = cut_lineage(scored.join(highest, "dst").select("src", "dst", F.array(*share).alias("w")), "attention-weights")

    stretches = -(-layer.outputs // SUMS_AT_ONCE)
    sent = (weighed.join(nodes.select(F.col("id").alias("src"), "z"), "src")
            .select("dst", "w", "z", F.explode(F.sequence(F.lit(0), F.lit(layer.heads * stretches - 1))).alias("slot")))
    head, first = F.floor(F.col("slot") / stretches).cast("int"), (F.col("slot") % stretches) * SUMS_AT_ONCE
    place = lambda k: F.when(first + k < layer.outputs, F.get("z", head * layer.outputs + first + k))
    weight = F.get("w", head)
    sums = sent.groupBy("dst", "slot").agg(F.sum(weight).alias("total"),
                                           *[F.sum(weight * place(k)).alias(f"p{k}") for k in range(SUMS_AT_ONCE)])
    values = F.filter(F.array(*[F.col(f"p{k}") / F.col("total") for k in range(SUMS_AT_ONCE)]), lambda x: x.isNotNull())
    listed = sums.groupBy(F.col("dst").alias("id")).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slot", values.alias("values")))), lambda x: x["values"])).alias("features"))
    return _finished(listed, layer)


def _finished(rows: DataFrame, layer: Layer) -> DataFrame:
    def each(batches):
        for batch in batches:
            out = _rows(batch.column(1), layer.heads * layer.outputs)
            if not layer.concat:
                out = out.reshape(len(out), layer.heads, layer.outputs).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(layer.finish(out))], names=["id", "features"])

    return rows.mapInArrow(each, rows.schema["id"].simpleString().replace(":", " ", 1) + ", features array<double>")


def embed(features: DataFrame, edges: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """(id, features) after all layers; each layer's result is stored for the next."""
    for i, layer in enumerate(layers):
        features = attend(features, edges, layer)
        if i < len(layers) - 1:
            features = cut_lineage(features, "attention-layer")
    return features
