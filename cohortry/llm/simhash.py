"""SimHash near-duplicates: byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import batch_of, map_batches, stored, text_or_empty
from cohortry.llm.graph import components, without_keys

SEED = 42
BYTES = 8
BLOCK = 8192      # fingerprints of one posting list that a task compares at once
AT_ONCE = 1 << 16  # shingle hashes whose bits are counted together


def fingerprint(text: str, shingle: int) -> int:
    """The SimHash of lower-cased (A-Z) word shingles, as a signed 64-bit number; 0 without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space signs
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1)[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())),
                             np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[at:at + AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row; a null text is empty."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches, names):
        for batch in batches:
            yield batch_of(names, [batch.column(0), [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]])

    return map_batches(docs, [key, text_or_empty(text)], each, f"{key} {kind}, fp bigint")


def _lists(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any two fingerprints within ``distance`` bits agree on one whole set.

    At least ``8 - distance`` bytes agree. The positions are cut into two
    halves; one holds at least half of those (rounded up), and every choice of
    so many positions of a half is a set.
    """
    from itertools import combinations

    least = (BYTES - distance + 1) // 2
    halves = (range(BYTES // 2), range(BYTES // 2, BYTES))
    return [c for half in halves for c in combinations(half, least)]


def _links(fps: np.ndarray, ids: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is linked inside one posting list, as many as fingerprints at most.

    Grows one component after the other: a fingerprint is compared with those
    not reached yet only. Shared positional bytes are tallied, pairs with fewer
    than ``8 - distance`` are dropped, the rest verified bit by bit.
    """
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            apart = fps[left] ^ fps[at]
            shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            kept = np.flatnonzero(shared >= BYTES - distance)
            kept = kept[np.bitwise_count(apart[kept].view(np.uint64)) <= distance]
            if len(kept):
                near = left[kept]
                yield np.full(len(near), ids[at]), ids[near]
                queue += near.tolist()
                left = np.delete(left, kept)


def links(classes: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between class ids that connect all fingerprints within ``distance`` bits; (fp, id) rows are unique.

    Each fingerprint goes to a few posting lists, each keyed by the values of
    some byte positions. Lists of one are dropped. A list of more than BLOCK is
    cut into blocks by hash, and every two blocks meet in a group of their own,
    so that no task holds more than two blocks.
    """
    masks = []
    for positions in _lists(distance):
        mask = sum(0xFF << (8 * p) for p in positions)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    posted = classes.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("value"))
        for i, m in enumerate(masks)])).alias("p"), "fp", "id").select("p.*", "fp", "id")
    sizes = (posted.groupBy("list", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("list", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    met = posted.join(sizes, ["list", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                            lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other))
    met = met.select("list", "value", F.explode(with_each).alias("meeting"), "fp", "id")
    together = met.repartition("list", "value", "meeting").sortWithinPartitions("list", "value", "meeting", "fp")

    def each(batches):
        names = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[tuple] = []
        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in range(5)]
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            new = np.ones(len(columns[0]), bool)
            new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
            starts = np.flatnonzero(new)
            last = starts[-1] if len(starts) else 0
            yield from _edges(columns, starts, names, distance)
            held = [c[last:] for c in columns]
        if held:
            yield from _edges(held, np.array([0, len(held[0])]), names, distance)

    return together.mapInArrow(each, "a bigint, b bigint").distinct()


def _edges(columns, starts: np.ndarray, names: pa.Schema, distance: int) -> Iterator[pa.RecordBatch]:
    """The links of all groups but the last start's, which may go on."""
    a, b = [], []
    sizes = np.diff(starts)
    for at, size in zip(starts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        for left, right in _links(columns[3][at:at + size], columns[4][at:at + size], distance):
            a.append(left)
            b.append(right)
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=names)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row; fingerprints link at ``distance`` (0 to 5) or fewer differing bits.

    Rows with one fingerprint are one class, kept by its smallest key, so copies
    make no pairs. A null text is empty, texts without words have fingerprint
    zero and link like any other. Repeated rows are kept. A row with a null key
    is in its fingerprint's component; null if that has no key at all. The key
    must be an integer column.
    """
    if not 0 <= distance <= 5:
        raise ValueError("distance must be 0 to 5 bits")
    prints = stored(fingerprints(docs, shingle, key, text), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min(key).cast("bigint").alias("id")), "classes")
    found = components(links(classes.where("id IS NOT NULL"), distance))
    rooted = classes.join(found, classes["id"] == found["node"], "left").select(
        "fp", F.coalesce("root", "id").alias("component_id"))
    # a fingerprint with many rows is split by the row's key; its one partner goes to every part
    return (prints.join(rooted, "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest key of each component only.

    Rows with a null key can't be told apart and stay. Where a key is repeated,
    one row of it stays.
    """
    found = stored(near_duplicates(docs, shingle, distance, key, text).where(F.col(key).isNotNull()), "components")
    gone = found.where(F.col(key) != F.col("component_id")).select(key)
    repeated = stored(found.where(F.col(key) == F.col("component_id")).groupBy(key)
                      .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    kept = without_keys(docs, gone.unionByName(repeated), key)
    return kept.unionByName(docs.join(repeated, key, "left_semi").select(*docs.columns).dropDuplicates([key]))
