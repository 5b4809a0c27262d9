"""Fill-in-the-middle: texts cut at two places and reordered by a displacement scatter.

The texts of a batch lie one behind the other as bytes. A cut text is a few
segments that each move as a whole, so a byte's place in the output is its own
place plus its segment's shift. The changes of shift at segment starts form a
difference array; its cumulative sum is the shift of every byte, and one
scatter writes all outputs. Going back, the marks in the outputs give the
segments, and a gather over the same kind of shifts reads the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import map_batches, text_or_empty

MARKS = (b"<P>", b"<S>", b"<M>")
MARK = 3               # bytes of a mark
PLAIN_FROM = 90        # of 100: texts that stay as they are
SPM_BELOW = 20         # of 100: texts with the suffix first
BLOCK = 1 << 20        # bytes whose shifts are held at once
GROUP_BYTES = 8 << 20  # texts are laid out in groups of about this size; a longer text is a group of its own


def draws(doc_id: object) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of a document's digest; a null id has no digits."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def _blocks(size: int):
    return ((at, min(at + BLOCK, size)) for at in range(0, size, BLOCK))


def _starts(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places in [low, high) where a code point starts."""
    return np.flatnonzero((data[low:high] & 0xC0) != 0x80) + low


def code_points_before(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points that start before each of the ascending byte offsets."""
    out, seen, done = np.empty(len(offsets), np.int64), 0, 0
    for low, high in _blocks(len(data)):
        here = _starts(data, low, high)
        upto = np.searchsorted(offsets, high)
        out[done:upto] = seen + np.searchsorted(here, offsets[done:upto])
        seen, done = seen + len(here), upto
    out[done:] = seen
    return out


def byte_places(data: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The byte at which each of the ascending code points starts; the end for one past the last."""
    out, seen, done = np.empty(len(points), np.int64), 0, 0
    for low, high in _blocks(len(data)):
        here = _starts(data, low, high)
        upto = np.searchsorted(points, seen + len(here))
        out[done:upto] = here[points[done:upto] - seen]
        seen, done = seen + len(here), upto
    out[done:] = len(data)
    return out


def mark_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, mark number, row) of every mark that lies within one row, in order of place."""
    places, numbers = [], []
    for low, high in _blocks(len(data)):
        at = np.flatnonzero(data[low:high] == MARKS[0][0]) + low
        at = at[at + MARK <= len(data)]
        at = at[data[at + 2] == MARKS[0][2]]
        for number, mark in enumerate(MARKS):
            hit = at[data[at + 1] == mark[1]]
            places.append(hit)
            numbers.append(np.full(len(hit), number))
    place = np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int64)
    number = np.concatenate([*numbers, np.empty(0, np.int64)]).astype(np.int64)
    order = np.argsort(place)
    place, number = place[order], number[order]
    row = np.searchsorted(offsets, place, "right") - 1
    whole = place + MARK <= offsets[row + 1]
    return place[whole], number[whole], row[whole]


def shifts(starts: np.ndarray, shift: np.ndarray, size: int):
    """(low, high, shift of each byte in [low, high)) block by block.

    ``starts`` are the ascending starts of segments, the first at 0, and
    ``shift`` how far each segment moves. The change of shift at each start is
    summed into a difference array (empty segments share a start), whose
    running sum is the shift of every byte.
    """
    change = np.diff(shift, prepend=0)
    carry, done = 0, 0
    for low, high in _blocks(size):
        difference = np.zeros(high - low, np.int64)
        upto = np.searchsorted(starts, high)
        np.add.at(difference, starts[done:upto] - low, change[done:upto])
        difference[0] += carry
        each = np.cumsum(difference)
        carry, done = int(each[-1]), upto
        yield low, high, each


def lay_out(data: np.ndarray, offsets: np.ndarray, ids: list) -> dict:
    """Cut and reorder the rows between ``offsets``: output bytes, their offsets, form and cuts of each row."""
    rows = len(ids)
    before = code_points_before(data, offsets)
    n = np.diff(before)
    h = np.array([draws(i) for i in ids], np.int64).reshape(rows, 4)
    cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    plain = (n == 0) | (h[:, 2] % 100 >= PLAIN_FROM)
    plain[mark_places(data, offsets)[2]] = True
    spm = ~plain & (h[:, 3] % 100 < SPM_BELOW)
    cut[plain] = n[plain, None]  # one segment, the whole text

    places = byte_places(data, (before[:-1, None] + cut).ravel()).reshape(rows, 2)
    start, end = offsets[:-1], offsets[1:]
    prefix, middle, suffix = places[:, 0] - start, places[:, 1] - places[:, 0], end - places[:, 1]
    marks = np.where(plain, 0, MARK)
    out_offsets = np.concatenate([[0], np.cumsum(end - start + 3 * marks)])
    base = out_offsets[:-1]
    to_prefix = base + marks + np.where(spm, suffix + marks, 0)
    to_suffix = base + marks + np.where(spm, 0, prefix + marks)
    to_middle = base + 3 * marks + prefix + suffix

    starts = np.stack([start, places[:, 0], places[:, 1]], axis=1).ravel()
    shift = np.stack([to_prefix - start, to_middle - places[:, 0], to_suffix - places[:, 1]], axis=1).ravel()
    out = np.empty(int(out_offsets[-1]), np.uint8)
    for low, high, each in shifts(starts, shift, len(data)):
        out[np.arange(low, high) + each] = data[low:high]
    for mark, to in zip(MARKS, (to_prefix, to_suffix, to_middle)):
        at = (to - MARK)[~plain]
        for k, byte in enumerate(mark):
            out[at + k] = byte
    return {"out": out, "offsets": out_offsets, "n": n, "plain": plain, "spm": spm, "prefix": cut[:, 0], "middle": cut[:, 1] - cut[:, 0]}


def gather_back(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind the outputs between ``offsets``, from the outputs and their forms alone.

    A formed output holds each mark exactly once, as its text held none and a
    mark can't arise where a text meets one.
    """
    place, number, row = mark_places(data, offsets)
    formed = ~plain[row]
    at = np.zeros((len(plain), 3), np.int64)
    at[row[formed], number[formed]] = place[formed]
    marks = np.where(plain, 0, MARK)
    start, end = offsets[:-1], offsets[1:]
    after = at + MARK
    first_p, first_s = after[:, 0], after[:, 1]
    prefix = np.where(plain, end - start, np.where(spm, at[:, 2], at[:, 1]) - first_p)
    suffix = np.where(plain, 0, np.where(spm, at[:, 0], at[:, 2]) - first_s)
    middle = np.where(plain, 0, end - after[:, 2])
    text_offsets = np.concatenate([[0], np.cumsum(end - start - 3 * marks)])
    base = text_offsets[:-1]
    starts = np.stack([base, base + prefix, base + prefix + middle], axis=1).ravel()
    source = np.stack([np.where(plain, start, first_p), np.where(plain, end, after[:, 2]), np.where(plain, end, first_s)], axis=1).ravel()
    text = np.empty(int(text_offsets[-1]), np.uint8)
    for low, high, each in shifts(starts, source - starts, len(text)):
        text[low:high] = data[np.arange(low, high) + each]
    return text, text_offsets


def _groups(batch: pa.RecordBatch, column: int):
    """(sub-batch, bytes, offsets) in groups of at least one row and about ``GROUP_BYTES``."""
    lengths = np.asarray(pc.binary_length(batch.column(column)), np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + GROUP_BYTES
        to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        part = batch.slice(at, to - at)
        texts = part.column(column)
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, bounds, values = texts.buffers()
        offsets = np.frombuffer(bounds, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(values or b"", np.uint8)[offsets[0]:offsets[-1]]
        yield part, data, offsets - offsets[0]
        at = to


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if offsets[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


FORMS = np.array(["psm", "spm", "plain"])


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row.

    Two cuts and the form follow from the key's digest, so repeated rows give
    equal results; a null key is written as no digits. Null and empty texts,
    texts that hold a mark, and a tenth of the others are ``plain``: the output
    is the text, and the two lengths are null. Lengths and cuts are in code
    points. Rows are not moved; the shifts of a long text are held a block at
    a time.
    """

    def each(batches, names):
        for batch in batches:
            for part, data, offsets in _groups(batch, 1):
                r = lay_out(data, offsets, part.column(0).to_pylist())
                form = FORMS[np.where(r["plain"], 2, r["spm"].astype(int))]
                cuts = [pa.array(r[c], pa.int64(), mask=r["plain"]) for c in ("prefix", "middle")]
                columns = [part.column(0), pa.array(r["n"], pa.int64()), pa.array(form), *cuts, _strings(r["out"], r["offsets"])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, names)], schema=names)

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs, [key, text_or_empty(text)], each,
                       f"{key} {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(formed: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """Add the text behind each output, from the output and its form alone.

    Null outputs count as empty; a row whose form is null or unknown is taken
    as plain.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema)
    keep = [F.col(f"`{c}`") for c in formed.columns]
    last = len(keep)

    def each(batches, names):
        for batch in batches:
            for part, data, offsets in _groups(batch, last):
                forms = part.column(last + 1).to_pylist()
                spm = np.array([f == "spm" for f in forms], bool)
                plain = ~(spm | np.array([f == "psm" for f in forms], bool))
                columns = [*part.columns[:last], _strings(*gather_back(data, offsets, plain, spm))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, names)], schema=names)

    inputs = [*keep, F.coalesce(F.col(output), F.lit("")).alias("__output"), F.col(form).alias("__form")]
    return map_batches(formed, inputs, each, f"{kinds}, `{name}` string")


def digest(restored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash columns for the outputs and the restored texts."""
    return restored.select(
        key, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(F.col("restored"), 256).alias("restored_sha256"))
