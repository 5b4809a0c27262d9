"""Token counts by byte-pair merging with a heap over a linked list of symbols."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cohortry.llm.common import kept_tables, map_batches, text_or_empty

SPACE = "▁"
CACHED_UNITS = 500_000  # units kept per Python worker
CACHED_LENGTH = 48        # longer units are counted again each time


class PieceCounter(dict):
    """unit -> number of pieces, for a byte-fallback pair vocabulary that marks spaces.

    No piece holds the space mark after another character, so a run of marks
    and what follows up to the next mark is counted on its own. Counting needs
    no identifiers: symbols at the start minus merges, plus the further bytes
    of characters that are no piece.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in range(model.vocab_size()) if not special(i)}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("pieces cross word limits; units can't be counted one by one")
        self.runs = regex.compile(f"{SPACE}+[^{SPACE}]*")

    def __missing__(self, unit: str) -> int:
        n = self.merge(SPACE + unit)
        if len(unit) <= CACHED_LENGTH:
            if len(self) >= CACHED_UNITS:
                self.clear()
            self[unit] = n
        return n

    def merge(self, unit: str) -> int:
        """Pop the lowest-ranked adjacent pair, ties to the left, until none is left."""
        symbols, rank, n = list(unit), self.rank, len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two was merged away
            symbols[i], symbols[j] = pair, ""
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                more = pair + symbols[k]
                if more in rank:
                    heappush(heap, (rank[more], i, more))
            k = before[i]
            if k >= 0:
                more = symbols[k] + pair
                if more in rank:
                    heappush(heap, (rank[more], k, more))
        left_over = sum(len(s.encode()) - 1 for s in symbols if s and s not in rank)
        return n - merges + left_over

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        if SPACE + SPACE in marked or marked[0] == SPACE:
            return sum(self[unit[1:]] for unit in self.runs.findall(SPACE + marked))
        return sum(map(self.__getitem__, marked.split(SPACE)))


def counter(path: str) -> PieceCounter:
    tables = kept_tables(__name__)
    if path not in tables:
        tables[path] = PieceCounter(path)
    return tables[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, repeated rows and null keys included.

    Null and empty texts have 0 bytes and 0 tokens. ``vocabulary`` is the path
    of a sentencepiece model that every executor can open; units seen before
    are looked up in a bounded table of the worker.
    """

    def each(batches, names):
        count = counter(vocabulary).count
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), tokens, pc.greater(tokens, limit)],
                schema=names)

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs, [key, text_or_empty(text)], each,
                       f"{key} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
