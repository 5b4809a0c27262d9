"""Sum-of-squares online packing of tokenised documents into windows."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortry.llm.common import batch_of, kept_tables, map_batches, text_or_empty

OPEN_WINDOWS = 1024       # partly filled windows a task keeps at most
CACHED_WORDS = 400_000    # words and pieces of words a Python worker keeps
CACHED_LENGTH = 48


def _byte_signs() -> list[str]:
    """The sign that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, free = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in signs:
            signs[b], free = chr(free), free + 1
    return [signs[b] for b in range(256)]


class WordIds(dict):
    """piece or word -> its ids as little-endian bytes, for a pair vocabulary that drops white space.

    White space always ends a piece here and never gets an id, so a text's ids
    are those of its words, one after the other. Latin text is cut into pieces
    by one pattern, and the table holds those; other words are held whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.as_signs = {b: c for b, c in zip(range(256), _byte_signs())}
        self.white = regex.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        # Latin text without signs that could belong to a special string or a clitic
        latin = "!-&(-;=?-~\u00c0-\u00ff\u0100-\u012f\u0131-\u0148\u014a-\u017e"
        self.other = re.compile(f"[^\t-\r\x20{latin}]")
        letters = "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u017e"
        self.pieces = re.compile(f"[{letters}]+|[0-9]|[^{letters}0-9\t-\r\x20]+")

    def __missing__(self, word: str) -> bytes:
        if self.other.search(word):
            ids = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.as_signs)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.merge(signs)])
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not self.other.search(text):
            return self._latin(text)
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # split() takes them for white space
            words = self.white.split(text)
        else:
            words = text.split()
        return b"".join([self[w] if self.other.search(w) else self._latin(w) for w in words])

    def _latin(self, text: str) -> bytes:
        """Runs of letters, single digits and runs of other signs, each looked up on its own."""
        return b"".join(map(self.__getitem__, self.pieces.findall(text.lower())))


def word_ids(path: str) -> WordIds:
    tables = kept_tables(__name__)
    if path not in tables:
        tables[path] = WordIds(path)
    return tables[path]


class Packer:
    """Places items one by one where the sum of squared level counts grows least.

    ``counts[h]`` is the number of windows filled to level h. Of all levels
    that have a window and room, and a new window, the one with the smallest
    sum of squares afterwards is taken, the fullest of equals. ``leave`` and
    ``enter`` hold what a level's count adds to the sum when a window goes or comes.
    """

    def __init__(self, window: int, first_id: int) -> None:
        self.window, self.next_id, self.open = window, first_id, 0
        self.counts = np.zeros(window + 1, np.int64)
        self.leave = np.full(window + 1, np.iinfo(np.int64).max // 4)
        self.enter = np.ones(window + 1, np.int64)
        self.leave[0] = self.enter[window] = 0
        self.levels: list[list] = [[] for _ in range(window + 1)]  # level -> windows, each a list of pieces
        self.rows: list[tuple] = []

    def _count(self, level: int, change: int) -> None:
        n = self.counts[level] = self.counts[level] + change
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.enter[level] = 2 * n + 1
        self.open += change

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self._close([(doc, at, ids[4 * at:4 * (at + self.window)], total)])
            at += self.window
        if at < total:
            self._place((doc, at, ids[4 * at:], total))
            if self.open > OPEN_WINDOWS:
                self.drain()

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        cost = self.leave[:self.window - size + 1] + self.enter[size:]
        level = len(cost) - 1 - int(cost[::-1].argmin())
        content = []
        if level:
            content = self.levels[level].pop()
            self._count(level, -1)
        content.append(piece)
        self._keep(content, level + size)

    def _keep(self, content: list, level: int) -> None:
        if level == self.window:
            self._close(content)
        else:
            self.levels[level].append(content)
            self._count(level, 1)

    def _close(self, content: list) -> None:
        offset = 0
        for doc, start, ids, total in content:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def _take_open(self) -> list[tuple[int, list]]:
        """All partly filled windows with their levels, emptiest first; none is left open."""
        windows = []
        for level in np.flatnonzero(self.counts).tolist():
            windows += [(level, content) for content in self.levels[level]]
            self._count(level, -len(self.levels[level]))
            self.levels[level] = []
        return windows

    def drain(self) -> None:
        """Cut pieces of the emptiest windows to fill the fullest; one window at most stays open."""
        windows = self._take_open()
        low, high = 0, len(windows) - 1
        spare, spare_size = [], 0
        while low <= high:
            level, content = windows[high]
            high -= 1
            while level < self.window and (spare or low <= high):
                if not spare:
                    spare_size, spare = windows[low]
                    low += 1
                doc, start, ids, total = spare.pop()
                cut = min(len(ids) // 4, self.window - level)
                content.append((doc, start, ids[:4 * cut], total))
                if 4 * cut < len(ids):
                    spare.append((doc, start + cut, ids[4 * cut:], total))
                level += cut
            if level == self.window:
                self._close(content)
            else:
                self._keep(content, level)
        if spare:
            self._keep(spare, sum(len(p[2]) // 4 for p in spare))

    def finish(self) -> None:
        """Cut what is left at powers of two, which need no padding."""
        self.drain()
        for left, content in self._take_open():
            pieces = content[::-1]
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                sequence = []
                while room:
                    doc, start, ids, total = pieces.pop()
                    cut = min(len(ids) // 4, room)
                    sequence.append((doc, start, ids[:4 * cut], total))
                    if 4 * cut < len(ids):
                        pieces.append((doc, start + cut, ids[4 * cut:], total))
                    room -= cut
                self._close(sequence)

    def take(self) -> list:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, vocabulary: str, window: int, end_id: int, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A row's tokens are its text's ids and ``end_id``; a null or empty text has
    the end id alone, repeated rows are packed each, null keys stay null. Full
    windows are cut off first; the rest is packed online, task by task, without
    a shuffle, in the order of the files. A task keeps a bounded number of
    partly filled windows and empties them by cutting when there are more, and
    at its end: what then remains is cut into sequences whose lengths are
    powers of two. So no sequence needs padding, and a repeated task gives the
    same sequences again. ``sequence_id`` is unique over all tasks.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"{key} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")

    def each(batches, names):
        ids_of = word_ids(vocabulary).ids
        end = np.asarray([end_id], "<u4").tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, ids_of(words) + end)
            if rows := packer.take():
                yield batch_of(names, list(zip(*rows)))
        packer.finish()
        if rows := packer.take():
            yield batch_of(names, list(zip(*rows)))

    return map_batches(docs, [key, text_or_empty(text)], each, schema)
