"""Equivalence classes of the tokens of a host's pages, nested into its template, and the slots between them.

A page is a sequence of tokens: 0 for its start, then start tags (even
numbers) and blocks of text (odd ones). Tokens that occur equally often in
each page of a host are a class. A class is ordered if its tokens come in one
order in every page, time after time; it is nested if it crosses no other
class and always lies in the same slot of the same class. A slot is the gap
after a token of a class; what a page has of its own lies in the slots.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import batch_of, map_batches, stored

OTHER = -1  # in a page laid out: a text that belongs to no class
PAGES = "host string, page bigint, tokens array<bigint>, chars array<int>, links array<int>, kinds array<bigint>, counts array<int>"


class Layout:
    """The classes of a host. A token's code is its place in ``tokens``, a class goes by its first code.

    ``ranks`` holds the place of codes in their class, -1 where that is not
    the same in all pages. ``nests`` holds the slot that each class lies in, -1
    for none; without it all ordered classes count, with it those that are
    nested in the root at last. A root that comes in no one order is the page as
    one slot. ``fixed`` tokens occur equally often in all pages that
    hold them: they are template even where their class is not ordered or nested.
    """

    def __init__(self, tokens: Sequence[int], classes: Sequence[int], fixed: Sequence[bool], ranks: dict[int, int] | None = None,
                 nests: dict[int, int] | None = None, link_slots: Sequence[int] | None = None) -> None:
        self.members: dict[int, list[int]] = {}
        first: dict[int, int] = {}
        for code, name in enumerate(classes):
            self.members.setdefault(first.setdefault(name, code), []).append(code)
        self.members = {c: codes for c, codes in self.members.items() if fixed[c] or len(codes) > 1}
        self.class_of = {code: c for c, codes in self.members.items() for code in codes}
        self.code = {tokens[code]: code for code in self.class_of}
        self.root = self.class_of[self.code[0]]
        ranks = ranks or {}
        ordered = {c for c, codes in self.members.items() if len(codes) > 1 and all(ranks.get(x, -1) >= 0 for x in codes)}
        if nests is not None:
            ordered = {c for c in ordered if self._nested(c, ordered, nests)}
        self.place = {x: (c, ranks[x], len(self.members[c])) for c in ordered for x in self.members[c]}
        self.texts = frozenset(tokens[x] for x, c in self.class_of.items() if tokens[x] & 1 and (fixed[x] or c in ordered))
        self.text_ids = frozenset(x & (1 << 64) - 1 for x in self.texts)  # as they are hashed
        self.link_slots = frozenset(slot for slot in link_slots or () if slot >> 32 in ordered)

    def _nested(self, c: int, ordered: set[int], nests: dict[int, int]) -> bool:
        passed = set()
        while c != self.root:
            if c in passed or c not in ordered or nests.get(c, -1) < 0:
                return False
            passed.add(c)
            c = nests[c] >> 32
        return True

    def lay(self, tokens: Sequence[int]) -> list[int]:
        """Codes of a page's tokens, OTHER for texts of no class; other start tags are left out."""
        codes = [self.code.get(token, OTHER) for token in tokens]
        return [code for code, token in zip(codes, tokens) if code != OTHER or token & 1]

    def ranks_in(self, laid: Sequence[int]) -> dict[int, int]:
        """Place of each code in its class, in this page; -1 for all of a class that comes in no one order."""
        came: dict[int, list[int]] = {}
        for code in laid:
            if code != OTHER:
                came.setdefault(self.class_of[code], []).append(code)
        out = {}
        for c, codes in came.items():
            size = len(self.members[c])
            one = codes[:size]
            whole = len(set(one)) == size and one * (len(codes) // size) == codes
            out |= {code: i for i, code in enumerate(one)} if whole else dict.fromkeys(self.members[c], -1)
        return out

    def walk(self, laid: Sequence[int]) -> tuple[list[int], set[tuple[int, int]]]:
        """The slot of each OTHER, and (class, slot it lies in) of all that come; -1 for the smaller of two that cross."""
        stack, slots, found = [[self.root, 0]], [], set()
        for code in laid:
            if code == OTHER:
                slots.append((stack[-1][0] << 32) + stack[-1][1])
                continue
            if code not in self.place:
                continue
            c, rank, size = self.place[code]
            if rank == 0 and c != self.root:
                found.add((c, (stack[-1][0] << 32) + stack[-1][1]))
                stack.append([c, 0])
            else:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c), None)
                if at is None:
                    continue
                for other, _ in stack[at + 1:]:
                    found.add((min((c, other), key=lambda x: (x == self.root, len(self.members[x]), -x)), -1))
                del stack[at + 1:]
                stack[-1][1] = rank
            if rank == size - 1 and c != self.root:
                stack.pop()
        return slots, found


MODEL = ["known", "classes", "fixed", "codes", "ranks", "nested", "nests", "link_slots"]


def layouts_of(batch: pa.RecordBatch, first: int, held: int = len(MODEL)) -> Iterator[Layout | None]:
    """The Layout of each row, made once for the rows of a host; None without one. The host is column 0, ``held`` columns of MODEL follow ``first``."""
    made: dict[str, Layout | None] = {}
    for i, name in enumerate(batch.column(0).to_pylist()):
        if name not in made:
            known, classes, fixed, codes, ranks, nested, nests, links = [
                batch.column(first + j)[i].as_py() if j < held else None for j in range(len(MODEL))]
            made[name] = None if known is None else Layout(
                known, classes, fixed, dict(zip(codes or [], ranks or [])),
                dict(zip(nested or [], nests or [])) if held > 5 else None, links)
        yield made[name]


def _listed(rows: DataFrame, *names: str) -> DataFrame:
    """(host, an array for each column), in the order of the columns."""
    listed = rows.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("__l"))
    return listed.select("host", *[F.col(f"__l.{n}").alias(n) for n in names])


def _one(name: str) -> Column:
    """The value that all rows have, else -1."""
    return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(F.lit(-1)).alias(name)


def deduce(pages: DataFrame, least_pages: int, share: float, link_share: float) -> DataFrame:
    """(host, columns of MODEL): the template of each host, from its distinct ``pages``, a stored table with the columns PAGES.

    Vectors of occurrence are compared by the sum of a hash of page and count,
    orders and slots by their least and greatest over the pages. What is held
    together is a page, or the classes of a host: as each is in a ``share`` of
    the pages they are about as many as a page's tokens. Link slots have more than
    ``link_share`` of their characters in links, over all pages of the host.
    """
    counted = pages.select("host", "page", F.inline(F.arrays_zip("kinds", "counts")))
    vectors = counted.groupBy("host", F.col("kinds").alias("known")).agg(
        F.sum(F.xxhash64("page", "counts").cast("decimal(20,0)")).alias("vector"), F.count(F.lit(1)).alias("support"),
        F.min("counts").alias("low"), F.max("counts").alias("high"))
    vectors = stored(vectors.where(F.col("support") >= least_pages), "vectors")
    roots = vectors.where("known = 0").select("host", F.col("support").alias("pages"))
    classes = vectors.join(roots, "host").where(F.col("support") >= F.ceil(F.col("pages") * F.lit(share))).select(
        "host", F.xxhash64("vector").alias("classes"), "known", (F.col("low") == F.col("high")).alias("fixed"))
    hosts = stored(_listed(classes, "classes", "known", "fixed"), "classes")

    def lay(batches, names):
        for batch in batches:
            out = []
            for layout, name, tokens, chars, links in zip(layouts_of(batch, 4, 3), *(batch.column(i).to_pylist() for i in range(4))):
                laid = layout.lay(tokens)
                own = [token not in layout.code for token in tokens if token & 1]
                ranks = layout.ranks_in(laid)
                out.append((name, laid, [n for n, x in zip(chars, own) if x], [n for n, x in zip(links, own) if x],
                            list(ranks), list(ranks.values())))
            yield batch_of(names, list(zip(*out)))

    laid = stored(map_batches(
        pages.join(hosts, "host"), ["host", "tokens", "chars", "links", *MODEL[:3]], lay,
        "host string, laid array<int>, chars array<int>, links array<int>, codes array<int>, ranks array<int>"), "laid")
    ranks = laid.select("host", F.inline(F.arrays_zip("codes", "ranks"))).groupBy("host", "codes").agg(_one("ranks"))
    hosts = stored(hosts.join(_listed(ranks, "codes", "ranks"), "host"), "orders")
    laid = laid.drop("codes", "ranks")

    def nest(batches, names):
        for batch in batches:
            found = set()
            for layout, name, codes in zip(layouts_of(batch, 2, 5), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found |= {(name, *one) for one in layout.walk(codes)[1]}
            if found:
                yield batch_of(names, list(zip(*found)))

    nests = map_batches(laid.join(hosts, "host"), ["host", "laid", *MODEL[:5]], nest, "host string, nested int, nests bigint")
    nests = nests.groupBy("host", "nested").agg(_one("nests"))
    hosts = stored(hosts.join(_listed(nests, "nested", "nests"), "host", "left"), "nests")

    def fill(batches, names):
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            rows = zip(layouts_of(batch, 4, 7), *(batch.column(i).to_pylist() for i in range(4)))
            for layout, name, codes, chars, links in rows:
                for slot, n, n_links in zip(layout.walk(codes)[0], chars, links):
                    total = sums.setdefault((name, slot), [0, 0])
                    total[0] += n
                    total[1] += n_links
            if sums:
                yield batch_of(names, list(zip(*[(*key, *total) for key, total in sums.items()])))

    filled = map_batches(laid.join(hosts, "host"), ["host", "laid", "chars", "links", *MODEL[:7]], fill,
                         "host string, link_slots bigint, chars bigint, links bigint")
    linked = filled.groupBy("host", "link_slots").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).where(
        F.col("links") > F.lit(link_share) * F.col("chars"))
    return hosts.join(_listed(linked, "link_slots"), "host", "left")
