"""Benchmark decontamination: exact hits of item pieces by Aho-Corasick, verified by Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import release

#: Edits allowed per letter of an item. Items of fewer letters than LEAST count only without an edit and between word borders.
ERROR_RATE, LEAST = 0.08, 24
#: Letters of benchmark items searched at once; more items are searched in further blocks.
BLOCK_LETTERS = 4_000_000


def normal(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


class Item:
    """One benchmark item as a bit-parallel pattern."""

    def __init__(self, key: int, text: str, rate: float = ERROR_RATE):
        self.key, self.text, self.size = key, text, len(text)
        self.budget = int(self.size * rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> Iterator[tuple[int, str]]:
        """Budget + 1 pieces of almost equal size, with their offsets; some piece is whole wherever edits stay within the budget."""
        n = self.budget + 1
        cuts = [self.size * i // n for i in range(n + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield a, self.text[a:b]

    def search(self, text: str) -> tuple[int, int]:
        """Least edit distance of the item to any part of text, and the end of the first such part."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, now = full, 0, self.size
        best, at = now, 0
        for i, c in enumerate(text, 1):
            same = self.masks.get(c, 0)
            level = ((((same & up) + up) ^ up) | same | down) & full
            more, less = down | (full & ~(level | up)), level & up
            if more & top:
                now += 1
            elif less & top:
                now -= 1
            more, less = more << 1 & full, less << 1 & full
            up, down = less | (full & ~(level | more)), more & level
            if now < best:
                best, at = now, i
        return best, at


class Search:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, least: int = LEAST):
        self.items = [Item(key, t, rate if len(t) >= least else 0) for key, text in items if (t := normal(text))]
        self.least = least
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for offset, piece in item.pieces():
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """item_id, errors and end (in the normalised text) of the best match of each item within its budget."""
        if not self.items:
            return []
        text = normal(text)
        windows: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                windows.setdefault(n, []).append(end + 1 - size - offset - self.items[n].budget)
        found = []
        for n, begins in windows.items():
            item, best = self.items[n], None
            if item.size < self.least:
                if ends := [b + item.size for b in begins if _bordered(text, b, b + item.size)]:
                    found.append((item.key, 0, min(ends)))
                continue
            for a, b in _joined(begins, item.size + 2 * item.budget):
                errors, at = item.search(text[max(0, a) : max(0, b)])
                if errors <= item.budget and (best is None or errors < best[0]):
                    best = errors, max(0, a) + at
            if best:
                found.append((item.key, *best))
        return sorted(found)


def _bordered(text: str, a: int, b: int) -> bool:
    """Whether no word of text runs over the ends of text[a:b]."""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b - 1].isalnum() and text[b].isalnum())


def _joined(begins: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Windows of one size as few that do not meet, in order."""
    begins.sort()
    a, b = begins[0], begins[0] + size
    for x in begins:
        if x > b:
            yield a, b
            a = x
        b = x + size
    yield a, b


def item_blocks(benchmark: DataFrame, block_letters: int = BLOCK_LETTERS, bare: bool = False) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of about block_letters letters, each of which fits a worker and is held by the driver one at a time. Null texts are left out, null ids too unless bare (they count as 0)."""
    known = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    known = known.fillna(0, ["item_id"]) if bare else known.where("item_id IS NOT NULL")
    letters = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-letters // block_letters))
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield sorted((r.item_id, r.text) for r in rows)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = LEAST, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """doc_id, item_id, errors, match_end: each benchmark item that stands in a row's text with at most rate * letters edits.

    Items of fewer than least letters (after normalising) must stand there unchanged, between word borders. Items without an id are left out.
    Case and the kind and amount of white space don't count. errors is the least number of edits, match_end the end of the first such
    place in the normalised text. A null or empty text has no match; a row that repeats gives its matches again; an
    item that repeats under one id gives one match a copy; empty tables give an empty result.
    """
    out = None
    for items in item_blocks(benchmark, block_letters):
        held = docs.sparkSession.sparkContext.broadcast(items)  # one block

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Search(held.value, rate, least)
            for batch in batches:
                rows = [(d, *m) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for m in search.matches(text.as_py() or "")]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "errors", "match_end"])
            release()

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, errors long, match_end long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = LEAST, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item stands, be it one without an id.

    Rows with a null or empty text stay, rows that repeat stay or go together, an empty table stays empty, and an empty benchmark drops nothing. Texts
    are searched whole, one at a time; the benchmark comes in blocks of block_letters, one pass over docs each.
    """
    for items in item_blocks(benchmark, block_letters, bare=True):
        held = docs.sparkSession.sparkContext.broadcast(items)  # one block

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Search(held.value, rate, least)
            for batch in batches:
                clean = [not search.matches(text.as_py() or "") for text in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
