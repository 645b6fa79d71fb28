"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space collapsed. An item of m characters may be met with up to k = m *
`budget` errors (insertions, deletions, substitutions). It is split into k + 1 pieces: k errors can't touch all of
them, so that a text that holds the item within its budget holds some piece exactly. One automaton finds all pieces of all
items in a pass over the text; around each hit the whole item is verified by Myers' bit-parallel edit distance.

The items are broadcast to the executors in blocks of a fixed size, a pass over the texts for each block, so what is sent doesn't grow.

Defined results: null and empty texts match nothing, and null and empty items are met nowhere. Items of both under `min_words` words and
under `min_bytes` bytes of UTF-8 are left out: they would be met everywhere, which matters where documents go for them. With both at 0, as the
query has them, all items are searched, the short ones exactly. The bytes keep long items of few words, and those in
scripts that set no space between words. Equal items match each. Repeated rows give a row each; an empty table gives no rows.
Other columns are not read by `find_leaks`; `drop_leaks` keeps all columns as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, schema_with

BUDGET = 0.05
MIN_WORDS = 5
MIN_BYTES = 25
#: Characters of items that are sent at once.
BLOCK_CHARS = 8 << 20


def normal_text(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece): errors + 1 consecutive pieces of like length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_end(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the best match of a pattern anywhere in the text: Myers' algorithm on whole columns of bits.

    `up` and `down` have a bit for each row whose vertical difference is +1 or -1; a match may start anywhere for nothing.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    best = (m, 0)
    for end, c in enumerate(text, 1):
        equal = pattern_bits.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if right_up & top:
            now += 1
        elif right_down & top:
            now -= 1
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        below = equal | down
        up = right_down | ~(below | right_up) & full
        down = right_up & below
        if now < best[0]:
            best = (now, end)
    return best


class ItemMatcher:
    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET):
        self.items = [(i, t, int(len(t) * budget)) for i, t in items]
        self.bits: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for start, piece in pieces_of(text, errors):
                found.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def _pattern(self, n: int) -> dict[str, int]:
        if n not in self.bits:
            at: dict[str, int] = {}
            for i, c in enumerate(self.items[n][1]):
                at[c] = at.get(c, 0) | 1 << i
            self.bits[n] = at
        return self.bits[n]

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, places): for each item within its budget its least distance, and the number of separate places."""
        if not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            start = end + 1 - length
            for n, offset in places:
                starts.setdefault(n, set()).add(start - offset)
        out = []
        for n, own in starts.items():
            i, item, errors = self.items[n]
            spans: list[list[int]] = []
            for s in sorted(own):  # an item that repeats a phrase is hit out of order, so none is merged before all are known
                if spans and s <= spans[-1][0] + 2 * errors:  # hits of the same place lie within the budget of each other
                    spans[-1][1] = s
                else:
                    spans.append([s, s])
            least, count, last = errors + 1, 0, -len(item)
            for first, final in spans:
                a = max(0, first - errors)
                distance, end = best_end(self._pattern(n), len(item), text[a : final + len(item) + errors])
                if distance <= errors:
                    least = min(least, distance)
                    if a + end - last >= len(item) - 2 * errors:  # not the place that the span before has met
                        count, last = count + 1, a + end
            if count:
                out.append((i, least, count))
        return sorted(out)


@functools.lru_cache(4)
def matcher_of(items: tuple[tuple[int, str], ...], budget: float) -> ItemMatcher:
    return ItemMatcher(list(items), budget)


def is_searched(item: str, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> bool:
    return bool(item) and (len(item.split()) >= min_words or len(item.encode("utf-8", "surrogatepass")) >= min_bytes)


def item_blocks(benchmark: DataFrame, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS, min_bytes: int = MIN_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """Normal items in blocks; one block at a time comes to the driver."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-int(total) // block_chars) or 1
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        kept = ((r[0], normal_text(r[1])) for r in own.collect())
        yield tuple(sorted((i, t) for i, t in kept if is_searched(t, min_words, min_bytes)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, places) of each item that a text holds within its error budget."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def search(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(items.value, budget)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [(d, *m) for d, t in zip(ids, texts, strict=True) for m in matcher.matches(normal_text(t))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "item_id", "distance", "places"])

        return run

    send = docs.sparkSession.sparkContext.broadcast
    parts = [rows.mapInArrow(search(send(items)), "doc_id long, item_id long, distance long, places long") for items in item_blocks(benchmark, min_words, block_chars, min_bytes)]
    return functools.reduce(DataFrame.union, parts)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns; texts don't travel."""
    out = docs
    for items in item_blocks(benchmark, min_words, block_chars, min_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=docs.sparkSession.sparkContext.broadcast(items)) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(items.value, budget)
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                kept = pa.array([not matcher.matches(normal_text(t)) for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)], batch.schema.names[:-1]).filter(kept)

        out = out.withColumn(free_name(out, "read"), F.col("text")).mapInArrow(run, schema_with(docs))
    return out
