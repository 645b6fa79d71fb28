"""Exact deduplication by counting quotient filters.

Each partition counts the 64-bit fingerprints of its texts in counting quotient filters: the top bits of a fingerprint are
its quotient, which chooses a run of slots, and the slots of a run hold the sorted remainders, the other bits. A count of one
takes no room; larger ones stand beside their slot. A filter that has filled its slots is given out and a new one begun, so
that a partition's size doesn't matter. Filters travel in blocks of neighbouring quotients; blocks of the same quotients
merge without loss, since merging sorted remainders and adding counts gives the filter of both inputs. A group of
copies is one entry of each filter, so no group makes a block large. Only texts whose fingerprint has a count above
one are dealt and compared byte by byte; the others never travel while the repeated fingerprints are few enough to be
sent to all (`BROADCAST_PRINTS`); beyond that they meet the fingerprints in an exchange.

Defined results: a null text counts as empty, and empty texts are copies of each other. Of equal texts the row with the
largest doc_id stays (a null doc_id is smaller than any); of rows that share that doc_id as well, one stays: which
of them is no matter to `exact_dedup`, and `keep_one_of_copies` takes the one whose other columns, as JSON, come first. An empty
table gives no rows. Columns other than id and text are not read by `exact_dedup`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, text_or_empty

#: Bits of a fingerprint that are its quotient, and how many of them choose the block that a run travels in.
QUOTIENT_BITS = 20
BLOCK_BITS = 12
REMAINDER_BITS = 64 - QUOTIENT_BITS
REMAINDER_BYTES = -(-REMAINDER_BITS // 8)
#: Slots of one filter; a partition with more distinct fingerprints gives several filters.
SLOTS = 1 << 20
#: Over so many parts the copies of one text are dealt before they are compared.
SALTS = 16
#: So many repeated fingerprints (8 bytes each) are sent to all executors at most.
BROADCAST_PRINTS = 1 << 20
#: Equal rows are counted and written out again in pieces of so many.
PIECE = 1 << 16


class QuotientFilter:
    """Distinct fingerprints in order, with their counts: the slots, run by run."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        self.fingerprints, self.counts = fingerprints, counts

    def __len__(self) -> int:
        return len(self.fingerprints)

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> QuotientFilter:
        return cls(*np.unique(fingerprints.astype(np.uint64), return_counts=True))

    def merged(self, other: QuotientFilter) -> QuotientFilter:
        both = np.concatenate([self.fingerprints, other.fingerprints])
        counts = np.concatenate([self.counts, other.counts])
        order = np.argsort(both, kind="stable")  # two sorted runs: one merge
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, int)
        return QuotientFilter(both[first], np.add.reduceat(counts, first) if len(first) else counts)

    def blocks(self, bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(block, runs, remainders, counts) of each block that has slots: the length of each quotient's run, the remainders
        in as few bytes as hold them, and for the slots counted more than once their place and count."""
        if not len(self):
            return
        block = (self.fingerprints >> np.uint64(64 - bits)).astype(np.int64)
        run = ((self.fingerprints >> np.uint64(REMAINDER_BITS)) & np.uint64((1 << (QUOTIENT_BITS - bits)) - 1)).astype(np.int64)
        remainder = (self.fingerprints & np.uint64((1 << REMAINDER_BITS) - 1)).astype("<u8")
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(edges, np.r_[edges[1:], len(block)], strict=True):
            lengths = np.bincount(run[a:b], minlength=1 << (QUOTIENT_BITS - bits)).astype("<u4")
            short = remainder[a:b].view(np.uint8).reshape(-1, 8)[:, :REMAINDER_BYTES]
            many = np.flatnonzero(self.counts[a:b] > 1)
            yield int(block[a]), lengths.tobytes(), short.tobytes(), np.stack([many, self.counts[a:b][many]], axis=1).astype("<i8").tobytes()

    @classmethod
    def from_block(cls, block: int, bits: int, runs: bytes, remainders: bytes, counts: bytes) -> QuotientFilter:
        lengths = np.frombuffer(runs, "<u4")
        short = np.frombuffer(remainders, np.uint8).reshape(-1, REMAINDER_BYTES)
        wide = np.zeros((len(short), 8), np.uint8)
        wide[:, :REMAINDER_BYTES] = short
        quotient = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) | np.uint64(block << (QUOTIENT_BITS - bits))
        times = np.ones(len(short), np.int64)
        many = np.frombuffer(counts, "<i8").reshape(-1, 2)
        times[many[:, 0]] = many[:, 1]
        return cls(quotient << np.uint64(REMAINDER_BITS) | wide.view("<u8")[:, 0], times)


class Merging:
    """Filters waiting to be merged in pairs of like size, so that each slot is merged a logarithm of times."""

    def __init__(self):
        self.parts: list[QuotientFilter] = []

    def add(self, part: QuotientFilter) -> None:
        self.parts.append(part)
        while len(self.parts) > 1 and len(self.parts[-2]) <= 2 * len(self.parts[-1]):
            self.parts.append(self.parts.pop().merged(self.parts.pop()))

    def settled(self) -> QuotientFilter:
        while len(self.parts) > 1:
            self.parts.append(self.parts.pop().merged(self.parts.pop()))
        return self.parts.pop() if self.parts else QuotientFilter.of(np.zeros(0, np.uint64))


_BLOCK, _BLOCK_TYPES = ["block", "runs", "remainders", "counts"], (pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _filters(bits: int, slots: int):
    def given(whole: QuotientFilter) -> Iterator[pa.RecordBatch]:
        if rows := list(whole.blocks(bits)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _BLOCK_TYPES, strict=True)], _BLOCK)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = Merging()
        for batch in batches:
            waiting.add(QuotientFilter.of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if sum(map(len, waiting.parts)) >= slots:
                yield from given(waiting.settled())
        yield from given(waiting.settled())

    return build


def _repeated(bits: int):
    """Merges the filters of each block, which arrive one after the other, and gives the fingerprints with a count above one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(whole: QuotientFilter) -> pa.RecordBatch:
            many = whole.counts > 1
            return pa.RecordBatch.from_arrays([pa.array(whole.fingerprints[many].view(np.int64)), pa.array(whole.counts[many])], ["fingerprint", "n"])

        at, waiting = None, Merging()
        for batch in batches:
            for block, *rest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != at and waiting.parts:
                    yield out(waiting.settled())
                at = block
                waiting.add(QuotientFilter.from_block(block, bits, *rest))
        if waiting.parts:
            yield out(waiting.settled())

    return merge


def repeated_fingerprints(prints: DataFrame, block_bits: int = BLOCK_BITS, slots: int = SLOTS) -> DataFrame:
    """(fingerprint, n) of the values of the one long column of `prints` that occur more than once."""
    filters = prints.mapInArrow(_filters(block_bits, slots), "block long, runs binary, remainders binary, counts binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(_repeated(block_bits), "fingerprint long, n long")


def _salt(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def copy_classes(docs: DataFrame, id_col: str, text_col: str, block_bits: int, fingerprint: str, broadcast_prints: int) -> DataFrame:
    """(sha, keep_id, group_size) of the texts that occur more than once, told apart byte by byte."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", "text", F.expr(fingerprint.format("text")).alias("fp"))
    dup = checkpointed(repeated_fingerprints(rows.select("fp"), block_bits).select(F.col("fingerprint").alias("fp")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    if dup.count() <= broadcast_prints:
        some = rows.join(F.broadcast(dup), "fp", "left_semi")
    else:
        some = rows.select("*", salt).join(dup.select("fp", _salt(SALTS).alias("salt")), ["fp", "salt"], "left_semi")
    # copies within a part collapse before they travel
    same = some.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return checkpointed(same.where("group_size > 1").select(F.sha2("text", 256).alias("sha"), "keep_id", "group_size"))


def _joined(rows: DataFrame, classes: DataFrame, salted_by: Column, broadcast_prints: int) -> DataFrame:
    """`rows` (with a column sha) and their class, if they have one; a class with very many rows is met in parts."""
    if classes.count() <= broadcast_prints // 8:
        return rows.join(F.broadcast(classes), "sha", "left")
    salt = free_name(rows, "salt")
    return rows.withColumn(salt, F.pmod(F.xxhash64(salted_by), F.lit(SALTS)).cast("int")).join(classes.select("*", _salt(SALTS).alias(salt)), ["sha", salt], "left").drop(salt)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int = BLOCK_BITS, fingerprint: str = "xxhash64({})", broadcast_prints: int = BROADCAST_PRINTS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `fingerprint` is the SQL of a 64-bit hash of the text; a worse one costs time and changes no result.
    """
    classes = copy_classes(docs, id_col, text_col, block_bits, fingerprint, broadcast_prints)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("sha"))
    marked = _joined(rows, classes, F.col("doc_id"), broadcast_prints)
    alone, own = F.col("group_size").isNull(), F.col("doc_id").eqNullSafe(F.col("keep_id"))
    others = marked.where(alone | ~own).select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), alone.alias("kept"), "sha")
    # rows of the id that stays: they differ in nothing, so they are counted, and written out again with one of them kept
    counted = marked.where(~alone & own).groupBy("doc_id", "sha", "keep_id", "group_size").agg(F.count("*").alias("n"))
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) DIV {PIECE}"))).alias("piece"))
    of_piece = F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("n"), (F.col("piece") + 1) * PIECE) - 1))
    stays = pieces.select("doc_id", "keep_id", "group_size", of_piece.alias("nth"), "sha").select("doc_id", "keep_id", "group_size", (F.col("nth") == 0).alias("kept"), "sha")
    return others.union(stays).withColumnRenamed("sha", "text_sha256")


def keep_one_of_copies(docs: DataFrame, broadcast_prints: int = BROADCAST_PRINTS) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns."""
    classes = copy_classes(docs, "doc_id", "text", BLOCK_BITS, "xxhash64({})", broadcast_prints)
    inner = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.sha2(text_or_empty(), 256).alias("sha"))
    marked = _joined(inner, classes, F.col("id"), broadcast_prints)
    single = marked.where(F.col("group_size").isNull()).select("row")
    copies = marked.where(F.col("group_size").isNotNull() & F.col("id").cast("long").eqNullSafe(F.col("keep_id")))
    one = copies.groupBy("sha").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row")).select("row")
    return single.union(one).select("row.*")
