"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row in the pivot table holds its Hamming distances to many reference fingerprints: the zero one, and for
each of six blocks of bits one reference per bit and several patterned ones, all zero outside their block. A block's
*profile* is the distances to its references less the distance to zero, which depends on the block alone. If two
fingerprints differ in two bits at most, four blocks at least are untouched, and their profiles are the same. So
fingerprints are dealt by the profiles of each four of the six blocks (15 keys a fingerprint). Two that meet are
discarded if some coordinate of their table rows differs by more than two (by the triangle inequality they are then
further apart), and survivors are verified by their Hamming distance.

Only distinct fingerprints are dealt. Those of one key differ in 22 bits at most, so that a key never has more than 2^22
of them, which bounds what one task holds. Within a key, connected fingerprints are joined at once and leave
one link each to the smallest of them; no list of pairs is made.

`keep_one_of_near_copies` also links those in a larger radius whose texts have a Jaccard similarity of shingles. Such texts meet by their
rarest shingles, of which two so similar share one, not by keys of their fingerprints. By its definition, what lies beyond the radius is no link.

Links and components are of fingerprints, not of ids, so that a fingerprint which only rows without an id have links
its neighbours like any other.

Defined results: null and empty texts, and texts without a word, have the fingerprint zero, linked like any other.
Repeated rows have equal fingerprints, so are linked. A null doc_id has its fingerprint and a component like any
other; it is not a component's name unless all its members are null. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, hex64, join_by_size, text_or_empty

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Blocks of bits that a key is made of; there are as many more as bits may differ, so that some such choice is untouched.
KEPT = 4
#: The corpus stage: words of a shingle, the least Jaccard similarity, and the radius in which it looks for near copies.
NEAR_WORDS, SIMILARITY, NEAR_BITS = 5, 0.8, 6
WORD = re.compile(rb"[^ \t-\r]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Ids of texts to be compared that are sent to all executors at most (8 bytes each).
SENT_IDS = 1 << 20
#: Parts that the members of the largest groups are dealt to.
PARTS = 200
#: A key's fingerprints are compared all with all up to so many; more are split by further blocks, which loses none.
ALL_PAIRS = 1024
#: Texts of one shingle that are held against each other at once, without a leader.
FEW = 32
#: About so many texts give the order of shingles by frequency; one is frequent if so many of them have it.
ORDER_TEXTS, FREQUENT = 1 << 14, 8


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned SimHash of a text."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = np.r_[0, ends[:-1]][: len(found) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[a : a + (1 << 16)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def blocks_of(max_bits: int) -> list[tuple[int, int]]:
    """The 64 bits in max_bits + KEPT blocks of like size; with max_bits changed, KEPT of them stay as they are."""
    n = max_bits + KEPT
    cuts = np.r_[0, np.cumsum([64 // n + (i < 64 % n) for i in range(n)])].tolist()
    return list(itertools.pairwise(cuts))


class PivotTable:
    """Distances of fingerprints to the references, and the keys that follow from them."""

    def __init__(self, max_bits: int = MAX_BITS, patterned: int = 4, seed: int = 7):
        self.max_bits, self.blocks = max_bits, blocks_of(max_bits)
        draw = np.random.default_rng(seed)
        own = []
        for a, b in self.blocks:
            units = [np.uint64(1 << i) for i in range(a, b)]
            mixed = [np.uint64(int(x) << a) for x in draw.integers(1, 1 << (b - a), patterned)]
            own.append(np.array(units + mixed, np.uint64))
        self.references, self.sizes = np.concatenate(own), [len(x) for x in own]

    def distances(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(to zero, to each reference)."""
        zero = np.bitwise_count(fps).astype(np.int16)
        return zero, np.bitwise_count(fps[:, None] ^ self.references[None, :]).astype(np.int16)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """For each fingerprint and each KEPT of the blocks a 64-bit key of the blocks' profiles and of which blocks they are."""
        zero, table = self.distances(fps)
        profile = (table - zero[:, None]).astype(np.int64).view(np.uint64)
        weight = np.random.default_rng(11).integers(1, 1 << 62, len(self.references)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        cut = np.r_[0, np.cumsum(self.sizes)]
        blocks = np.stack([(profile[:, a:b] * weight[a:b]).sum(axis=1, dtype=np.uint64) for a, b in itertools.pairwise(cut)], axis=1)
        out = []
        for n, four in enumerate(itertools.combinations(range(len(self.blocks)), KEPT)):
            mixed = blocks[:, list(four)].sum(axis=1, dtype=np.uint64) + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            mixed ^= mixed >> np.uint64(31)
            out.append(mixed * np.uint64(0xBF58476D1CE4E5B9))
        return np.stack(out, axis=1).view(np.int64)

    def linked(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of positions at most max_bits apart, of a few fingerprints."""
        _, table = self.distances(fps)
        i, j = np.triu_indices(len(fps), 1)
        for c in range(0, table.shape[1], 8):  # the largest coordinate difference, a few references at a time
            near = np.abs(table[i, c : c + 8] - table[j, c : c + 8]).max(axis=1) <= self.max_bits
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= self.max_bits
        return i[near], j[near]

    def led(self, fps: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions at most max_bits apart: of the fingerprints, in the order of their bits turned by `turn`, the first that is no
        member yet leads all later ones in its radius, and so on; each member is paired with its leader and with the member before it."""
        _, table = self.distances(fps)
        left = np.argsort(fps << np.uint64(turn % 64) | fps >> np.uint64(-turn % 64), kind="stable")
        near = lambda i, j: (np.abs(table[i] - table[j]).max(axis=1) <= self.max_bits) & (np.bitwise_count(fps[i] ^ fps[j]) <= self.max_bits)
        u, v = [], []
        while len(left) > 1:
            first, rest = left[:1], left[1:]
            own = np.concatenate([near(rest[a : a + 4096], first) for a in range(0, len(rest), 4096)])
            members = rest[own]
            a, b = members[1:], members[:-1]
            some = near(a, b) if len(a) else np.zeros(0, bool)
            u += [members, a[some]]
            v += [np.repeat(first, len(members)), b[some]]
            left = rest[~own]
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))


@functools.lru_cache(4)
def pivots(max_bits: int) -> PivotTable:
    return PivotTable(max_bits)


PIVOTS = pivots(MAX_BITS)


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions the smallest one that the pairs connect it to."""
    low = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = low[i], low[j]
            if (a == b).all():
                break
            least = np.minimum(a, b)
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
            while (step := low[low] != low).any():
                low[step] = low[low[step]]
    return low


def _all_links(fps: np.ndarray, at: np.ndarray, first_block: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among fps[at]. Many are split by the bits of three stripes, one of which two linked ones share, until few differ."""
    if len(at) <= ALL_PAIRS or first_block > 9:
        for a in range(0, len(at), ALL_PAIRS):
            for b in range(a, len(at), ALL_PAIRS):
                both = np.r_[at[a : a + ALL_PAIRS], at[b : b + ALL_PAIRS] if b > a else at[:0]]
                i, j = PIVOTS.linked(fps[both])
                yield both[i], both[j]
        return
    some = fps[at]
    free = int(np.bitwise_or.reduce(some ^ some[0]))
    bits = [k for k in range(64) if free >> k & 1]
    if len(bits) < 6:
        yield from _all_links(fps, at, 99)
        return
    for stripe in range(3):
        mask = np.uint64(sum(1 << k for k in bits[stripe::3]))
        value = some & mask
        order = np.argsort(value, kind="stable")
        edges = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
        for a, b in zip(edges, np.r_[edges[1:], len(order)], strict=True):
            if b - a > 1:
                yield from _all_links(fps, at[order[a:b]], first_block + 1)


def _dealt(max_bits: int = MAX_BITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pivots(max_bits)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            step = max(256, (1 << 17) // math.comb(len(table.blocks), KEPT))  # so many keys at a time, whatever the radius
            for a in range(0, len(fps), step):
                part = fps[a : a + step]
                keys = table.keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]))], ["key", "fp"])
        pa.default_memory_pool().release_unused()  # the worker serves other stages after this one

    return run


def _groups(batches: Iterator[pa.RecordBatch], pairs_of) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; pairs (u, v) that `pairs_of` finds among the sorted fingerprints of each key."""
    rest = [np.zeros(0, np.int64)] * 2

    def joined(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        ends = np.r_[edges[1:], len(key)] if len(key) else edges
        u, v = [], []
        for a, b in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist(), strict=True):
            fps = np.sort(fp[a:b])
            i, j = pairs_of(fps.view(np.uint64), int(key[a]))
            u.append(fps[i])
            v.append(fps[j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (u, v)], ["u", "v"])

    for batch in batches:
        rest = [np.r_[old, batch.column(i).to_numpy(zero_copy_only=False)] for i, old in enumerate(rest)]
        cut = np.flatnonzero(rest[0][1:] != rest[0][:-1])
        if len(cut):
            k = cut[-1] + 1
            yield joined(*(x[:k] for x in rest))
            rest = [x[k:] for x in rest]
    yield joined(*rest)
    pa.default_memory_pool().release_unused()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link (u, v) for each fingerprint that isn't the smallest of those its key connects it to."""

    def pairs_of(fps: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        low = _roots(len(fps), _all_links(fps, np.arange(len(fps))))
        moved = np.flatnonzero(low != np.arange(len(fps)))
        return moved, low[moved]

    yield from _groups(batches, pairs_of)


def _nodes(prints: DataFrame) -> DataFrame:
    """(fp, id, n): each fingerprint with its smallest doc_id and its rows."""
    return prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))


def simhash_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of fingerprints that connect all that are at most MAX_BITS apart."""
    dealt = nodes.select("fp").mapInArrow(_dealt(), "key long, fp long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long")


def _with_components(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`prints` with component_id, the smallest doc_id reachable by links."""
    members = checkpointed(connected_components(links).join(nodes, F.col("node") == F.col("fp")).select("component", "fp", "id"))
    least = members.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    linked = join_by_size(members.select("fp", "component"), least, "component", members.count())
    named = checkpointed(nodes.join(linked.select("fp", "component_id", F.lit(True).alias("is_linked")), "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "n"))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_by_size(prints, named, "fp", total)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    prints = checkpointed(simhash_fingerprints(docs, id_col, text_col))
    nodes = _nodes(prints)
    return _with_components(prints, nodes, simhash_links(nodes)).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, one without any has none."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(found[k : k + words]), SEED) for k in range(max(1, len(found) - words + 1))], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are the same."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def first_shingles(own: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's hashes in an order that all sets share, `frequent` (sorted) ones last: so many that two sets with a Jaccard
    similarity of `least` have one of them in common. (They share a `least`-th of each, so that not all that they share comes later.)"""
    if len(frequent):
        own = own[np.argsort(frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own, kind="stable")]
    return own[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]


def _with_shingles(words: int, frequent: np.ndarray, least: float):
    """(doc_id, fp, tid, first): of (doc_id, tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(2).to_pylist()
                fps = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
                first = [first_shingles(shingle_set(x, words), frequent, least).view(np.int64) for x in texts]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in first])], pa.int32()), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), part.column(1), lists], ["doc_id", "fp", "tid", "first"])
        pa.default_memory_pool().release_unused()

    return run


def _sets(words: int):
    """(tid, hashes) of (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingle_set(text, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([tid], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))], ["tid", "hashes"])

    return run


def _by_text(docs: DataFrame, *cols) -> DataFrame:
    """The columns given, tid (a hash of the text) and text."""
    return docs.select(*cols, F.xxhash64(text_or_empty()).alias("tid"), text_or_empty().alias("text"))


def frequent_shingles(docs: DataFrame, rows: int, words: int = NEAR_WORDS) -> np.ndarray:
    """Hashes of shingles in FREQUENT or more of about ORDER_TEXTS texts. They only set the order that shingles are taken in, of which
    no link depends: common passages don't bring all their texts together."""
    some = _by_text(docs).where(F.pmod("tid", F.lit(max(1, rows // ORDER_TEXTS))) == 0)
    counts = some.mapInArrow(_sets(words), "tid long, hashes array<long>").select(F.explode("hashes").alias("hash")).groupBy("hash").count()
    found = counts.where(F.col("count") >= FREQUENT).select("hash").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def shingled_prints(docs: DataFrame, words: int = NEAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp, tid, first): the fingerprint of each text, a hash of the text, and its first shingles."""
    frequent = frequent_shingles(docs, docs.count(), words)
    return _by_text(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_with_shingles(words, frequent, least), "doc_id long, fp long, tid long, first array<long>")


def _of_one_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of the rows of each key that has several, of rows sorted by their first column, the key."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = own if rest is None else [np.r_[x, y] for x, y in zip(rest, own, strict=True)]
        if rest is None:
            return
        cut = np.flatnonzero(rest[0][1:] != rest[0][:-1]) + 1
        done = len(rest[0]) if batch is None else int(cut[-1]) if len(cut) else 0
        if not done:
            continue
        edges = np.r_[0, cut]
        edges = edges[edges < done]
        ends = np.r_[edges[1:], done]
        for a, b in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist(), strict=True):
            yield [c[a:b] for c in rest]
        rest = [c[done:] for c in rest]


def _apart(bits: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all that more than MAX_BITS and at most `max_bits` part."""
    for a in range(0, len(bits), ALL_PAIRS):
        for b in range(a, len(bits), ALL_PAIRS):
            apart = np.bitwise_count(bits[a : a + ALL_PAIRS, None] ^ bits[None, b : b + ALL_PAIRS])
            i, j = np.nonzero((apart > MAX_BITS) & (apart <= max_bits))
            some = i + a < j + b
            yield i[some] + a, j[some] + b


FOUND = "key long, u long, x long, v long, y long"


def _found(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND, from (key, u, x, v, y); v and y may be None."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = [pa.concat_arrays([pa.nulls(len(p[1]), pa.int64()) if p[k] is None else pa.array(p[k]) for p in held]) for k in range(1, 5)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([p[0] for p in held], [len(p[1]) for p in held])), *cols], ["key", "u", "x", "v", "y"])

    n = 0
    for p in parts:
        if len(p[1]):
            held.append(p)
            n += len(p[1])
        if n >= 1 << 16:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()
    pa.default_memory_pool().release_unused()


def _stars(max_bits: int):
    """Of (key, fp, tid): all pairs in the radius of keys of few rows; of others each row with the one that leads its radius and the
    member before it, and, without v and y, each row that has further pairs."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for keys, fps, tids in _of_one_key(batches):
            key, bits = int(keys[0]), fps.view(np.uint64)
            if len(fps) <= FEW:
                for i, j in _apart(bits, max_bits):
                    yield key, fps[j], tids[j], fps[i], tids[i]
                continue
            i, j = pivots(max_bits).led(bits, key)
            some = np.bitwise_count(bits[i] ^ bits[j]) > MAX_BITS
            i, j = i[some], j[some]
            yield key, fps[i], tids[i], fps[j], tids[j]
            more = np.ones(len(fps), bool)
            if len(fps) <= ALL_PAIRS:  # of more all are handed on
                pairs = -(np.bincount(i, minlength=len(fps)) + np.bincount(j, minlength=len(fps)))
                for a, b in _apart(bits, max_bits):
                    pairs += np.bincount(a, minlength=len(fps)) + np.bincount(b, minlength=len(fps))
                more = pairs > 0
            yield key, fps[more], tids[more], None, None

    return lambda batches: _found(parts(batches))


def _across(max_bits: int):
    """Of (key, fp, tid, component): all pairs in the radius that are of different components."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for keys, fps, tids, own in _of_one_key(batches):
            if (own != own[0]).any():
                for i, j in _apart(fps.view(np.uint64), max_bits):
                    some = own[i] != own[j]
                    i, j = i[some], j[some]
                    yield int(keys[0]), fps[j], tids[j], fps[i], tids[i]

    return lambda batches: _found(parts(batches))


def _alike(docs: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those (u, v) of `pairs` (u, x, v, y) whose texts x and y have a Jaccard similarity of `least` or more."""
    wanted = checkpointed(pairs.select(F.col("x").alias("tid")).union(pairs.select("y")).distinct())
    some = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
    texts = _by_text(docs).join(some, "tid", "left_semi")
    sets = checkpointed(texts.mapInArrow(_sets(words), "tid long, hashes array<long>").groupBy("tid").agg(F.min("hashes").alias("hashes")))
    # the leaders of very many are written out as often as their members are dealt to parts
    bound = pairs.count() // PARTS + 1
    parts = F.broadcast(pairs.groupBy("y").count().where(F.col("count") > bound).select("y", F.ceil(F.col("count") / bound).cast("int").alias("parts")))  # PARTS rows at most
    part = F.coalesce(F.pmod(F.xxhash64("x"), F.col("parts")), F.lit(0)).cast("int")
    members = pairs.join(sets.select(F.col("tid").alias("x"), F.col("hashes").alias("a")), "x").join(parts, "y", "left").select("u", "v", "y", "a", part.alias("part"))
    leaders = sets.select(F.col("tid").alias("y"), F.col("hashes").alias("b")).join(pairs.select("y").distinct(), "y", "left_semi").join(parts, "y", "left")
    leaders = leaders.select("y", "b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = members.join(leaders, ["y", "part"]).withColumn("shared", F.size(F.array_intersect("a", "b")))
    alike = F.try_divide(F.col("shared"), F.size("a") + F.size("b") - F.col("shared"))
    return both.where(alike >= least).select("u", "v").distinct()


def near_links(docs: DataFrame, prints: DataFrame, links: DataFrame, max_bits: int = NEAR_BITS, words: int = NEAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """Links (u, v) that, with `links` of MAX_BITS, connect all fingerprints at most `max_bits` apart of which two texts have a Jaccard
    similarity of `least` or more.

    Texts meet by each of their first shingles. First each is held against one that leads its radius and the member before it. What
    that leaves open is compared all with all, but for pairs that the links found so far connect, which add nothing: so no link
    is lost, and a group of very many near copies makes pairs in proportion to its members. Pairs are verified by their sets of shingles.
    """
    dealt = prints.groupBy("fp", "tid").agg(F.first("first").alias("first")).select(F.explode("first").alias("key"), "fp", "tid")
    found = checkpointed(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_stars(max_bits), FOUND))
    met = checkpointed(_alike(docs, checkpointed(found.where("v IS NOT NULL").select("u", "x", "v", "y").distinct()), words, least))
    rest = found.where("v IS NULL").select("key", F.col("u").alias("node"), F.col("x").alias("tid"))
    if rest.isEmpty():
        return met
    known = connected_components(links.union(met))
    rest = rest.join(known, "node", "left").select("key", F.col("node").alias("fp"), "tid", F.coalesce("component", "node").alias("component"))
    pairs = checkpointed(rest.repartition("key").sortWithinPartitions("key").mapInArrow(_across(max_bits), FOUND).select("u", "x", "v", "y").distinct())
    return met.union(_alike(docs, pairs, words, least))


def keep_one_of_near_copies(docs: DataFrame, max_bits: int = NEAR_BITS, words: int = NEAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """The row of the smallest doc_id of each group of near copies, with all its columns; rows without doc_id stay.

    Groups are connected by simhash_links, and by near_links in a larger radius.
    """
    prints = checkpointed(shingled_prints(docs, words, least))
    nodes = checkpointed(_nodes(prints))
    close = checkpointed(simhash_links(nodes))
    links = checkpointed(close.union(near_links(docs, prints, close, max_bits, words, least)))
    gone = _with_components(prints.select("doc_id", "fp"), nodes, links).where("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def keep_one_of_component(docs: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns; rows without doc_id stay."""
    gone = simhash_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
