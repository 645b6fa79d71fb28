"""Suffix-array deduplication of long repeated byte strings, across and within documents.

A byte goes if some `length`-byte string over it also starts earlier: in a document of smaller doc_id, or before it in the
same one. To find repeats without moving every suffix, only suffixes at *anchors* are sorted. An anchor is the place of the smallest
hash of a GRAM-byte string among those inside a window of `length` bytes; it depends on the window's bytes alone, so that equal windows
have their anchor at the same offset. Each anchor carries two hashes, of its string and of all bytes that a window over it
can have (its context).

1. Anchors of all texts are dealt by the hash of their string. Anchors whose string and context both occurred earlier are repeats as a whole.
   Copies inside one batch of texts are settled there, byte by byte, so that a passage that stands in very many documents hardly travels.
   Others are taken by their hashes at first and verified by the bytes they stand for: neighbouring anchors that repeat
   the same place make a run, and the SHA-256 of both places' bytes must agree. Those that don't go on to the sort, like anchors of several contexts.
2. Where a string has several contexts, one anchor of each goes on, with its context, to a hash-compared suffix sort: prefix polynomial hashes
   and binary search give the common extension of two suffixes in logarithmic time, a mergesort over these comparisons sorts
   the suffixes to the right of the anchors and the reversed ones to the left, and neighbours' extensions are verified byte by byte.
   At each offset, windows are equal if they fall into the same run of both orders; all but the earliest of them are repeats.
3. A string with more than `most` contexts isn't gathered. Each of its members is compared with the earliest one, which settles the windows
   they share; for the others, the members are dealt anew by their bytes up to the first one that differs, until the groups are
   small enough. That is exact, whatever the size of a group.

Documents are joined with what was found on doc_id and a hash of the text; texts are dealt once for all joins.

Defined results: a null text counts as empty. Texts under `length` bytes keep all. A null doc_id comes before all others (the least of all longs counts as null).
Different texts of the same doc_id, or without one, are documents of their own, ordered by that hash. Repeated
rows (same doc_id and text) count as one document, so don't remove each other, and each is returned. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

LENGTH = 100
GRAM = 32
#: Contexts that one group of the suffix sort has at most; more are split.
MOST = 32_768
#: Anchors of large groups (12 bytes each, and 16 a document) that are sent to all executors at most.
SENT = 1 << 20
#: Earliest members of large groups (some 300 bytes each) that are sent to all executors at most.
FEW = 1 << 15
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
FIRST_ID = -(1 << 63)


@functools.lru_cache(8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return tuple(out)


class PrefixHashes:
    """Hashes of any substring of a buffer from its prefix sums, modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int):
        size = max(1 << 16, 1 << len(data).bit_length())
        self.up, self.down = _powers(base, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        """The hash of the `size` bytes at each place."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts joined in `data`, each up to its entry of `ends`: place, text number, gram hash and context hash of each anchor."""
    none = np.zeros(0, np.int64)
    n = len(data)
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    if n < length:
        return none, none, none, none
    hashes = PrefixHashes(data, BASES[0])
    gram = hashes.grams(GRAM)
    bits = np.uint64(max(20, n.bit_length()))
    low = (_mixed(gram) >> bits << bits) | np.arange(len(gram), dtype=np.uint64)  # ties: the leftmost
    span, wide = length - GRAM + 1, 1
    while wide * 2 <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if span > wide:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    room = np.repeat(ends, ends - starts)[: len(low)] - np.arange(len(low))
    at = (low[room >= length] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    if not len(at):
        return none, none, none, none
    at = at[np.r_[True, at[1:] != at[:-1]]]
    text = np.searchsorted(ends, at, side="right")
    left = np.minimum(length - GRAM, at - starts[text])
    right = np.minimum(length, ends[text] - at)
    own = PrefixHashes(data, BASES[1]).of(at - left, at + right)
    context = _mixed(own ^ _mixed((left * 1000 + right).astype(np.uint64)))
    return at, text, gram[at].view(np.int64), context.view(np.int64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """The bytes of some ranges, none longer than `most`, a row each, zero past their ends."""
    step = np.arange(most)
    return np.where(step < size[:, None], data[np.minimum(start[:, None] + step, len(data) - 1)], 0)


def _anchors(length: int, bits: int = 64):
    """(h, c, id, key, pos, kind): kind 0 for an anchor to be dealt, 1 for one whose context occurred earlier in the same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            for a, b in _slices(texts, 1 << 20):
                data, ends = _joined(texts[a:b])
                at, text, h, c = anchors_of(data, ends, length)
                if not len(at):
                    continue
                if bits < 64:
                    c = c & np.int64((1 << bits) - 1)
                own, key, pos = ids[a:b][text], keys[a:b][text], at - np.r_[0, ends[:-1]][text]
                order = np.lexsort((pos, key, own, c, h))
                h, c, own, key, pos, at, text = (x[order] for x in (h, c, own, key, pos, at, text))
                again = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])]
                first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
                again &= (own != own[first]) | (key != key[first]) | (pos != pos[first])
                left = np.minimum(length - GRAM, pos)
                size = left + np.minimum(length, ends[text] - at)
                for some in np.array_split(np.flatnonzero(again), 1 + again.sum() // (1 << 13)):
                    x, y = (_pieces(data, (at - left)[i], size[i], 2 * length) for i in (some, first[some]))
                    wrong = some[(size[some] != size[first[some]]) | (left[some] != left[first[some]]) | (x != y).any(axis=1)] if len(some) else some
                    again[wrong] = False  # the hashes collide: another one of the context, for these alone
                    c[wrong] = _mixed(PrefixHashes(data, BASES[2]).of((at - left)[wrong], (at - left + size)[wrong])).view(np.int64) if len(wrong) else c[wrong]
                h, c = np.where(again, _mixed(own.astype(np.uint64)).view(np.int64), h), np.where(again, 0, c)  # settled ones go anywhere
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(own), pa.array(key), pa.array(pos.astype(np.int32)), pa.array(again.astype(np.int8))], ["h", "c", "id", "key", "pos", "kind"])

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by h, c, id, key, pos. Gives (id, key, pos, kind, h, id1, key1, pos1): kind 1 for repeats settled already (with their own place), 3 where the
    context's hash occurred earlier, with its first place, and 2 for the first of each of several contexts.

    Only the last context's first anchor is held from batch to batch, so that a group's size doesn't matter.
    """
    held, waits, several = None, False, False
    for batch in batches:
        h, c, own, key, pos, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        parts = []

        def give(some: np.ndarray, kind: int, h: np.ndarray, place: tuple, first: np.ndarray | None = None, parts=parts) -> None:
            to = [x[some] for x in place] if first is None else [x[first[some]] for x in place]
            parts.append([*(x[some] for x in place), np.full(some.sum(), kind, np.int8), h[some], *to])

        give(kind == 1, 1, h, (own, key, pos))
        h, c, own, key, pos = (x[kind != 1] for x in (h, c, own, key, pos))
        if len(h):
            if held is not None:
                h, c, own, key, pos = (np.r_[np.array([x], y.dtype), y] for x, y in zip(held, (h, c, own, key, pos), strict=True))
            new_group = np.r_[True, h[1:] != h[:-1]]
            new_class = new_group | np.r_[True, c[1:] != c[:-1]]
            group = np.cumsum(new_group) - 1
            many = np.bincount(group, weights=new_class) > 1
            if held is not None and several:
                many[0] = True
            first = np.maximum.accumulate(np.where(new_class, np.arange(len(h)), 0))
            again = ~new_class & ((own != own[first]) | (key != key[first]) | (pos != pos[first]))
            one = new_class & many[group]
            if held is not None and not waits:
                one[0] = False
            give(again, 3, h, (own, key, pos), first)
            give(one, 2, h, (own, key, pos))
            k = first[-1]
            held, several = (h[k], c[k], own[k], key[k], pos[k]), bool(many[-1])
            waits = not several
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["id", "key", "pos", "kind", "h", "id1", "key1", "pos1"])


def _contexts(length: int):
    """Cuts the contexts of the listed anchors out of each text: (h, id, key, pos, l, bytes); l is how many stand before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _CONTEXT]
            for own, key, text, list_h, list_pos in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for h, p in zip(list_h, list_pos, strict=True):
                    a = max(0, p - (length - GRAM))
                    for column, value in zip(out, (h, own, key, p, p - a, text[a : p + length]), strict=True):
                        column.append(value)
                if len(out[0]) > 1 << 15:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _CONTEXT_TYPES, strict=True)], _CONTEXT)
                    out = [[] for _ in _CONTEXT]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _CONTEXT_TYPES, strict=True)], _CONTEXT)

    return run


_CONTEXT, _CONTEXT_TYPES = ["h", "id", "key", "pos", "l", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_CONTEXT_SQL = "h long, id long, key long, pos int, l int, bytes binary"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, start, stop, sha) from (id, key, bytes, starts, stops)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for own, key, text, starts, stops in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            for a, b in zip(starts, stops, strict=True):
                for column, value in zip(out, (own, key, a, b, hashlib.sha256(text[a:b]).digest()), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "key", "start", "stop", "sha"])


_RUN = "id long, key long, start long, stop long, id1 long, key1 long, start1 long, stop1 long, asked boolean, ps array<int>, hs array<long>"


def _runs(length: int):
    """Anchors sorted by id, key, id1, key1, pos: neighbouring ones that repeat the same place, in runs. Those taken by their hashes
    (kind 3) are asked about, and carry their anchors along."""
    names = [x.split()[0] for x in _RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, key, pos, kind, h, own1, key1, pos1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            pos, pos1 = pos.astype(np.int64), pos1.astype(np.int64)
            same = (own[1:] == own[:-1]) & (key[1:] == key[:-1]) & (kind[1:] == kind[:-1]) & (own1[1:] == own1[:-1]) & (key1[1:] == key1[:-1])
            same &= ((pos - pos1)[1:] == (pos - pos1)[:-1]) | (kind[1:] == 1)
            first = np.flatnonzero(np.r_[True, ~(same & (pos[1:] - pos[:-1] <= length))])
            last = np.r_[first[1:], len(pos)] - 1
            asked = kind[first] == 3
            back = length - GRAM
            # anchors of runs that aren't asked about don't go on
            listed = np.repeat(asked, last - first + 1)
            offsets = pa.array(np.r_[0, np.cumsum(np.where(asked, last - first + 1, 0))].astype(np.int32))
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pos[listed].astype(np.int32), h[listed]))
            plain = (own[first], key[first], np.maximum(0, pos[first] - back), pos[last] + length, own1[first], key1[first], np.maximum(0, pos1[first] - back), pos1[last] + length, asked)
            yield pa.RecordBatch.from_arrays([*map(pa.array, plain), *lists], names)

    return run


def _as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def _judged(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that were asked about, with `ok`: whether the bytes of both places have one SHA-256. Wrong ones keep their anchors."""
    asked = runs.where("asked")
    distinct = asked.select("id", "key", "start", "stop").union(asked.select("id1", "key1", "start1", "stop1")).distinct()
    places = distinct.groupBy("id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    found = texts.join(places, ["id", "key"]).select("id", "key", "bytes", "starts", "stops").mapInArrow(_digests, "id long, key long, start long, stop long, sha binary").distinct()
    first = found.toDF("id1", "key1", "start1", "stop1", "sha1")
    both = asked.join(found, ["id", "key", "start", "stop"]).join(first, ["id1", "key1", "start1", "stop1"]).withColumn("ok", F.col("sha") == F.col("sha1"))
    kept = lambda c: F.when(~F.col("ok"), F.col(c)).alias(c)
    told = both.select("id", "key", "start", "stop", "ok", "id1", "key1", (F.col("start") - F.col("start1")).alias("delta"), kept("ps"), kept("hs"))
    # an exchange that nothing is pruned through, so that whoever reads this reads the same one
    return told.repartition("id", "key").mapInArrow(_as_they_are, told.schema)


class SuffixSorter:
    """Sorts suffixes of a buffer within groups, by hashes. side 1 reads from each base to the right, side -1 reversed to the left."""

    def __init__(self, data: np.ndarray, hashes: PrefixHashes, base: np.ndarray, room: np.ndarray, side: int):
        self.data, self.hashes, self.base, self.room, self.side = data, hashes, base, room, side

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        x, y = self.base[a], self.base[b]
        return self.hashes.of(x, x + n) == self.hashes.of(y, y + n) if self.side > 0 else self.hashes.of(x - n, x) == self.hashes.of(y - n, y)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common extension of suffixes a and b, by binary search over equal hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.room[a], self.room[b])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self._same(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _byte(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte after n of suffix i; -1 past its end."""
        at = self.base[i] + n if self.side > 0 else self.base[i] - 1 - n
        return np.where(n < self.room[i], self.data[np.clip(at, 0, len(self.data) - 1)].astype(np.int64), -1)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b; of equal ones the smaller number."""
        n = self.common(a, b)
        x, y = self._byte(a, n), self._byte(b, n)
        return (x < y) | ((x == y) & (a < b))

    def order(self, group: np.ndarray) -> np.ndarray:
        """Numbers of the suffixes, sorted within groups; `group` is ascending. A bottom-up mergesort of all groups at once."""
        n = len(group)
        first = np.searchsorted(group, group)  # where each one's group begins
        size = np.searchsorted(group, group, side="right") - first
        now, width = np.arange(n), 1
        place = np.arange(n) - first  # position within the group
        while (act := np.flatnonzero(size > width)).size:
            run = place[act] // width
            other = first[act] + (run ^ 1) * width  # start of the run to be merged with
            stop = np.minimum(other + width, first[act] + size[act])
            low, high = np.minimum(other, stop), stop.copy()
            mine = now[act]
            while (go := np.flatnonzero(low < high)).size:  # how many of the other run come before
                mid = (low[go] + high[go]) >> 1
                is_before = self.before(now[mid], mine[go])
                low[go] = np.where(is_before, mid + 1, low[go])
                high[go] = np.where(is_before, high[go], mid)
            rank = np.where(stop > other, low - other, 0)
            target = first[act] + (run & ~1) * width + place[act] % width + rank
            merged = now.copy()
            merged[target] = mine
            now, width = merged, width * 2
        return now

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
        """Whether the first n bytes of suffixes a and b are the same, byte by byte."""
        for s in range(0, len(a), 1 << 14):
            x, y, m = self.base[a[s : s + (1 << 14)]], self.base[b[s : s + (1 << 14)]], n[s : s + (1 << 14)]
            step = np.arange(int(m.max(initial=0)))
            inside = step < m[:, None]
            shift = step if self.side > 0 else -1 - step
            at = lambda z: self.data[np.clip(z[:, None] + shift, 0, len(self.data) - 1)]  # noqa: B023, E731
            if (inside & (at(x) != at(y))).any():
                return False
        return True


def repeated_windows(group: np.ndarray, own: np.ndarray, pos: np.ndarray, left: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, start, stop) of what anchors with several contexts repeat. Members of `group` (ascending) are ordered by id and pos."""
    data, ends = _joined(texts)
    left = left.astype(np.int64)
    base = np.r_[0, ends[:-1]] + left
    right = ends - base
    for number in BASES[2:] + BASES[:2]:
        hashes, runs = PrefixHashes(data, number), []
        for side, room in ((1, right), (-1, left)):
            sorter = SuffixSorter(data, hashes, base, room, side)
            order = sorter.order(group)
            a, b = order[:-1], order[1:]
            same = group[a] == group[b]
            n = np.zeros(len(a), np.int64)
            n[same] = sorter.common(a[same], b[same])
            if not sorter.verified(a, b, n):
                break
            runs.append((order, np.where(same, n, -1)))
        if len(runs) == 2:
            break
    else:
        raise RuntimeError("hashes of four bases collide")
    (right_order, right_common), (left_order, left_common) = runs
    low, high = np.full(len(group), length), np.full(len(group), -1)
    most = lambda order, common: np.maximum(np.r_[-1, common], np.r_[common, -1])[np.argsort(order)]
    able = most(right_order, right_common) + most(left_order, left_common) >= length  # others share no whole window
    for o in range(length - GRAM + 1):
        some = np.flatnonzero(able & (left >= o) & (right >= length - o))
        if len(some) < 2:
            continue
        key = np.zeros(len(group), np.int64)
        key[left_order] = np.cumsum(np.r_[0, left_common < o]) * (len(group) + 1)
        key[right_order] += np.cumsum(np.r_[0, right_common < length - o])
        _, first, back = np.unique(key[some], return_index=True, return_inverse=True)
        earliest = some[first[back]]
        again = some[(own[some] != own[earliest]) | (pos[some] != pos[earliest])]
        low[again] = np.minimum(low[again], o)
        high[again] = np.maximum(high[again], o)
    found = high >= 0
    return own[found], (pos - high)[found], (pos - low + length)[found]


def _sorted_groups(length: int, chunk: int = 1 << 15):
    """Contexts sorted by h, id, key, pos; whole groups are worked on, some `chunk` contexts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        names = ["id", "key", "start", "stop"]

        def settled(table: pa.Table) -> pa.RecordBatch:
            h, own, key, pos, left = (table.column(k).to_numpy() for k in _CONTEXT[:5])
            pairs, number = np.unique(np.stack([own, key], axis=1), axis=0, return_inverse=True)
            who, start, stop = repeated_windows(np.cumsum(np.r_[0, h[1:] != h[:-1]]), number.reshape(-1), pos.astype(np.int64), left, table.column("bytes").to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (pairs[who, 0], pairs[who, 1], start, stop)], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if len(rest) >= chunk:
                h = rest.column("h").to_numpy()
                k = int(np.searchsorted(h, h[-1]))
                at = 0
                while at < k:
                    end = min(k, at + chunk)
                    if end < k:
                        begin = int(np.searchsorted(h, h[end]))
                        end = begin if begin > at else int(np.searchsorted(h, h[end], side="right"))
                    yield settled(rest.slice(at, end - at))
                    at = end
                rest = rest.slice(k)
        if rest is not None and len(rest):
            yield settled(rest)

    return run


def _against_earliest(length: int):
    """Rows (h, id, key, pos, l, bytes, low, high, then the earliest member's id, key, pos, l, bytes). kind 1: what it repeats of the earliest,
    as (id, key, start, stop); kind 2: a row for a further round, under a new h."""
    names = ["kind", "start", "stop", *_CONTEXT, "low", "high"]
    types = [pa.int8(), pa.int64(), pa.int64(), *_CONTEXT_TYPES, pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for h, own, key, pos, left, text, low, high, own1, key1, pos1, left1, text1 in zip(*(batch.column(i).to_pylist() for i in range(13)), strict=True):
                if (own, key, pos) == (own1, key1, pos1):
                    continue
                a, b, a1, b1 = text[:left][::-1], text[left:], text1[:left1][::-1], text1[left1:]
                to_left = next((i for i, (x, y) in enumerate(zip(a, a1)) if x != y), min(len(a), len(a1)))  # noqa: B905
                to_right = next((i for i, (x, y) in enumerate(zip(b, b1)) if x != y), min(len(b), len(b1)))  # noqa: B905
                first, last = max(low, length - to_right), min(high, to_left)
                if first <= last:
                    out.append((1, pos - last, pos - first + length, None, own, key, None, None, None, None, None))
                part = lambda side, n: xxhash.xxh3_64_intdigest(h.to_bytes(8, "big", signed=True) + side + (a if side == b"L" else b)[:n]) - (1 << 63)  # noqa: B023, E731
                if (start := max(low, to_left + 1)) <= (stop := min(high, left)):
                    out.append((2, None, None, part(b"L", to_left + 1), own, key, pos, left, text, start, stop))
                if (start := max(low, length - len(b))) <= (stop := min(high, to_left, length - 1 - to_right)):
                    out.append((2, None, None, part(b"R", to_right + 1), own, key, pos, left, text, start, stop))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _small_groups(contexts: DataFrame, length: int) -> DataFrame:
    dealt = contexts.select(*_CONTEXT).repartition("h").sortWithinPartitions("h", "id", "key", "pos")
    return dealt.mapInArrow(_sorted_groups(length), "id long, key long, start long, stop long")


def _split_large(rows: DataFrame, length: int, most: int) -> DataFrame:
    """Ranges from groups of more than `most` contexts, by rounds against the earliest member.

    Each round settles what a member shares with the earliest and deals the rest by at least one byte more to either side, so that
    there are no more rounds than a context has bytes. What a round finds is written before the next one.
    """
    schema = f"kind byte, start long, stop long, {_CONTEXT_SQL}, low int, high int"
    found = []
    rows = rows.select(*_CONTEXT, F.lit(0).alias("low"), F.lit(length - GRAM).alias("high"))  # of large groups only
    for _ in range(2 * length):
        rows = checkpointed(rows)
        large = checkpointed(rows.groupBy("h").count().where(F.col("count") > most).select("h"))
        if not (n := large.count()):
            found.append(_small_groups(rows, length))
            return functools.reduce(DataFrame.union, found)
        # a large group's members meet its earliest one where they are
        few = F.broadcast if n <= FEW else lambda df: df
        found.append(checkpointed(_small_groups(rows.join(few(large), "h", "left_anti"), length)))
        now = rows.join(few(large), "h", "left_semi")
        member = F.struct("id", "key", "pos", "l", "bytes")
        earliest = now.groupBy("h").agg(F.min_by(member, F.struct("id", "key", "pos")).alias("e")).select("h", *(F.col(f"e.{c}").alias(f"{c}1") for c in _CONTEXT[1:]))
        split = checkpointed(now.join(few(earliest), "h").select(*_CONTEXT, "low", "high", *(f"{c}1" for c in _CONTEXT[1:])).mapInArrow(_against_earliest(length), schema))
        found.append(split.where("kind = 1").select("id", "key", "start", "stop"))
        rows = split.where("kind = 2").select(*_CONTEXT, "low", "high")
    raise RuntimeError("contexts can't be told apart")


def _cut(length: int):
    """(doc_id, n_bytes, spans, kept) from (id, doc_id, bytes, starts, stops)."""
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, starts, stops in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted(zip(starts or [], stops or [], strict=True)):
                    a, b = max(0, a), min(b, len(text))
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    elif a < b:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(text)]
                sizes.append(len(text))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def _context_rows(texts: DataFrame, wanted: DataFrame, sent: bool, length: int) -> DataFrame:
    """The contexts of the wanted anchors; if `sent`, these are few enough to be sent to the texts."""
    places = wanted.groupBy("id", "key").agg(F.collect_list("h").alias("hs"), F.collect_list("pos").alias("ps"))
    met = texts.join(F.broadcast(places) if sent else places, ["id", "key"])
    return met.select("id", "key", "bytes", "hs", "ps").mapInArrow(_contexts(length), _CONTEXT_SQL)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int | None = None, bits: int = 64) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans (removed runs of bytes: start, stop) and kept (the other bytes, joined).

    `most` is the number of contexts that one group of the sort may have; by default a 64th of all of them, but 4,096 or more and MOST at most.
    `bits` are those of a context's hash; fewer of them cost time and change no result.
    """
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("id")
    # where ids are those of one row each, they need no hash of the text beside them
    shared = docs.select(own).groupBy("id").count().where(F.col("count") > 1)
    key = F.lit(0).cast("long") if shared.isEmpty() else F.xxhash64(text_or_empty(text_col))
    texts = docs.select(own, key.alias("key"), text_or_empty(text_col).cast("binary").alias("bytes"))  # the same columns for all joins, so that one exchange serves them
    anchors = texts.mapInArrow(_anchors(length, bits), "h long, c long, id long, key long, pos int, kind byte")
    dealt = anchors.repartition("h").sortWithinPartitions("h", "c", "id", "key", "pos")
    marked = checkpointed(dealt.mapInArrow(_repeats, "id long, key long, pos int, kind byte, h long, id1 long, key1 long, pos1 int"))
    repeats = marked.where("kind <> 2").repartition("id", "key").sortWithinPartitions("id", "key", "kind", "id1", "key1", "pos")
    runs = checkpointed(repeats.mapInArrow(_runs(length), _RUN))
    judged = _judged(texts, runs)
    settled = runs.where("NOT asked").select("id", "key", "start", "stop").union(judged.where("ok").select("id", "key", "start", "stop"))
    wrong = judged.where("NOT ok").select("id", "key", "id1", "key1", "delta", F.inline(F.arrays_zip("ps", "hs")))
    more = wrong.select("id", "key", F.col("ps").alias("pos"), F.col("hs").alias("h")).union(wrong.select("id1", "key1", (F.col("ps") - F.col("delta")).cast("int"), "hs")).distinct()
    wanted = marked.where("kind = 2").select("id", "key", "pos", "h")
    most = most or min(MOST, max(4096, wanted.count() // 64))
    sizes = checkpointed(wanted.groupBy("h").count().where(F.col("count") > most))
    large, members = sizes.select("h"), sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    both = wanted.union(more)
    fine = both.join(large, "h", "left_anti").select("id", "key", "pos", "h") if members else both
    found = _small_groups(_context_rows(texts, fine, False, length), length)
    if members:
        contexts = _context_rows(texts, both.join(large, "h", "left_semi").select("id", "key", "pos", "h"), members <= SENT, length)
        found = found.union(_split_large(contexts, length, most))
    per = found.union(settled).groupBy("id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    doc_id = F.nullif(F.col("id"), F.lit(FIRST_ID)).alias("doc_id")
    return texts.join(per, ["id", "key"], "left").select(doc_id, "bytes", "starts", "stops").mapInArrow(_cut(length), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
