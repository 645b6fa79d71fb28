"""Byte-level BPE: exact ids by dynamic programming over prefixes, and decoding.

A text is cut into words by the tokenizer's pattern. For each prefix of a word there is exactly one token that ends its
encoding. An automaton over the vocabulary gives the tokens that are suffixes of the prefix; of these the one
is stored that is compatible with the last token of what stands before it. Following the stored tokens back from the
whole word gives its ids, the same as applying all merges by rank.

Two neighbouring tokens are compatible if no merge crosses the boundary between them while both are being built. On the
left of the boundary stands, at each rank, one of the tokens of the left one's right spine (the token, the right part
it was merged from, and so on), on its right one of the right one's left spine. A merge of such two happens if its rank
comes before the ranks at which either goes into its own parent; at equal ranks the leftmost merge comes first.

Defined results: a null text counts as empty and has no ids. Strings of special tokens in a text become their ids, as
the tokenizers library does. Repeated rows are encoded each; an empty table gives no rows. Other columns stay as they
are in `bpe_encode` and `bpe_decode`; a column with the name of the output is replaced.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, text_slices

#: Unicode's White_Space, stated so that the libraries' ideas of \s don't matter.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words whose ids a worker remembers at most.
REMEMBERED = 120_000
#: Steps of the automaton and tests of pairs that a worker remembers at most.
STEPS, PAIRS = 400_000, 300_000
#: Characters of text that are encoded together.
SLICE = 2 << 20
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each token, by id."""
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    out = [b""] * (1 + max([*vocab.values(), *special]))
    for token, i in vocab.items():
        if i not in special:
            out[i] = bytes(letters[c] for c in token)
    for i, token in special.items():
        out[i] = token.encode()
    return out


def decode(table: list[bytes], ids: list[int]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


class BpeCoder:
    def __init__(self, file: bytes):
        spec = json.loads(file)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = token_bytes(spec)
        self.special = special
        self.split_special = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.words = regex.compile(WORDS)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if (whole := vocab.get(left + right)) is not None:
                a, b = vocab[left], vocab[right]
                self.rank[a, b] = r
                self.parts.setdefault(whole, (a, b, r))
        self.right_spine = functools.cache(lambda t: self._spine(t, 1))
        self.left_spine = functools.cache(lambda t: self._spine(t, 0))
        real = [i for i in vocab.values() if i not in special.values()]
        self.steps, self.ends, self.fail = {}, [()], [0]
        self._grow([i for i in real if len(self.bytes[i]) == 1 or i in self.parts and not self._crossed(*self.parts[i])])
        self.right_spine.cache_clear()
        self.left_spine.cache_clear()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it goes into the next larger one) from the whole token down to a byte."""
        out, above = [(token, NEVER)], NEVER
        while token in self.parts:
            above = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, above))
        return out

    def _crossed(self, a: int, b: int, limit: int) -> bool:
        """Whether a merge crosses from a to b before `limit`, at which both are merged."""
        for x, x_gone in self.right_spine(a):
            for y, y_gone in self.left_spine(b):
                r = self.rank.get((x, y))
                if r is not None and r < min(x_gone, limit) and r <= min(y_gone, limit):
                    return True
        return False

    def _grow(self, tokens: list[int]) -> None:
        """The suffix automaton of the tokens: `steps` goes from a state by a byte to the next, and `ends` has, for each state, the
        tokens that are suffixes of what led there, longest first."""
        own: list[int] = [-1]
        for token in tokens:
            at = 0
            for b in self.bytes[token]:
                key = at << 8 | b
                if key not in self.steps:
                    self.steps[key] = len(own)
                    own.append(-1)
                at = self.steps[key]
            own[at] = token
        below: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, to in self.steps.items():
            below[key >> 8].append((key & 255, to))
        self.fail, self.ends = [0] * len(own), [()] * len(own)
        queue = [0]
        for at in queue:
            for b, to in below[at]:
                back = self.fail[at]
                while at and back and (back << 8 | b) not in self.steps:
                    back = self.fail[back]
                self.fail[to] = self.steps.get(back << 8 | b, 0) if at else 0
                shorter = self.ends[self.fail[to]]
                self.ends[to] = ((own[to], len(self.bytes[own[to]])), *shorter) if own[to] >= 0 else shorter
                queue.append(to)

    def _step(self, at: int, b: int) -> int:
        """The next state where the trie has no own step; remembered, up to a bound."""
        back = at
        while back and (back << 8 | b) not in self.steps:
            back = self.fail[back]
        to = self.steps.get(back << 8 | b, 0)
        if len(self.steps) < STEPS:
            self.steps[at << 8 | b] = to
        return to

    def learn(self, words: Iterable[str]) -> None:
        """Finds the ids of words that aren't known. In sorted order a word shares its prefixes' tokens with the one before it."""
        steps, ends, pairs, size, known = self.steps, self.ends, self.pairs, self.bytes, self.known
        states, last, prior = [0], [-1], b""
        for text in sorted(words):
            word = text.encode("utf-8", "surrogatepass")
            end = 0
            for x, y in zip(word, prior):  # noqa: B905
                if x != y:
                    break
                end += 1
            del states[end + 1 :], last[end + 1 :]
            at, prior = states[-1], word
            for b in word[end:]:
                end += 1
                to = steps.get(at << 8 | b)
                at = self._step(at, b) if to is None else to
                states.append(at)
                found = -1
                for token, length in ends[at]:
                    if length == end:
                        found = token
                        break
                    before = last[end - length]
                    if before >= 0:
                        key = before << 20 | token
                        fits = pairs.get(key)
                        if fits is None:
                            fits = self._fits(key)
                        if fits:
                            found = token
                            break
                last.append(found)
            out = []
            while end:
                token = last[end]
                out.append(token)
                end -= len(size[token])
            out.reverse()
            known[text] = tuple(out)

    def _fits(self, key: int) -> bool:
        """Whether the pair of tokens is compatible; remembered, up to a bound."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        fits = self.pairs[key] = not self._crossed(key >> 20, key & 0xFFFFF, NEVER)
        return fits

    def _pieces(self, text: str) -> list[tuple[str, int]]:
        """Ordinary text, each with the special token after it or -1."""
        if not self.split_special or not self.split_special.search(text):
            return [(text, -1)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out.append((text[at : m.start()], self.special[m[0]]))
            at = m.end()
        return [*out, (text[at:], -1)]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [[(self.words.findall(piece), after) for piece, after in self._pieces(text or "")] for text in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = set().union(*(words for pieces in cut for words, _ in pieces)).difference(self.known)
        old = [word for word in new if word in self.older]
        self.known.update((word, self.older[word]) for word in old)
        self.learn(new.difference(old))
        find, out = self.known.__getitem__, []
        for pieces in cut:
            ids: list[int] = []
            for words, after in pieces:
                ids.extend(chain.from_iterable(map(find, words)))
                if after >= 0:
                    ids.append(after)
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]


@functools.lru_cache(2)
def coder_of(packed: bytes) -> BpeCoder:
    """The worker's coder of a compressed vocabulary file."""
    return BpeCoder(zlib.decompress(packed))


@functools.lru_cache(2)
def table_of(packed: bytes) -> list[bytes]:
    """What decoding needs of a compressed vocabulary file."""
    return token_bytes(json.loads(zlib.decompress(packed)))


def packed_file(path: str) -> bytes:
    """A vocabulary file as it goes with the tasks: under one MB, and no executor needs the file itself."""
    with open(path, "rb") as f:
        return zlib.compress(f.read(), 9)


def bpe_encode(df: DataFrame, vocabulary: bytes, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds the ids of each text as an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            for a, b in text_slices(texts, SLICE):
                found = coder.encode_batch(texts[a:b])
                sizes = np.cumsum([0, *map(len, found)])
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1]))
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
                kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, ids], [*batch.schema.names[:-1], out_col])

    kept = df.drop(out_col)
    schema = schema_with(kept, **{out_col: "array<int>"})
    return df.select(*kept.columns, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocabulary: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__ids"))
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = iter(column.flatten().to_numpy(zero_copy_only=False).tolist())
            lengths = np.diff(np.r_[0, ends]).tolist()
            texts = [decode(table, list(islice(flat, n))) for n in lengths]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*batch.schema.names[:-1], out_col])

    kept = df.drop(out_col)
    schema = schema_with(kept, **{out_col: "string"})
    return df.select(*kept.columns, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """`docs` without its text, with ids and the text that they decode to, in one pass of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in text_slices(texts, SLICE):
                found = coder.encode_batch(texts[a:b])
                sizes = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1]))))
                decoded = pa.array([decode(coder.bytes, x) for x in found], pa.string())
                kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, ids, decoded], [*batch.schema.names[:-1], "ids", "decoded"])

    kept = docs.drop("text", "ids", "decoded")
    return docs.select(*kept.columns, F.col("text").alias("__text")).mapInArrow(run, schema_with(kept, ids="array<int>", decoded="string"))
