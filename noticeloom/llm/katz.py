"""Katz backoff language model of order three in partitioned tables.

Words have codes: the most frequent ones, a bounded number, their rank, the others a 63-bit hash. An n-gram of
three words lies in the bucket of its middle word, where everything meets that its probability is made of:
the n-grams with the same first two words, and the pairs of the middle word with its followers. So a
trigram, its context's backoff weight, the pair it backs off to and that pair's weight are found in one bucket, and
only probabilities of single rare words have to be asked for elsewhere. The middle words of very many tokens
are dealt out to several buckets by the first word; their followers are sent to each of these.

Counting: each task cuts its documents into chunks and sends each chunk's distinct n-grams, sorted and packed,
to their buckets, where they are merged. Counts are discounted by Good-Turing, order by order; the mass
that a context's seen continuations leave is shared out by its backoff weight, computed from the sums over
exactly these continuations, so that every distribution adds up to one. A bucket's row holds its
n-grams with their counts and its contexts' weights; the weight of a context that occurred once follows
from its one continuation by the same formula, and is worked out when the row is read.

Scoring: documents' tokens with the two words before them are sent to the buckets in the same way, and each is
evaluated by recursion: its own entry, else the context's weight times the shorter n-gram's probability.
"""

from __future__ import annotations

import itertools
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_folder, ship, slices, write_settings, written

ORDER = 3
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a chunk: what a task holds at a time.
CHUNK_TOKENS = 1_000_000
#: Training tokens for each bucket, about; and those of one middle word that stay together.
BUCKET_TOKENS, WORD_TOKENS = 1_500_000, 2_000_000
#: Words whose ranks, counts and probabilities are broadcast, at most: 8, 8 and 8 bytes for each.
FREQUENT = 1 << 19

TOP_COUNT = 100_000
#: N-grams that are looked up at a time.
LOOKED_UP = 1 << 18
#: Words whose hashes a worker remembers at most, of 32 bytes at most each.
MEMORY = 50_000

_HASHED = np.uint64(1 << 63)
_START = np.uint64(0)  # in the place of the first word where a text begins with the other two
_END = np.uint64(xxhash.xxh64_intdigest(b"\n")) | _HASHED  # no word has a line feed
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 21


class _Hashes(dict):
    """Words' hashes, of a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < MEMORY and len(word) <= 32:
            self[word] = found
        return found


_HASHES = _Hashes()


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased and cut at ASCII blanks, and of its end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out[-1] = _END
    return out | _HASHED


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + _B) * _A
    x = (x ^ x >> np.uint64(31)) * _B
    return x ^ x >> np.uint64(29)


def pack(values: np.ndarray) -> bytes:
    """values, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_codes(codes: np.ndarray) -> bytes:
    """Ranks and hashes apart: a hash leaves a gap, and follows after all ranks."""
    hashed = codes >= _HASHED
    ranks = pack(np.where(hashed, np.uint64(0xFFFFFFFF), codes).astype(np.uint32))
    return struct.pack("<I", len(ranks)) + ranks + codes[hashed].tobytes()


def unpack_codes(data: bytes) -> np.ndarray:
    (size,) = struct.unpack_from("<I", data)
    codes = unpack(data[4:4 + size], np.uint32).astype(np.uint64)
    codes[codes == 0xFFFFFFFF] = np.frombuffer(data, np.uint64, offset=4 + size)
    return codes


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _lengths(first: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(first, size)).astype(np.uint32)


def pack_grams(middle: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """N-grams sorted by middle, first and last word: the first two as runs."""
    outer, inner = _runs(middle), _runs(middle, first)
    within = _lengths(np.searchsorted(inner, outer), len(inner))
    return [pack_codes(middle[outer]), pack(within), pack_codes(first[inner]), pack(_lengths(inner, len(middle))), pack_codes(last)]


def unpack_grams(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = unpack(data[3], np.uint32)
    middle = np.repeat(np.repeat(unpack_codes(data[0]), unpack(data[1], np.uint32)), inner)
    return middle, np.repeat(unpack_codes(data[2]), inner), unpack_codes(data[4])


def pack_block(words: np.ndarray, middle: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The same for numbers of words: each word's code is kept once."""
    outer, inner = _runs(middle), _runs(middle, first)
    runs = (middle[outer], _lengths(np.searchsorted(inner, outer), len(inner)), first[inner], _lengths(inner, len(middle)), last)
    return [pack_codes(words), *(pack(x.astype(np.uint32)) for x in runs)]


def _ordered(middle: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The order by three columns of numbers; ties stay as they are."""
    if max((int(c.max()) for c in (middle, first, last) if len(c)), default=0) < 1 << _BITS:
        return np.argsort(_joined(middle, first, last), kind="stable")
    return np.lexsort((last, first, middle))


def _joined(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out <<= np.uint64(_BITS)
        out |= c
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a.astype(np.uint64)
    out <<= np.uint64(32)
    out |= b if b.dtype.kind == "u" else b.astype(np.uint64)
    return out


class Words:
    """The frequent words: hashes, in order, with their ranks; and by rank, from 1 on, counts and in how many buckets
    the n-grams around a word lie."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, bits: int):
        by = np.argsort(hashes)
        self.hashes, self.ranks, self.bits = hashes[by], by.astype(np.uint64) + np.uint64(1), bits
        self.counts = np.append(0, counts).astype(np.int64)
        self.parts = np.maximum(1, -(-self.counts // WORD_TOKENS)).astype(np.uint64)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return hashes
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.ranks[place], hashes)

    def parts_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < _HASHED, self.parts[np.where(codes < _HASHED, codes, 0).astype(np.int64)], np.uint64(1))

    def bucket(self, codes: np.ndarray, part: np.ndarray | int = 0) -> np.ndarray:
        return (_mixed(codes + np.uint64(0x10001) * np.asarray(part, np.uint64)) >> np.uint64(64 - self.bits)).astype(np.uint32)

    def place(self, middle: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The bucket of each n-gram."""
        parts = self.parts_of(middle)
        return self.bucket(middle, np.where(parts > 1, _mixed(first) % parts, np.uint64(0)))


def _by_bucket(bucket: np.ndarray):
    """(bucket, places of its entries, in order) for each bucket that has any."""
    by = np.argsort(bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket, kind="stable")
    found = bucket[by]
    for a, b in itertools.pairwise(np.append(_runs(found), len(found)) if len(found) else []):
        yield int(found[a]), by[a:b]


def _chunks(batches, place: int):
    """(batches' rows, token hashes, index of the token's row): chunks of CHUNK_TOKENS tokens and more."""
    rows: list[tuple] = []
    hashes: list[np.ndarray] = []
    size = 0

    def cut():
        nonlocal rows, hashes, size
        out = rows, np.concatenate(hashes), np.repeat(np.arange(len(rows), dtype=np.uint32), [len(h) for h in hashes])
        rows, hashes, size = [], [], 0
        return out

    for part in (part for batch in batches for part in slices(batch)):
        for row in zip(*(c.to_pylist() for c in part.columns)):
            rows.append(row[:place] + row[place + 1:])
            hashes.append(token_hashes(row[place] or ""))
            size += len(hashes[-1])
            if size >= CHUNK_TOKENS:
                yield cut()
    if rows:
        yield cut()


class Chunk:
    """The n-grams of a chunk, in local numbers of its words: entries (middle, first, last, row)."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, words: Words):
        distinct, at = np.unique(hashes, return_inverse=True)
        codes = words.codes(distinct)
        by = np.argsort(codes)
        number = np.empty(len(by), np.uint32)
        number[by] = np.arange(1, len(by) + 1, dtype=np.uint32)
        self.codes = np.concatenate([[_START], codes[by]])
        self.token = number[at]
        end = np.flatnonzero(row[1:] == row[:-1]) + 1
        self.middle, self.last, self.row = self.token[end - 1], self.token[end], row[end]
        before = end - 2
        self.first = np.where((before >= 0) & (row[before] == self.row), self.token[before], np.uint32(0))
        parts = words.parts_of(self.codes)
        self.bucket = words.bucket(self.codes)[self.middle]
        split = np.flatnonzero(parts[self.middle] > 1)
        if len(split):
            self.bucket[split] = words.place(self.codes[self.middle[split]], self.codes[self.first[split]])
        self.parts, self.split = parts, split

    def grams(self, *numbers: np.ndarray) -> list[bytes]:
        return pack_grams(*(self.codes[n] for n in numbers))


_PART_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.string()), ("data", pa.list_(pa.binary()))])
_PART = "kind int, bucket int, chunk string, data array<binary>"
#: Kinds of rows: a chunk's documents, its n-grams, rare words' counts, the pairs of a divided word, a bucket of the
#: model, rare words' occurrences, sums of scores, and words whose probability is asked for.
_HEAD, _GRAMS, _COUNTS, _PAIRS, _BLOCK, _RARE, _SUMS, _ASKED = range(8)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PART_SCHEMA)], schema=_PART_SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_PART_SCHEMA.names)


def count_words(texts: DataFrame) -> DataFrame:
    """(key, n): how often each word, and the end of texts, occurs; key is its hash."""
    def send(batches):
        for _, hashes, _ in _chunks(batches, 0):
            keys, n = np.unique(hashes, return_counts=True)
            del hashes
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return texts.select("text").mapInArrow(send, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _numbered(parts) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The distinct codes of all parts, in order, and each part's columns as places among them. Of the codes themselves only
    one part's are held at a time."""
    kept = []
    for columns in parts:
        own, at = np.unique(np.concatenate(columns), return_inverse=True)
        kept.append((own, at.astype(np.uint32), np.cumsum([len(c) for c in columns])[:-1]))
    codes, out = np.unique(np.concatenate([np.zeros(0, np.uint64), *(own for own, _, _ in kept)])), []
    kept.reverse()
    while kept:
        own, at, cuts = kept.pop()
        out.append(np.split(np.searchsorted(codes, own).astype(np.uint32)[at], cuts))
    return codes, out


def _summed(parts: list[list[np.ndarray]], counts: list[np.ndarray], words: int) -> list[np.ndarray]:
    """(middle, first, last, n): parts' n-grams (middle, within, first, inner, last), runs as in pack_grams, put in order, and
    the counts of equal ones added up."""
    def columns(part):
        middle, within, first, inner, last = part
        return np.repeat(np.repeat(middle, within), inner), np.repeat(first, inner), last

    n = np.concatenate([np.zeros(0, np.uint32), *counts])
    small = words < 1 << _BITS  # then three numbers are one
    held = [np.empty(len(n), np.uint64)] if small else [np.empty(len(n), np.uint32) for _ in range(3)]
    place = 0
    while parts:
        found = columns(parts.pop(0))
        for into, values in zip(held, [_joined(*found)] if small else found):
            into[place:place + len(found[2])] = values
        place += len(found[2])
    by = np.argsort(held[0], kind="stable") if small else np.lexsort(held[::-1])
    n = n[by]
    for k in range(len(held)):
        held[k] = held[k][by]
    del by
    start = _runs(*held) if len(n) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, start, dtype=np.uint32) if len(start) else n
    held = [c[start] for c in held]
    del start
    if small:
        mask = np.uint64((1 << _BITS) - 1)
        held = [(held[0] >> np.uint64(shift) & mask).astype(np.uint32) for shift in (2 * _BITS, _BITS, 0)]
    return [*held, n]


class Block:
    """A bucket's n-grams (middle, first, last, n), sorted, and pairs (of, follower, m), all as numbers of its words: pairs
    of undivided middle words follow from the n-grams, those of divided ones are as they were sent."""

    def __init__(self, words: np.ndarray, middle: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, of: np.ndarray, follower: np.ndarray, m: np.ndarray):
        self.words, self.middle, self.first, self.last, self.n = words, middle, first, last, n
        key, count = _pair(middle, last), n
        if len(of):
            divided = np.zeros(len(words), bool)
            divided[of] = True
            own = ~divided[middle]
            key, count = np.concatenate([key[own], _pair(of, follower)]), np.concatenate([n[own], m])
        by = np.argsort(key, kind="stable")
        key, count = key[by], count[by]
        del by
        none = np.zeros(0, np.int64)
        start = _runs(key) if len(key) else none
        self.pair = key[start]
        self.m = np.add.reduceat(count, start, dtype=np.int64) if len(start) else none
        del key, count, start
        self.of, self.follower = (self.pair >> np.uint64(32)).astype(np.uint32), self.pair.astype(np.uint32)
        # contexts: middle words over pairs, and two words over n-grams
        self.heads = _runs(self.of) if len(self.of) else none
        self.head = self.of[self.heads].astype(np.int64)
        self.count1 = np.add.reduceat(self.m, self.heads) if len(self.heads) else self.m
        if len(words) and words[0] == _START:
            true = np.flatnonzero(first > 0)
            middle, first, last, n = (c[true] for c in (middle, first, last, n))
            del true
        self.starts = _runs(middle, first) if len(n) else none
        self.context = _pair(middle[self.starts], first[self.starts])
        self.inner, self.g = (middle, last), n
        self.count2 = np.add.reduceat(n, self.starts, dtype=np.int64) if len(self.starts) else none

    @classmethod
    def read(cls, data: list[bytes]) -> Block:
        numbers = lambda i: unpack(data[i], np.uint32)
        lengths = numbers(4)
        middle = np.repeat(np.repeat(numbers(1), numbers(2)), lengths)
        return cls(unpack_codes(data[0]), middle, np.repeat(numbers(3), lengths), numbers(5), numbers(6), numbers(7), numbers(8), numbers(9))

    def seen(self, divided_elsewhere: np.ndarray) -> list[int]:
        """How many pairs, then n-grams, occurred 1, 2, ... times; pairs of these middle words are counted elsewhere."""
        here = ~np.isin(self.words[self.of], divided_elsewhere) if len(self.of) else np.zeros(0, bool)
        count = lambda c: np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:DISCOUNTED + 2].tolist()
        return [*count(self.m[here]), *count(self.g)]

    def probabilities(self, factors: dict[int, np.ndarray]) -> None:
        """p2, p3: of each pair's and n-gram's last word after the words before; left1, left2: what contexts leave."""
        def after(n, k, count, starts):
            masses = factors[k][np.minimum(n, DISCOUNTED + 1)]
            masses *= n
            left = 1 - (np.add.reduceat(masses, starts) if len(starts) else masses) / count
            tight = left < 1e-9  # nothing was discounted: such a context sets one count aside
            masses /= np.repeat(count + tight, _lengths(starts, len(masses)))
            return masses, np.where(tight, 1 / (count + 1.0), left)

        self.p2, self.left1 = after(self.m, 2, self.count1, self.heads)
        self.p3, self.left2 = after(self.g, 3, self.count2, self.starts)

    def grams(self) -> np.ndarray:
        """Each n-gram as its context's place and its last word."""
        return _pair(np.repeat(np.arange(len(self.starts), dtype=np.uint32), _lengths(self.starts, len(self.g))), self.inner[1])

    def context_weights(self) -> np.ndarray:
        """The backoff weight of each context of two words."""
        covered, ends, a = np.zeros(len(self.starts)), np.append(self.starts[1:], len(self.g)), 0
        while a < len(covered):  # whole contexts of some n-grams at a time
            low = self.starts[a]
            b = max(a + 1, int(np.searchsorted(ends, low + LOOKED_UP, side="right")))
            shorter = _pair(*(c[low:ends[b - 1]] for c in self.inner))
            covered[a:b] = np.add.reduceat(self.p2[np.searchsorted(self.pair, shorter)], self.starts[a:b] - low)
            a = b
        return self.left2 / (1 - covered)


def discounts(seen: dict[int, int]) -> list[float]:
    """Factor of each count from 0 to DISCOUNTED, by Good-Turing with Katz's renormalisation, from the
    numbers of n-grams seen so often; where those are too few for factors between 0 and 1, the absolute
    discount n1 / (n1 + 2 n2)."""
    n = [seen.get(r, 0) for r in range(DISCOUNTED + 2)]
    if n[1]:
        cut = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        factors = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0 for r in range(1, DISCOUNTED + 1)]
        if all(0 < f < 1 for f in factors):
            return [1.0, *factors]
    d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [1.0, *(1 - d / r for r in range(1, DISCOUNTED + 1))]


class Numbers:
    """What tasks need to know of a model: factors of counts, by order; tokens and types of the training texts."""

    def __init__(self, factors: dict[int, np.ndarray], tokens: int, types: int, freed: float):
        self.factors, self.tokens, self.types = factors, tokens, types
        self.scale, rest = (float(tokens), freed) if freed > 0 else (tokens + 1.0, 1.0)
        #: log10 probability of a word that has no entry
        self.unknown = math.log10(rest / self.scale) if tokens else 0.0

    def one(self, n: np.ndarray) -> np.ndarray:
        """The probabilities of words that occurred n times."""
        return self.factors[1][np.minimum(n, DISCOUNTED + 1)] * n / self.scale

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + self.types + 1))


class Model:
    """blocks: a row for each bucket; unigrams: (key, n); words: the frequent ones; seen: by order, how many n-grams
    occurred so often."""

    def __init__(self, blocks: DataFrame, unigrams: DataFrame, words: Words, numbers: Numbers, seen: dict[int, dict[int, int]]):
        self.blocks, self.unigrams, self.words, self.numbers, self.seen, self.tokens = blocks, unigrams, words, numbers, seen, numbers.tokens

    def drop(self) -> None:
        """Frees the tables; what score() gave before stays, as long as it is read in this session."""
        _dropped(self.blocks)


def _count_grams(texts: DataFrame, shared) -> DataFrame:
    """Rows (kind, bucket, chunk, data, seen) of each bucket's n-grams."""
    def send(batches):
        for _, hashes, row in _chunks(batches, 0):
            chunk, rows = Chunk(hashes, row, shared.value), []
            for bucket, here in _by_bucket(chunk.bucket):
                key = [c[here] for c in (chunk.middle, chunk.first, chunk.last)]
                by = _ordered(*key)
                key = [c[by] for c in key]
                start = _runs(*key)
                rows.append((_GRAMS, bucket, "", [*chunk.grams(*(c[start] for c in key)), pack(_lengths(start, len(by)))]))
            if len(chunk.split):  # the followers of divided words go to each of their buckets
                pair, n = np.unique(_pair(chunk.middle[chunk.split], chunk.last[chunk.split]), return_counts=True)
                of, follower = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
                for a, b in itertools.pairwise(np.append(_runs(of), len(of))):
                    code = chunk.codes[int(of[a])]
                    data = [pack_codes(np.full(b - a, code)), pack_codes(chunk.codes[follower[a:b].astype(np.int64)]), pack(n[a:b].astype(np.uint32))]
                    places = shared.value.bucket(np.full(int(chunk.parts[int(of[a])]), code), np.arange(int(chunk.parts[int(of[a])])))
                    for bucket in np.unique(places).tolist():  # two parts may share a bucket
                        rows.append((_PAIRS, bucket, "first" if bucket == places[0] else "again", data))
            del chunk, hashes, row  # before the next chunk is made
            if rows:
                yield _batch(rows)

    sent = texts.select("text").mapInArrow(send, _PART)
    return sent.groupBy("bucket").applyInPandas(_merged, _PART + ", seen array<long>")


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket's rows of _count_grams as one."""
    of_kind = lambda k: [list(d) for d in group["data"][group["kind"] == k]]
    grams, sent = of_kind(_GRAMS), of_kind(_PAIRS)
    words, numbers = _numbered(itertools.chain(([unpack_codes(d[i]) for i in (0, 2, 4)] for d in grams), ([unpack_codes(d[i]) for i in (0, 1)] for d in sent)))
    of, follower = (np.concatenate([np.zeros(0, np.uint32), *(c[i] for c in numbers[len(grams):])]) for i in (0, 1))
    m = np.concatenate([np.zeros(0, np.uint32), *(unpack(d[2], np.uint32) for d in sent)])
    runs = [[c[0], unpack(d[1], np.uint32), c[1], unpack(d[3], np.uint32), c[2]] for d, c in zip(grams, numbers)]
    del numbers
    block = Block(words, *_summed(runs, [unpack(d[5], np.uint32) for d in grams], len(words)), of, follower, m)
    again = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack_codes(d[0])[:1] for d in group["data"][group["chunk"] == "again"])]))
    divided = np.flatnonzero(np.isin(block.of, of))
    data = [*pack_block(words, block.middle, block.first, block.last), *(pack(x.astype(np.uint32)) for x in (block.n, block.of[divided], block.follower[divided], block.m[divided])), pack_codes(again)]
    return pd.DataFrame({"kind": [_BLOCK], "bucket": [group["bucket"].iloc[0]], "chunk": [""], "data": [data], "seen": [block.seen(again)]})


def train(texts: DataFrame) -> Model:
    """The model of texts (text); null texts count as empty. Without texts all words are unknown, with
    probability one. Long texts count whole, repeated rows each count, and other columns aren't read."""
    spark = texts.sparkSession
    ship(spark)
    unigrams = written(count_words(texts), "unigrams")
    sums = unigrams.agg(F.sum("n"), F.count("*"), *(F.count_if(F.col("n") == r) for r in range(1, DISCOUNTED + 2))).first()
    tokens, types = sums[0] or 0, sums[1]
    seen = {1: {r: sums[r + 1] for r in range(1, DISCOUNTED + 2)}}
    # the least count that at most FREQUENT words have; larger ones than TOP_COUNT need not be told apart
    many, least = 0, TOP_COUNT
    for r in sorted(unigrams.groupBy(F.least("n", F.lit(TOP_COUNT)).alias("n")).count().collect(), reverse=True):
        many += r["count"]
        if many > FREQUENT:
            break
        least = r["n"]
    top = unigrams.where(F.col("n") >= least).orderBy("key").toArrow()
    words = Words(top["key"].to_numpy().view(np.uint64), top["n"].to_numpy(), max(3, (math.ceil(tokens / BUCKET_TOKENS) - 1).bit_length()))
    shared = spark.sparkContext.broadcast(words)
    blocks = _bucketed(_count_grams(texts, shared), "grams", words.bits)
    counted = blocks.agg(*(F.sum(F.element_at("seen", i + 1)) for i in range(2 * (DISCOUNTED + 1)))).first()
    for k in (2, 3):
        seen[k] = {r: counted[(k - 2) * (DISCOUNTED + 1) + r - 1] or 0 for r in range(1, DISCOUNTED + 2)}
    factors = {k: np.array([*discounts(seen[k]), 1.0]) for k in seen}
    freed = sum(r * seen[1][r] * (1 - factors[1][r]) for r in range(1, DISCOUNTED + 1))
    if freed <= 0:
        factors[1] = np.ones(DISCOUNTED + 2)
    model = Model(blocks, unigrams, words, Numbers(factors, tokens, types, float(freed)), seen)
    model.blocks = _bucketed(_weighted(model, shared), "model", words.bits)
    _dropped(blocks)
    return model


def _bucketed(df: DataFrame, name: str, bits: int) -> DataFrame:
    """df as a table of so many buckets in the shared folder: what is grouped with it by bucket comes to it, and it is
    not shuffled itself."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    table = f"noticeloom_{name}_{folder.rsplit('/', 1)[1]}"
    with write_settings(spark):
        df.write.bucketBy(1 << bits, "bucket").option("path", f"{folder}/{name}").saveAsTable(table)
    return spark.table(table)


def _dropped(table: DataFrame) -> None:
    """Frees a table of _bucketed."""
    for name in {part.split("/noticeloom/")[1].split("/")[1] + "_" + part.split("/noticeloom/")[1].split("/")[0] for part in table.inputFiles()}:
        table.sparkSession.sql(f"DROP TABLE IF EXISTS noticeloom_{name}")
    discard(table)


def _weighted(model: Model, shared) -> DataFrame:
    """The blocks with the backoff weights of their contexts."""
    one, factors = model.numbers.one(model.words.counts), model.numbers.factors

    def rare(batches):
        for batch in batches:
            for data in batch["data"].to_pylist():
                b = Block.read(data)
                of, follower = b.words[b.of], b.words[b.follower]
                use = (follower >= _HASHED) & ~np.isin(of, unpack_codes(data[10]))
                yield pa.RecordBatch.from_arrays([pa.array(of[use].view(np.int64)), pa.array(follower[use].view(np.int64))], ["of", "key"])

    def place(batches):
        got = [(b["of"].to_numpy().view(np.uint64), b["covered"].to_numpy()) for b in batches]
        if got:
            of, covered = (np.concatenate(c) for c in zip(*got))
            rows = []
            parts = shared.value.parts_of(of)
            for part in range(int(parts.max()) if len(parts) else 0):
                use = parts > part
                for bucket, here in _by_bucket(shared.value.bucket(of[use], part)):
                    rows.append((_COUNTS, bucket, "", [pack_codes(of[use][here]), pack(covered[use][here])]))
            if rows:
                yield _batch(rows)

    def weigh(blocks: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        rows = []
        sums = list(sent["data"])
        of = np.concatenate([unpack_codes(d[0]) for d in sums]) if sums else np.zeros(0, np.uint64)
        more = np.concatenate([unpack(d[1], np.float64) for d in sums]) if sums else np.zeros(0)
        by = np.argsort(of)
        of, more = of[by], more[by]
        for bucket, data in zip(blocks["bucket"], map(list, blocks["data"])):
            b = Block.read(data)
            b.probabilities(factors)
            follower = b.words[b.follower]
            known = np.where(follower < _HASHED, one[np.where(follower < _HASHED, follower, 0).astype(np.int64)], 0.0)
            covered = np.add.reduceat(known, b.heads) if len(b.heads) else known
            head = b.words[b.head]
            if len(of):
                at = np.minimum(np.searchsorted(of, head), len(of) - 1)
                covered = covered + np.where(of[at] == head, more[at], 0.0)
            weights = b.left1 / (1 - covered)
            rows.append((_BLOCK, bucket, "", [*data[:10], pack(weights), pack(b.context_weights()[b.count2 > 1])]))
        return _frame(rows)

    n = F.when(F.col("n") <= DISCOUNTED, F.element_at(F.array(*map(F.lit, map(float, factors[1]))), F.col("n").cast("int") + 1)).otherwise(1.0) * F.col("n")
    sums = model.blocks.select("data").mapInArrow(rare, "of long, key long").join(model.unigrams, "key").groupBy("of").agg(F.sum(n / F.lit(model.numbers.scale)).alias("covered"))
    blocks = model.blocks.select("bucket", "data")
    return blocks.groupBy("bucket").cogroup(sums.mapInArrow(place, _PART).groupBy("bucket")).applyInPandas(weigh, _PART)


class Evaluator:
    """A bucket of the model, asked for log10 probabilities."""

    def __init__(self, data: list[bytes], factors: dict[int, np.ndarray]):
        b = Block.read(data)
        b.middle = b.first = b.last = b.n = b.of = b.follower = None  # only what is looked up stays
        b.probabilities(factors)
        self.weight1 = np.log10(unpack(data[10], np.float64))
        weights = b.context_weights()
        weights[b.count2 > 1] = unpack(data[11], np.float64)
        self.weight2, self.p2, self.p3 = (np.log10(x, out=x) for x in (weights, b.p2, b.p3))
        self.words, self.pair, self.head, self.context, self.gram = b.words, b.pair, b.head, b.context, b.grams()

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, possible & (table[at] == keys)

    def __call__(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, short, last) of packed n-grams: log10 P(last | first middle), but where short, the last word's own log10
        probability is still to be added. Words are looked up once for each run."""
        b, inner = self, unpack(runs[3], np.uint32)
        first, last = unpack_codes(runs[2]), unpack_codes(runs[4])
        spread = lambda x: np.repeat(x, inner)
        number = lambda codes: self._find(b.words, codes, np.ones(len(codes), bool))
        (m, has_m), (f, has_f), (w, has_w) = number(unpack_codes(runs[0])), number(first), number(last)
        within = unpack(runs[1], np.uint32)
        m, has_m = np.repeat(m, within), np.repeat(has_m, within)
        c, context = self._find(b.context, _pair(m, f), has_m & has_f & (first != _START))
        m, has_m, c, context = map(spread, (m, has_m, c, context))
        at, own = self._find(b.gram, _pair(c, w), context & has_w)
        value = np.where(own, self.p3[at] if len(self.p3) else 0.0, np.where(context, self.weight2[c] if len(self.weight2) else 0.0, 0.0))
        rest = np.flatnonzero(~own)  # these back off to the pair, and then to the word
        at, pair = self._find(b.pair, _pair(m[rest], w[rest]), has_m[rest] & has_w[rest])
        value[rest] += np.where(pair, self.p2[at] if len(self.p2) else 0.0, 0.0)
        short = np.zeros(len(last), bool)
        short[rest] = ~pair
        rest = rest[~pair]
        at, head = self._find(b.head, m[rest], has_m[rest])
        value[rest] += np.where(head, self.weight1[at] if len(self.weight1) else 0.0, 0.0)
        return value, short, last


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of docs (doc_id, text), in log10.

    A null text counts as empty: its one token is the end. Long texts are scored whole. Equal rows give
    equal rows; other columns are not read; an empty table gives no rows. Words are told apart by 63-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    numbers = model.numbers
    one, base, unknown, factors = numbers.one, numbers.base, numbers.unknown, numbers.factors
    frequent = model.words.counts > 0
    with np.errstate(divide="ignore"):
        own = np.where(frequent, np.log10(one(model.words.counts)), 0.0)
    shared = spark.sparkContext.broadcast((model.words, own, np.where(frequent, base(model.words.counts), 0.0)))
    base_unknown = float(base(np.zeros(1))[0])

    def send(batches):
        from pyspark import TaskContext

        words, probability, of_base = shared.value
        task = TaskContext.get().partitionId()
        for number, (ids, hashes, row) in enumerate(_chunks(batches, 1)):
            name, size, rows = f"{task}:{number}", len(ids), []
            chunk = Chunk(hashes, row, words)
            code = chunk.codes[chunk.token]
            ranked = code < _HASHED
            rank = np.where(ranked, code, 0).astype(np.int64)
            begin = _runs(row) if len(row) else np.zeros(0, np.int64)
            done = np.zeros((3, size))  # score, base score, known tokens
            done[0, row[begin]] = np.where(ranked[begin], probability[rank[begin]], 0.0)
            done[1] = np.bincount(row, of_base[rank], size)
            done[2] = np.bincount(row[ranked], minlength=size)
            first = np.zeros(len(row), np.uint8)
            first[begin] = 1  # a rare first word's own probability is its score
            places = np.flatnonzero(~ranked)
            for bucket, here in _by_bucket(words.bucket(code[places])):
                at = places[here]
                rows.append((_RARE, bucket, name, [code[at].tobytes(), pack(row[at]), first[at].tobytes()]))
            for bucket, here in _by_bucket(chunk.bucket):
                key = [c[here] for c in (chunk.middle, chunk.first, chunk.last)]
                by = _ordered(*key)
                key, whose = [c[by] for c in key], chunk.row[here][by]
                start = _runs(*key, whose)
                rows.append((_GRAMS, bucket, name, [*chunk.grams(*(c[start] for c in key)), pack(_lengths(start, len(by))), pack(whose[start])]))
            names = np.array([i for (i,) in ids], object)
            null = np.array([i is None for i in names], bool)
            as_numbers = np.where(null, 0, names).astype(np.int64)
            tokens = np.bincount(row, minlength=size).astype(np.uint32)
            rows.append((_HEAD, zlib.crc32(name.encode()) % (1 << words.bits), name, [pack(as_numbers), pack(tokens), null.tobytes(), pack(done.ravel())]))
            del chunk, code, ranked, rank, places, first, hashes, row  # before the next chunk is made
            yield _batch(rows)

    def words_of(batches):
        got = [(b["key"].to_numpy().view(np.uint64), b["n"].to_numpy()) for b in batches]
        if got:
            keys, n = (np.concatenate(c) for c in zip(*got))
            keys, n = keys[(code := shared.value[0].codes(keys)) >= _HASHED], n[code >= _HASHED]
            rows = [(_COUNTS, bucket, "", [keys[here].tobytes(), pack(n[here])]) for bucket, here in _by_bucket(shared.value[0].bucket(keys))]
            if rows:
                yield _batch(rows)

    def table(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        parts = group["data"][group["kind"] == _COUNTS]
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(d[0], np.uint64) for d in parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(unpack(d[1], np.int64) for d in parts)])
        by = np.argsort(keys)
        return keys[by], n[by]

    def summed(chunk: str, rows: np.ndarray, *columns: np.ndarray) -> tuple:
        whose, at = np.unique(rows, return_inverse=True)
        sums = [np.bincount(at, c, len(whose)) for c in columns]
        return (_SUMS, 0, chunk, [pack(whose.astype(np.uint32)), *(pack(s) for s in sums)])

    def meet(blocks: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out = [tuple(r) for r in group[group["kind"] == _HEAD].itertuples(index=False)]
        words, probability, _ = shared.value
        evaluate = Evaluator(list(blocks["data"].iloc[0]), factors) if len(blocks) else None
        keys, n = table(group)
        for kind, chunk, data in zip(group["kind"], group["chunk"], group["data"]):
            if kind == _RARE:
                code, whose, first = np.frombuffer(data[0], np.uint64), unpack(data[1], np.uint32), np.frombuffer(data[2], np.uint8)
                at, here = Evaluator._find(keys, code, np.ones(len(code), bool))
                count = np.where(here, n[at], 0) if len(n) else np.zeros(len(code), np.int64)
                with np.errstate(divide="ignore"):
                    alone = np.where(count > 0, np.log10(one(count)), unknown)
                out.append(summed(chunk, whose, np.where(first == 1, alone, 0.0), np.where(count > 0, base(count), base_unknown), (count > 0).astype(float)))
            elif kind == _GRAMS:
                times, whose = unpack(data[5], np.uint32).astype(float), unpack(data[6], np.uint32)
                value, short, last = evaluate(list(data[:5])) if evaluate else (np.zeros(len(times)), np.ones(len(times), bool), unpack_codes(data[4]))
                ranked = last < _HASHED
                value = value + np.where(short & ranked, probability[np.where(ranked, last, 0).astype(np.int64)], 0.0)
                out.append(summed(chunk, whose, value * times))
                asked = np.flatnonzero(short & ~ranked)
                for bucket, here in _by_bucket(words.bucket(last[asked])):
                    at = asked[here]
                    out.append((_ASKED, bucket, chunk, [last[at].tobytes(), pack(whose[at]), pack(times[at])]))
        return _frame(out)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys, n = table(group)
        out = []
        for kind, chunk, data in zip(group["kind"], group["chunk"], group["data"]):
            if kind == _ASKED:
                code, whose, times = np.frombuffer(data[0], np.uint64), unpack(data[1], np.uint32), unpack(data[2], np.float64)
                at, here = Evaluator._find(keys, code, np.ones(len(code), bool))
                count = np.where(here, n[at], 0) if len(n) else np.zeros(len(code), np.int64)
                with np.errstate(divide="ignore"):
                    out.append(summed(chunk, whose, np.where(count > 0, np.log10(one(count)), unknown) * times))
        return _frame(out)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        head = list(group["data"][group["kind"] == _HEAD].iloc[0])
        names, tokens, null = unpack(head[0], np.int64), unpack(head[1], np.uint32).astype(np.int64), np.frombuffer(head[2], bool)
        done = unpack(head[3], np.float64).reshape(3, -1).copy()
        for kind, data in zip(group["kind"], group["data"]):
            if kind == _SUMS:
                at = unpack(data[0], np.uint32)
                for line, part in enumerate(data[1:]):
                    done[line, at] += unpack(part, np.float64)
        ids = pd.array(np.where(null, None, names.astype(object)), "Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": tokens, "n_known": np.rint(done[2]).astype(np.int64), "base_score": done[1], "score": done[0]})

    rare = model.unigrams.mapInArrow(words_of, _PART)
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, _PART)
    blocks = model.blocks.select("bucket", "data").groupBy("bucket")
    met = written(blocks.cogroup(sent.unionByName(rare).groupBy("bucket")).applyInPandas(meet, _PART), "met")
    asked = met.where(F.col("kind") == _ASKED).unionByName(rare).groupBy("bucket").applyInPandas(answer, _PART)
    parts = met.where(F.col("kind").isin(_HEAD, _SUMS)).unionByName(asked)
    return parts.groupBy("chunk").applyInPandas(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
