"""Near-duplicate texts by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits, and every non-zero vector v a mask: the positions whose vector
has an odd product with v. Up to radius positions can't span the space, so some v is orthogonal to all of theirs:
its mask holds none of the differing bits, and the two fingerprints have the same masked value. So each pair within
the radius meets in some table; there are no misses to estimate. What meets is verified exactly.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, map_columns, written
from .components import components

BITS = 64
#: Fingerprints that differ in so many bits at most are linked.
RADIUS = 2
#: Fingerprints of a bucket that are compared in pairs. Those of larger buckets meet at their neighbours instead: two that
#: differ in two bits at most have a common neighbour at one bit.
PAIRED = 64
#: Bytes of a text whose words are held at a time, and words of a shingle.
BLOCK, WIDTH, SEED = 1 << 20, 3, 42

_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def masks(radius: int = RADIUS) -> list[int]:
    """2^(radius + 1) - 1 masks of BITS bits, such that of any radius bits some mask holds none."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _blocks(data: bytes):
    """The words of data, about BLOCK bytes of them at a time."""
    start = 0
    while start < len(data):
        cut = _WHITE.search(data, start + BLOCK)
        end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def fingerprint(text: str) -> int:
    """The SimHash of the text's shingles of three words, A-Z in lower case, as a signed number of 64 bits: a bit is
    set if over half of the shingles' hashes, repeats included, have it. Of fewer words the whole is the
    shingle; without words it is 0. Memory doesn't grow with the number of words."""
    ones, total, last = np.zeros(BITS, np.int64), 0, []
    for words in _blocks(text.encode().lower()):  # bytes: only A-Z change, only ASCII white space divides
        words = last + words
        hashes = [xxhash.xxh64_intdigest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])]
        last = words[1 - WIDTH:]
        if hashes:
            ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
    if not total and last:
        return int(np.array(xxhash.xxh64_intdigest(b" ".join(last), SEED), np.uint64).astype(np.int64))
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of docs (doc_id, text)."""

    def make():
        return lambda ids, texts: (ids, [fingerprint(t) for t in texts])

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id long, fp long", make)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(prints: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """(a, b): links between distinct values of prints (fp), each within radius bits, 1 or 2; they connect all values that
    are within it. In buckets of up to `paired` values every such pair is a link. Larger ones may hold any number: there
    values meet at their neighbours, of which each has as many as its table's mask leaves bits free, and are linked to
    the least at the same neighbour, or for radius 1 to the neighbour itself."""
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    tables = [_signed(m) for m in masks(radius)]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("table", "key"))
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(shared, ["table", "key"]), "met")
    lists = met.where(F.col("n") <= paired).groupBy("table", "key").agg(F.collect_list("fp").alias("fps"))
    near = lambda a: F.filter("fps", lambda b: (b > a) & (F.bit_count(b.bitwiseXOR(a)) <= radius))
    pairs = lists.select("fps", F.explode("fps").alias("a")).select("a", F.explode(near(F.col("a"))).alias("b"))
    free = F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in tables])
    turned = F.transform(free[F.col("table")], lambda bit: F.col("fp").bitwiseXOR(bit))
    around = met.where(F.col("n") > paired).select("table", "fp", F.explode(F.concat(F.array("fp"), turned)).alias("at"))
    stars = around.groupBy("table", "at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    middle = F.array_min("fps") if radius == 2 else F.when(F.array_contains("fps", F.col("at")), F.col("at"))
    stars = stars.select(middle.alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs (doc_id, text): the fingerprint in 16 hexadecimal digits, and
    the smallest doc_id that can be reached over fingerprints at radius bits or fewer, its own included.

    Texts are read whole. Null, empty and blank texts have fingerprint zero and are linked like any other, so are repeated
    rows. Null ids have rows, but name no component, unless all of one are null. An empty table gives no rows, and
    other columns are not read. Copies are one fingerprint: they are never paired.
    """
    prints = written(fingerprints(docs), "fingerprints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = components(links(groups.select("fp"), radius, paired)).select(F.col("id").alias("fp"), "component")
    found = written(groups.join(found, "fp").select("fp", "component", "least"), "linked")
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = join_skewed(found.select("fp", "component"), found.groupBy("component").agg(F.count("*").alias("m")).join(least, "component"), "component", "m").select("fp", "component_id")
    named = groups.join(reached, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    named = written(named, "named")
    return join_skewed(prints, named, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
