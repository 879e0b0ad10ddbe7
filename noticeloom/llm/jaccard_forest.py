"""Join of documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

A MinHash LSH forest: in each tree a document has a path of labels, and the sorted paths form a prefix trie.
Documents meet at the nodes that their paths share, at first at the longest prefix. The pairs that met are
verified exactly. Each pair's similarity tells how likely it was to meet at this depth, so the pairs found
estimate how many links there are in all; while the found share of them is below the target recall, the
prefixes are shortened by one label, and the pairs that meet only now are verified. A pair is looked at
once: at the longest prefix that it shares in any tree, in the first tree where it shares it.

What leaves the verification is each set's number of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, join_skewed, map_columns, written
from .components import components

SHINGLE, SIMILAR = 5, 0.8
#: Trees, labels of a whole path, and the share of all links that is to be found.
TREES, LONGEST, RECALL = 25, 8, 0.9999
#: Sets of a block; rows of a bundle of small nodes; sets whose ids are broadcast at most.
BLOCK, BUNDLE, BROADCAST = 512, 2048, 200_000

_WORD = re.compile(r"\w+")
_POWERS = np.array([0x9E3779B97F4A7C15 ** (i + 1) % (1 << 64) for i in range(64)], np.uint64)


def meeting_chance(similar, length: int, trees: int = TREES):
    """The probability that pairs of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similar ** length) ** trees


def shortest_prefix(trees: int = TREES, longest: int = LONGEST, similar: float = SIMILAR, recall: float = RECALL) -> int:
    """Where shortening ends at the latest: the longest prefix at which even pairs at the threshold meet with
    probability recall; 1 if none is."""
    return next((k for k in range(longest, 1, -1) if meeting_chance(similar, k, trees) >= recall), 1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's lower-cased word shingles; a text of fewer words, but not
    none, is one shingle."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        out += h[i:i + n] * _POWERS[i]
    out ^= out >> np.uint64(32)
    return np.unique(out * _POWERS[1])


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240131)
    return draw.integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, count, np.uint64)


def min_hashes(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function a*x+b over a set that isn't empty."""
    best = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(found), 1024):
        best = np.minimum(best, (found[i:i + 1024, None] * a + b).min(0))
    return best


def set_digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def forest_paths(docs: DataFrame, trees: int = TREES, longest: int = LONGEST) -> DataFrame:
    """(doc_id, digest, path binary): each document's set digest and its paths in all trees, one after the
    other, each of `longest` labels of two bytes; null where there are no words."""
    def make():
        a, b = _permutations(trees * longest)

        def run(ids: list, texts: list) -> tuple:
            digests, paths = [], []
            for text in texts:
                found = shingles(text)
                digests.append(set_digest(found) if len(found) else None)
                paths.append((min_hashes(found, a, b) * _POWERS[4] >> np.uint64(48)).astype(">u2").tobytes() if len(found) else None)
            return ids, digests, paths

        return run

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return map_columns(rows, "doc_id long, digest binary, path binary", make)


def _prefix(length: int) -> Column:
    """The first labels of the path in the tree of column `tree`."""
    return F.col("path").substr(F.col("tree") * (2 * LONGEST) + 1, F.lit(2 * length))


def _nodes(paths: list[bytes], length: int) -> np.ndarray:
    """A number for the node that each path's prefix of this length leads to, by row and tree."""
    labels = np.stack([np.frombuffer(p, ">u2") for p in paths]).astype(np.uint64).reshape(len(paths), -1, LONGEST)
    node = np.zeros(labels.shape[:2], np.uint64)
    for level in range(length):
        node = (node + labels[:, :, level] + np.uint64(1)) * _POWERS[4]
        node ^= node >> np.uint64(31)
    return node


def meet(group: pd.DataFrame, length: int) -> np.ndarray:
    """For the members of one node, by row and row: whether the pair is looked at here. It shares no longer
    prefix in any tree, nor one of this length in an earlier tree; of two blocks, only pairs across are."""
    paths, tree = group["path"].tolist(), int(group["tree"].iloc[0])
    own = _nodes(paths, length)[:, :tree]
    known = np.concatenate([own, _nodes(paths, length + 1)], 1) if length < LONGEST else own
    out = ~np.eye(len(paths), dtype=bool)
    side = group["block"].to_numpy()
    if side.min() != side.max():
        out &= side[:, None] != side[None, :]
    for column in known.T:
        out &= column[:, None] != column[None, :]
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets."""
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    renumber = np.cumsum(often > 1) - 1  # a shingle of one set is in no intersection
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    use = often[code] > 1
    row, code = row[use], renumber[code[use]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    by = np.argsort(code, kind="stable")
    row, code = row[by], code[by]
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        low, high = np.searchsorted(code, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[low:high], code[low:high] - start] = 1
        both += part @ part.T
    return both.astype(np.int64)


def _verify(group: pd.DataFrame, length: int, similar: float, lengths: range) -> pd.DataFrame:
    """Of one node's rows (digest, links, root, pairs, weights), from the pairs looked at here: how many
    documents of linked sets there are, the least row that links lead to, the number of links to earlier
    rows, and for each prefix length the sum, over these, of one through the chance to meet at it."""
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets)
    either = sizes[:, None] + sizes[None, :] - both
    linked = meet(group, length) & (both * 1000 >= round(similar * 1000) * either)
    ratio = both / either
    once = np.tril(linked)
    weights = np.stack([np.where(once, 1 / np.where(once, meeting_chance(ratio, k), 1), 0).sum(1) for k in lengths], 1)
    root = np.arange(len(sets))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(sets)).min(1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    links = linked @ group["copies"].to_numpy(np.int64)
    return pd.DataFrame({"digest": group["digest"], "links": links, "root": group["digest"].to_numpy()[root], "pairs": once.sum(1), "weights": list(weights)})


def _by_node(rows: pd.DataFrame, work) -> list[pd.DataFrame]:
    """work's results on each node's rows, in the order of their digests; a node's single row gives none."""
    rows = rows.sort_values(["node", "digest"]).reset_index(drop=True)
    cut = np.flatnonzero((rows["node"] != rows["node"].shift()).to_numpy())
    return [work(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(cut, np.append(cut[1:], len(rows))) if b - a > 1]


_LINKS = "digest binary, links long, root binary, pairs long, weights array<double>"


def _level(members: DataFrame, meeting: DataFrame, whole: DataFrame, length: int, similar: float, lengths: range) -> DataFrame:
    """(digest, links, root, pairs, weights) of the links of pairs whose longest common prefix has this length."""
    child = F.xxhash64(_prefix(min(length + 1, LONGEST)))
    placed = members.join(meeting, "digest").select("digest", "copies", "path", "tree", F.xxhash64("tree", _prefix(length)).alias("node"), child.alias("child"))
    of = placed.groupBy("node").agg(F.count("*").alias("n"), (F.min("child") != F.max("child")).alias("parted"))
    # below the longest prefix, a node whose members all go on to one child has no pairs of its own
    of = of.where((F.col("n") > 1) & (F.lit(length == LONGEST) | F.col("parted"))).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = written(placed.drop("child").join(of, "node"), f"nodes{length}")
    bundles = max(1, -(-placed.count() // BUNDLE))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    rows = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bundle = F.when(F.col("blocks") == 1, F.pmod("node", F.lit(bundles))).otherwise(F.col("node"))
    rows = rows.select("digest", "copies", "path", "tree", "node", "block", bundle.alias("bundle"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = "digest binary, copies long, path binary, tree int, node long, block int, bundle long, i int, j int"

    def needed(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([group.iloc[:0], *_by_node(group, lambda g: g[meet(g, length).any(1)])])

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        done = _by_node(group, lambda g: _verify(g, length, similar, lengths))
        return pd.concat(done) if done else pd.DataFrame(columns=["digest", "links", "root", "pairs", "weights"])

    wanted = rows.groupBy("bundle", "i", "j").applyInPandas(needed, kind)
    found = wanted.join(whole, "digest").groupBy("bundle", "i", "j").applyInPandas(verify, _LINKS)
    out = written(found.where("links > 0"), f"links{length}")
    discard(placed)
    return out


def find_links(members: DataFrame, meeting: DataFrame, whole: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """The links found, and of each level that was gone through its prefix length, the number of links between
    different sets found by then, and the estimate of how many there are."""
    lengths = range(LONGEST, shortest_prefix(similar=similar, recall=recall) - 1, -1)
    links, levels = None, []
    for place, length in enumerate(lengths):
        more = _level(members, meeting, whole, length, similar, lengths)
        links = more if links is None else links.unionByName(more)
        pairs, estimate = links.agg(F.sum("pairs"), F.sum(F.element_at("weights", place + 1))).first()
        levels.append((length, pairs or 0, estimate or 0.0))
        if pairs and pairs >= recall * estimate:
            break
    return links, levels


def jaccard_join(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs (doc_id, text): (doc_id, class_id, n_links, digest).

    n_links: how many other documents have a similarity of at least `similar`, copies included. class_id: the
    least doc_id of all documents that links lead to. Equal texts are in one class; documents without
    words, null texts too, have no links and are classes of their own; a null doc_id counts last. Long
    texts count whole. Repeated rows are copies of each other. Empty tables give no rows; other columns
    are not read. Words and shingles are compared by 64-bit hashes.
    """
    prints = written(forest_paths(docs), "prints")
    sets = written(prints.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("path").alias("path")), "sets")
    # who meets anyone at all, at the shortest prefix
    ends = shortest_prefix(similar=similar, recall=recall)
    places = sets.select("digest", "path", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("digest", "tree", F.xxhash64("tree", _prefix(ends)).alias("node"))
    shared = places.groupBy("node").count().where("count > 1").select("node")
    meeting = written(places.join(shared, "node").select("digest", "tree"), "meeting")
    members = written(sets.join(meeting.select("digest").distinct(), "digest", "left_semi"), "members")
    number = members.count()

    # their whole sets; a text that doesn't fit one of them by digest drops out again
    wanted = members.select(F.col("doc_id").alias("_id")).distinct()
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = mine.join(F.broadcast(wanted) if number <= BROADCAST else wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def make():
        def run(texts: list) -> tuple:
            found = [shingles(t) for t in texts]
            return [set_digest(s) for s in found], [s.tobytes() for s in found]

        return run

    whole = map_columns(chosen.select("text"), "digest binary, shingles binary", make)
    whole = written(whole.join(members.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles")), "whole")

    links, _ = find_links(members, meeting, whole, similar, recall)
    classes = components(links.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    linked = classes.withColumnRenamed("id", "digest").join(members.select("digest", "doc_id"), "digest")
    heads = linked.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
    linked = join_skewed(linked, heads, "component", "size").select("digest", "class_id")
    linked = linked.join(links.groupBy("digest").agg(F.sum("links").alias("links")), "digest")
    own = F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    known = sets.select("digest", "doc_id", "copies").join(linked, "digest", "left")
    known = written(known.select("digest", own.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "known")
    for table in (meeting, members, whole, sets):
        discard(table)
    rows = join_skewed(prints.where("digest IS NOT NULL").select("doc_id", "digest"), known, "digest", "copies").select("doc_id", "class_id", "n_links", "digest")
    alone = prints.where("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "digest")
    return rows.unionByName(alone)


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the document with the least id,
    of repeated rows one. Null, empty and blank texts have no shingle and stay; long texts count whole; a null id
    counts last; other columns are passed on under any name; an empty table gives an empty one."""
    joined = written(jaccard_join(docs, similar), "classes")
    number, text = fresh(docs, "_id", "_text")
    kept = joined.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(number), "digest")
    out = docs.join(kept.select(number).distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col(number)), "left_semi")
    if kept.groupBy(number, "digest").count().where("count > 1").isEmpty():
        return out
    return out.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
