"""A Merkle manifest: a tree of digests over a table's rows, by source, and the proof of each row.

A tree grows level by level: nodes are numbered, a node's number divided by the fanout is its parent's, and the sorted
array of the children's digests is hashed into the parent's. Numbers come from row_number within the tasks of a range
partitioning and from the number of rows before these, so no tree is ordered in one task. The roots of all trees are the
leaves of one more. Then, from the root down, each level is joined with the proofs of its nodes, and to these the
siblings of each child are appended: an inner level joins as many rows as it has nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fold, fresh, written

#: Consecutive nodes that become one.
FANOUT = 3

_PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """sha256 in lower-case hexadecimal digits of the parts' bytes one after the other."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of the value's bytes in UTF-8, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, ...) with index, from 0 on in each tree and in this order, and n, the tree's number of nodes."""
    task, before = fresh(nodes, "task", "before")
    placed = written(nodes.repartitionByRange("tree", *order).withColumn(task, F.spark_partition_id()), "placed")
    tree = Window.partitionBy("tree")
    counts = placed.groupBy("tree", task).agg(F.count("*").alias("m"))  # a row for each task and tree
    counts = counts.select("tree", task, (F.sum("m").over(tree.orderBy(task)) - F.col("m")).alias(before), F.sum("m").over(tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", task).orderBy(*order))
    return written(placed.withColumn("index", inside - 1).join(counts, ["tree", task]).withColumn("index", F.col("index") + F.col(before)).drop(task, before), "numbered")


def grow(leaves: DataFrame, carried: list[str], fanout: int) -> list[DataFrame]:
    """The levels of the trees over leaves (tree, index, n, hash, carried): the leaves, then (tree, index, n, hash, children),
    where children are arrays of (hash, carried) in order; carried is in the first ones only. A tree ends at its only node."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        own = carried if len(levels) == 1 else []
        parents = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("index") / fanout).alias("parent"), "n").agg(F.sort_array(F.collect_list(F.struct("index", "hash", *own))).alias("children"))
        parents = parents.select("tree", F.col("parent").alias("index"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join("children.hash", "").cast("binary"), 256).alias("hash"), "children")
        levels.append(written(parents, f"level_{len(levels)}"))
        most = -(-most // fanout)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, height, hash): each tree's only node at its last level."""
    return reduce(DataFrame.unionByName, [level.where("n = 1").select("tree", F.lit(k).alias("height"), "hash") for k, level in enumerate(levels)])


def prove(levels: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, hash, carried, proof) of each leaf; proof has, from the leaf up, the siblings' digests to the left and right, those of
    a run of one being empty, and ends with what above (tree, height, proof) has for the tree's root."""
    known = None
    for k in reversed(range(1, len(levels))):
        own = carried if k == 1 else []
        start = above.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("index"), "proof")
        known = start if known is None else written(known.unionByName(start), f"proofs_{k}")
        each = levels[k].select("tree", "index", "children").join(known, ["tree", "index"]).select("tree", "proof", "children", F.posexplode("children").alias("place", "child"))
        side = lambda start, length: F.array_join(F.slice("children.hash", start, length), "")
        step = F.struct(side(F.lit(1), F.col("place")).alias("left"), side(F.col("place") + 2, F.size("children")).alias("right"))
        known = each.select("tree", F.col("child.index").alias("index"), F.col("child.hash").alias("hash"), *[F.col(f"child.{c}").alias(c) for c in own], F.concat(F.array(step), "proof").alias("proof"))
        known = known if k == 1 else known.drop("hash")
    alone = levels[0].where("n = 1").join(above.where("height = 0").select("tree", "proof"), "tree").select("tree", "hash", *carried, "proof")
    return alone if known is None else known.select("tree", "hash", *carried, "proof").unionByName(alone)


def manifest(leaves: DataFrame, carried: list[str], order: list[str], fanout: int = FANOUT) -> DataFrame:
    """(tree, hash, carried, proof, subroot, root) of each row of leaves (tree, hash, carried), no tree being null.

    A tree's leaves stand in this order; while there are several nodes, each `fanout` consecutive ones become one, the last
    run being shorter. The only node of a tree is its subroot, and the subroots, ordered by tree, make the last tree in the
    same way, which ends in root. proof is that of prove(), up to root. An empty table gives no rows.
    """
    levels = grow(numbered(leaves, order), carried, fanout)
    subroots = written(roots(levels), "subroots")
    names = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "hash")
    top = grow(numbered(names, ["name"]), ["name", "height"], fanout)
    root = written(roots(top), "root").withColumn("proof", F.array().cast(_PROOF))
    above = prove(top, root.select("tree", "height", "proof"), ["name", "height"]).select(F.col("name").alias("tree"), "height", "proof", F.col("hash").alias("subroot"))
    above = written(above, "above")
    proved = prove(levels, above.drop("subroot"), carried)
    for level in top:
        discard(level)
    return proved.join(above.select("tree", "subroot"), "tree").crossJoin(F.broadcast(root.select(F.col("hash").alias("root"))))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def verify(docs: DataFrame) -> DataFrame:
    """The manifest of docs (doc_id, source, lang, n_chars, text), and what a manipulated copy of it gives: (doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified) for each row.

    The copy lacks the line feeds of each text whose doc_id's crc32 is even (a null id's is that of ''). folded_root follows from the
    copy's leaf and the row's own siblings, and is verified where it equals root. Nulls are `-` in a leaf, apart from empty
    values; a null source is a tree of its own, before all others; null ids come first. Rows of equal source and id stand in
    order of their leaves; equal rows have each their own place. Texts count whole, other columns not; an empty table
    gives no rows.
    """
    leaf = lambda text: digest(*map(field, (F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text)))
    tampered = F.when(fold("doc_id", 2) == 0, leaf(F.translate("text", "\n", "")))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # the null source sorts first
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("hash"), tampered.alias("copy"))
    leaves = leaves.withColumn("copy", F.when(F.col("copy") != F.col("hash"), F.col("copy")))
    found = manifest(written(leaves, "leaves"), ["doc_id", "copy"], ["doc_id", "hash"])
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("copy", "hash"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
