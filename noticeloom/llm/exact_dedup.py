"""Exact deduplication as a stateful stream.

The documents' digests are a change feed, and a streaming aggregation keeps one state row for each
digest on disk (RocksDB, its changelog in the shared folder, no watermark and so no expiry): how many
documents had it, the largest stable identifier among them, and where that document's content lies.
Groups that a second document hit are then checked byte by byte against the content itself; should
different texts ever share a digest, those groups are keyed by their texts instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.utils import AnalysisException

from .common import fresh, join_skewed, shared_folder, written

#: Digests of groups that were hit are broadcast up to this number; beyond it, they are joined by shuffle.
BROADCAST = 200_000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # small write buffers, and no space set aside for files that don't fill it
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _locator(docs: DataFrame) -> Column:
    """Where a row lies: its file and its place in it; just the file, if any, where docs is no plain scan."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.input_file_name()
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def _feed(docs: DataFrame, digest) -> DataFrame:
    """(row, doc_id, digest, text_sha256, locator): one row for each document; row tells apart rows that
    are equal in all of these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), sha256_hex(text).alias("text_sha256"),
        _locator(docs).alias("locator"), F.monotonically_increasing_id().alias("row"),
    )


def stream_state(spark: SparkSession, feed_path: str, schema, folder: str) -> DataFrame:
    """Runs the stream over all files of the feed that this folder's checkpoint hasn't seen, and returns
    the state: (digest, last_id, last_row, locator, group_size). Called again after files were added,
    it goes on from the state on disk."""
    session = spark.newSession()
    for key, value in _STATE.items():
        session.conf.set(key, value)
    out = f"{folder}/updates"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    feed = session.readStream.schema(schema).parquet(feed_path)
    states = feed.groupBy("digest").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "row", "locator")).alias("last"), F.count("*").alias("group_size"))
    (states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start().awaitTermination())
    kind = "digest string, last struct<id:long,row:long,locator:string>, group_size long, batch int"
    # a state only grows: of a digest's updates, the newest has the most rows and the largest identifier
    newest = spark.read.schema(kind).parquet(out).groupBy("digest").agg(F.max("last").alias("last"), F.max("group_size").alias("group_size"))
    return newest.select("digest", F.col("last.id").alias("last_id"), F.col("last.row").alias("last_row"), F.col("last.locator").alias("locator"), "group_size")


def deduplicate(docs: DataFrame, digest=sha256_hex) -> DataFrame:
    """One row for each row of docs (doc_id, text): (doc_id, keep_id, group_size, kept, text_sha256,
    locator).

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the
    largest doc_id stays; of rows that also share the doc_id, any one. A null doc_id is below all
    others. Long texts are read whole. An empty table gives no rows; other columns of docs are not
    read. digest may be replaced by a weaker function: results stay the same.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    _feed(docs, digest).write.parquet(f"{folder}/feed")
    feed = spark.read.parquet(f"{folder}/feed")
    state = stream_state(spark, f"{folder}/feed", feed.schema, folder)

    # full bytes of the groups that were hit: equal least and greatest text means equal texts
    state = written(state, "digests")
    hits = state.where("group_size > 1").select("digest")
    content = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    found = content.join(F.broadcast(hits) if hits.count() <= BROADCAST else hits, "digest", "left_semi")
    checked = found.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    clash = written(checked.where("least <> most").select("digest"), "clash")

    own = feed.withColumnRenamed("locator", "own_locator")
    if clash.isEmpty():
        joined = join_skewed(own, state, "digest", "group_size")
    else:  # group by the texts' own digest and bytes, where the digest alone doesn't tell them apart
        key = ["digest", "text_sha256"]
        plain = feed.join(state.join(clash, "digest", "left_anti"), "digest").select("digest", "text_sha256", "last_id", "last_row", F.col("group_size")).distinct()
        mixed = feed.join(clash, "digest", "left_semi").groupBy(*key).agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "row")).alias("last"), F.count("*").alias("group_size"))
        groups = plain.unionByName(mixed.select(*key, F.col("last.id").alias("last_id"), F.col("last.row").alias("last_row"), "group_size"))
        joined = own.join(groups, key)
    keep = F.when(F.col("last_id") != -(2**63), F.col("last_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), "group_size", (F.col("row") == F.col("last_row")).alias("kept"), "text_sha256", F.col("own_locator").alias("locator"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, null ones being empty, the row with
    the largest doc_id. Rows with one doc_id and one text count as one; a null doc_id is below all others.
    Long texts count whole, other columns are passed on under any name, and an empty table gives an empty one."""
    number, sha, own = fresh(docs, "_id", "_sha", "_own")
    kept = written(deduplicate(docs).where("kept").select(F.col("doc_id").alias(number), F.col("text_sha256").alias(sha)), "kept")
    mine = docs.withColumn(own, sha256_hex(F.coalesce("text", F.lit(""))))
    out = mine.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(number)) & (F.col(own) == F.col(sha)), "left_semi")
    unique = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return (out if unique else out.dropDuplicates(["doc_id", own])).drop(own)
