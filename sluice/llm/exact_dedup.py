"""Exact dedup by stateful streaming.

Digests stream through a keyed aggregation in several batches. Its state, in RocksDB files under the shared folder and
without expiry, keeps for each digest the stable identifier and the content locator (file and row) of the row that stays,
and the number of rows; so a batch meets the keys of all earlier ones. Copies are pre-aggregated before each shuffle, so
a group that holds a third of all rows costs no more than others. Where a digest is met again, the text that stays is
fetched by its locator and compared with the others byte by byte; digests that collide are grouped by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import common

_STORE = "spark.sql.streaming.stateStore."
#: State in RocksDB files; only changes are uploaded, and no space is reserved ahead for each of many small stores.
STATE_SETTINGS = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}rocksdb.allowFAllocate": "false",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "100",
    f"{_STORE}rocksdb.writeBufferSizeMB": "4",
}

#: Batches in which the digests stream through the state, about.
BATCHES = 3
#: Digests or locators (about 150 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 400_000

_FILE, _ROW = "__dedup_file", "__dedup_row"


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(docs: DataFrame) -> DataFrame:
    """docs with the file and row that each row is read from, which a second reading gives again; rows that come from no file are written first."""

    def own(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select(*[df[c] for c in df.columns], at["file_path"].alias(_FILE), at["row_index"].alias(_ROW))

    try:
        return own(docs)
    except AnalysisException:
        return own(common.staged(docs, "dedup-rows"))


def _state(spark: SparkSession, slim: DataFrame, path: str, files_per_batch: int | None) -> DataFrame:
    """digest, top (doc_id, file, row of the row that stays), group_size as the stream's state ends, batches that met the digest."""
    each = files_per_batch or max(1, -(-len(slim.inputFiles()) // BATCHES))
    stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", each).parquet(path)
    held = stream.groupBy("digest").agg(F.max(F.struct("doc_id", _FILE, _ROW)).alias("top"), F.count(F.lit(1)).alias("group_size"))
    out, checkpoint = common.fresh_dir(spark, "dedup-updates"), common.fresh_dir(spark, "dedup-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")  # a replayed batch replaces its own rows

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = held.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = StructType([*held.schema.fields, StructField("batch_id", IntegerType())])
    updates = spark.read.schema(schema).option("basePath", out).parquet(out)
    last = F.max_by(F.struct("top", "group_size"), "batch_id").alias("s")
    final = common.staged(updates.groupBy("digest").agg(last, F.count(F.lit(1)).alias("batches")).select("digest", "s.top", "s.group_size", "batches"), "dedup-final")
    common.drop_folders(spark, out, checkpoint)
    return final


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_of, files_per_batch: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, file, row, keep_file, keep_row, batches.

    Null texts count as empty, so nulls and empty texts form one group. The row with the largest doc_id stays; of
    repeated rows with that doc_id exactly one does. A null doc_id counts as the smallest. Very long texts are read
    whole. An empty table gives no rows. Columns other than doc_id and text are ignored. file and row locate each row,
    keep_file and keep_row the text that stays; batches says in how many batches the digest came.
    """
    return _dedup(_located(common.slim(docs, "doc_id", "text")), digest, files_per_batch)


def _dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_of, files_per_batch: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    common.ready(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    path = common.fresh_dir(spark, "dedup-digests")
    docs.select(docs["doc_id"], sha256_of(text).alias("text_sha256"), digest(text).alias("digest"), _FILE, _ROW).write.parquet(path)
    slim = spark.read.parquet(path)
    state = _state(spark, slim, path, files_per_batch)

    top = [F.col("top.doc_id").alias("keep_id"), F.col(f"top.{_FILE}").alias("keep_file"), F.col(f"top.{_ROW}").alias("keep_row"), "group_size"]
    one = slim.join(state, "digest").select("doc_id", "text_sha256", _FILE, _ROW, *top, "batches", "digest")
    collided = _collided(docs, state, digest)
    if collided is not None:
        again = docs.select(docs["doc_id"], text.alias("text"), digest(text).alias("digest"), _FILE, _ROW).join(collided, "digest", "left_semi")
        again = common.staged(again, "dedup-collided")
        by_text = again.groupBy("text").agg(F.max(F.struct("doc_id", _FILE, _ROW)).alias("top"), F.count(F.lit(1)).alias("group_size"))
        exact = again.join(by_text, "text").join(state.select("digest", "batches"), "digest").select("doc_id", sha256_of(F.col("text")).alias("text_sha256"), _FILE, _ROW, *top, "batches", "digest")
        one = one.join(collided, "digest", "left_anti").unionByName(exact)
    kept = (F.col(_FILE) == F.col("keep_file")) & (F.col(_ROW) == F.col("keep_row"))
    return one.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", F.col(_FILE).alias("file"), F.col(_ROW).alias("row"), "keep_file", "keep_row", "batches")


def _collided(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column]) -> DataFrame | None:
    """Digests shared by texts that differ in their full bytes; None if there are none."""
    hits = state.filter("group_size > 1").select("digest", F.col(f"top.{_FILE}").alias("keep_file"), F.col(f"top.{_ROW}").alias("keep_row"))
    small = hits.count() <= BROADCAST_ROWS
    if hits.isEmpty():
        return None
    side = F.broadcast(hits) if small else hits
    text = F.coalesce(docs["text"], F.lit(""))
    # the text that stays, by its locator
    stays = docs.select(text.alias("kept_text"), _FILE, _ROW).join(side, (F.col(_FILE) == F.col("keep_file")) & (F.col(_ROW) == F.col("keep_row"))).select("digest", "kept_text")
    stays = common.staged(stays, "dedup-stays")
    seen = docs.select(text.alias("text"), digest(text).alias("digest"), _FILE, _ROW).join(side, "digest").filter((F.col(_FILE) != F.col("keep_file")) | (F.col(_ROW) != F.col("keep_row")))
    # two written sides and nothing after the join that needs a digest's rows together: a hot digest's part can be split
    differ = common.staged(seen.select("digest", "text").join(stays, "digest").filter("text <> kept_text").select("digest"), "dedup-differ").distinct()
    common.drop_staged(stays)
    return None if differ.isEmpty() else differ


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that dedup() keeps, with all their columns.

    Nulls, empty and very long texts, ties and repeated rows count as in dedup(): of each text one row stays. An empty
    table stays empty. The rows that go are looked up by their locators, so texts are not shuffled where those are few.
    """
    found = _located(docs)
    gone = common.staged(_dedup(found.select("doc_id", "text", _FILE, _ROW)).filter("NOT kept").select(F.col("file").alias("_f"), F.col("row").alias("_r")), "dedup-gone")
    return found.join(_few(gone), (F.col(_FILE) == F.col("_f")) & (F.col(_ROW) == F.col("_r")), "left_anti").drop(_FILE, _ROW)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
