"""What the operators of this subpackage share: the shared folder, staged tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])

#: Text bytes that a Python worker takes as one block.
BLOCK_BYTES = 2 << 20


#: Rows of an Arrow batch, where the session has Spark's own default: texts are long, and both sides hold a batch.
BATCH_ROWS = "1000"


#: So that a worker's large buffers go back to the system when they are freed, not when the worker ends.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver runs from, and keeps Arrow batches small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


#: Folders made where the session names none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        found = _OWN[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        atexit.register(_forget, found.removeprefix("file://"))
    return found.rstrip("/")


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/sluice/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folders(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        drop_folders(df.sparkSession, *{x.rpartition("/")[0] for x in df.inputFiles()})


#: Keys that join_spread() broadcasts at most, and the text bytes of each: 8 MB in all.
HOT_KEYS, HOT_BYTES = 2000, 4096


def join_spread(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, by: tuple[str, ...]) -> DataFrame:
    """rows, each with the columns of its key's row in table (one row a key); rows whose key table lacks are left out.

    count names a column of table with how many of the rows have the key at least; the counts add up to total at most.
    Keys of more than total / HOT_KEYS rows, of which there are HOT_KEYS at most, are joined by broadcast, and their
    rows are dealt by the columns `by` instead of the key, so that a key with a third of all rows makes no task larger.
    Keys whose row holds longer texts than HOT_BYTES are joined like others, by a shuffle that Spark may split.
    """
    extra = [c for c in table.columns if c != key]
    found = F.struct(*extra)
    wide = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in table.schema.fields if f.dataType.typeName() == "string"), F.lit(0))
    is_hot = (F.col(count) > max(1, total // HOT_KEYS)) & (wide <= HOT_BYTES)
    hot = table.filter(is_hot).select(F.col(key).alias("_hot_key"), found.alias("_hot"))
    cold = table.filter(~is_hot).select(F.col(key).alias("_cold_key"), found.alias("_cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    dealt = marked.withColumn("_deal", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*by).cast(rows.schema[key].dataType)))
    both = dealt.join(cold, F.col("_deal") == F.col("_cold_key"), "left").withColumn("_found", F.coalesce("_hot", "_cold")).filter("_found IS NOT NULL")
    return both.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in extra])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; others, and their names, don't matter to an operator."""
    return docs.select(*[docs[c] for c in columns])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def give_back() -> None:
    """Returns memory that a worker's last task left unused to the system; the worker may wait long for its next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def blocks_of(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a larger row stands alone."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch by the bytes of a column."""
    return blocks_of(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist(), most)


def map_texts(docs: DataFrame, keep: list[str], made: list[str], schema: str, make: Callable[[], Callable[[list[str]], list[list]]], text: str = "text") -> DataFrame:
    """Rows of `keep` with the columns `made` that make() derives from the texts (null: empty), by Arrow blocks.

    make() runs once a task and returns a function from a list of texts to one list per made column.
    """
    ready(docs.sparkSession)
    out = StructType.fromDDL(schema)
    kinds = {f.name: f.dataType for f in out.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kinds[c]) for c in made]
        work = make()
        for batch in batches:
            for a, b in blocks(batch, text):
                part = batch.slice(a, b - a)
                texts = pa.compute.fill_null(part.column(text), "").to_pylist()
                columns = work(texts)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[*keep, *made])
        give_back()

    return slim(docs, *dict.fromkeys([*keep, text])).mapInArrow(run, out)
