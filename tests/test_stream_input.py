"""The stream query's input: no batch is written by one task."""

from pyspark.sql import functions as F

from sluice import queries
from sluice.streaming.engine import Builder


def test_many_tasks_write_a_batch(spark, tmp_path, monkeypatch):
    spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 7}').alias("props")
    ).write.parquet(f"{tmp_path}/events.parquet")
    batches = []

    class Counting:
        def start(self, stream, once=False):
            files = spark.read.schema(stream.schema).parquet(paths[0]).inputFiles()
            batches.append(len(files) - sum(batches))
            return self

        def wait(self):
            pass

        def metrics(self):
            return spark.range(1)

    paths = []
    shared = queries._shared
    monkeypatch.setattr(queries, "_shared", lambda s, name: paths.append(p := shared(s, name)) or p)
    monkeypatch.setattr(Builder, "build", lambda self: Counting())
    queries.QUERIES["q_stream_pipeline"](spark, str(tmp_path))
    assert len(batches) == 5 and batches[4] > 1 and sum(batches) > 10
