"""Events from tables, JSON lines and streams; seen keys and results in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import parsed
from ..model import EVENTS


def normalized(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a variant payload, no null payload or time; and the rows set aside because an id, type or user is null."""
    whole = F.col("event_id").isNotNull() & F.col("event_type").isNotNull() & F.col("user_id").isNotNull()
    good = raw.filter(whole).withColumn("payload", parsed(F.col("payload"))).withColumn("ts", F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()))
    return good, raw.filter(~whole)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events of one JSON object a line; lines that aren't are kept as nulls with the text in _corrupt."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*[StructField(f.name, f.dataType, True) for f in EVENTS.fields], StructField("_corrupt", StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as events: value and the props' members are the payload; ids stay numbers for ordering."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    payload = F.concat(F.substring("props", 1, 1), F.lit('"value": '), F.col("value").cast("string"), F.lit(", "), F.expr("substring(props, 2)"))
    return t.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), payload.alias("payload"), F.lit("table").alias("source_service"))


#: Fields of from_table() that are columns of known type already, and need no parsing.
TABLE_FIELDS = {"payload.k": ("k", "long"), "payload.value": ("value", "double"), "k": ("k", "long"), "value": ("value", "double")}


def table_fields():
    from ..functions.fields import Fields

    typed = {name: (F.col(c), kind) for name, (c, kind) in TABLE_FIELDS.items()}
    event = {"eventType": F.col("event_type"), "userId": F.col("user_id").cast("string"), "sourceService": F.col("source_service"), "eventId": F.col("event_id").cast("string")}
    return Fields(F.try_parse_json(F.col("payload")), None, event, typed)


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A directory as an unbounded source; at most files_per_batch new files a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class SeenKeys:
    """The durable store of seen keys: versions of a table, the latest of which counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path, -1

    def table(self) -> DataFrame | None:
        return None if self.version < 0 else self.spark.read.parquet(f"{self.path}/v={self.version}")

    def record(self, events: DataFrame, version: int) -> None:
        """Adds keys with their latest time; the same version again replaces itself, so replays are harmless."""
        from ..operators.dedup import record

        before = self.spark.read.parquet(f"{self.path}/v={version - 1}") if version > 0 else None
        record(before, events).write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self.version = version

    def exists(self, keys: DataFrame) -> DataFrame:
        table = self.table()
        return keys.limit(0) if table is None else keys.join(table.select("event_id", "event_type"), ["event_id", "event_type"], "left_semi")

    def size(self) -> int:
        table = self.table()
        return 0 if table is None else table.count()


class RecordingClient:
    """A downstream that writes requests to a table and answers each the same way."""

    def __init__(self, path: str, succeed: bool = True, response: str = "OK"):
        self.path, self.succeed, self.response = path, succeed, response

    def execute(self, requests: DataFrame, batch: int = 0) -> DataFrame:
        """Results of the requests (request_id, succeeded, response, retry_count); a replayed batch replaces its own rows."""
        requests.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return requests.select("request_id", F.lit(self.succeed).alias("succeeded"), F.lit(self.response).alias("response"), F.lit(0).alias("retry_count"))

    def received(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.path).parquet(self.path)
