"""Ordered folds: a state machine over the rows of each key in order, one row at a time in bounded memory."""

from __future__ import annotations

import base64
import os
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.shared import delete, fresh_dir

#: Rows that one task sorts and folds of a hot key, about; a key with more is a chain of such spans.
SPAN_ROWS = 1_000_000
#: Rows that one task of a fold sorts, about, where the number of tasks is asked for.
TASK_ROWS = 400_000
#: Hot keys whose chains run side by side.
CHAINS = 8
_PART, _STATE = "_fold_part", "_fold_state"


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, object]], inputs: list[str], out: str, spans: bool = False, tasks: int | None = None) -> DataFrame:
    """df with the column that step makes: step(state, the row's inputs) -> (state, value); each key begins with start().

    Rows are dealt by key and sorted on disk where they must be; the fold passes over sorted Arrow batches and holds one
    key's state at a time. Keys and inputs reach step as Python values, nulls as None; all columns of df pass through as
    Arrow, unchanged. out is "name type".

    spans: keys may hold any share of the rows. They are counted first, and those of more than SPAN_ROWS rows are
    written to the shared folder in spans by order, which many tasks sort; then span after span of a key is folded, each
    from the state that the one before has left. So no task reads, sorts or holds more than a span, and nothing but a
    state goes through the driver. The result is the same.

    tasks: how many tasks rows are dealt over, as by tasks_for(); Spark settles it by compressed size else.
    """
    made_field = StructType.fromDDL(out).fields[0]
    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):  # workers import this package wherever the driver runs from
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    run = _runner(df, keys, start, step, inputs, made_field)
    whole = lambda rows: dealt(rows, keys, tasks).sortWithinPartitions(*keys, *order).mapInArrow(run(None), StructType([*df.schema.fields, made_field]))
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_PART)).filter(F.col(_PART) > SPAN_ROWS).collect() if spans else []  # one key a span at most
    if not hot:
        return whole(df)
    part = reduce(lambda found, i: F.when(_is_key(keys, hot[i]), F.lit(i)).otherwise(found), range(len(hot)), F.lit(None).cast("int"))
    chained = _chained(df.withColumn(_PART, part).filter(F.col(_PART).isNotNull()), order, sum(-(-r[_PART] // SPAN_ROWS) for r in hot), run, made_field)
    return chained.unionByName(whole(df.withColumn(_PART, part).filter(F.col(_PART).isNull()).drop(_PART)))


def tasks_for(df: DataFrame) -> int | None:
    """How many tasks sort df without spilling; None where it is small. Rows that compress well are more than their shuffled size tells."""
    rows = df.count()
    return None if rows <= TASK_ROWS else max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    return rows.repartition(*keys) if tasks is None else rows.repartition(tasks, *keys)


def _is_key(keys: list[str], row) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys])


def _runner(df: DataFrame, keys: list[str], start: Callable, step: Callable, inputs: list[str], made_field: StructField) -> Callable:
    """A function of a state in text, or None, to one that folds sorted batches; from a text, batches end with the state's, in the column _STATE."""
    key_at, input_at = [df.columns.index(k) for k in keys], [df.columns.index(c) for c in inputs]
    kind = to_arrow_type(made_field.dataType)

    def run(before: str | None) -> Callable:
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state = pickle.loads(base64.b64decode(before)) if before else (None, None)
            held = None
            for batch in batches:
                made = []
                owns = zip(*(batch.column(i).to_pylist() for i in key_at), strict=True)
                rows = zip(*(batch.column(i).to_pylist() for i in input_at), strict=True)
                for own, row in zip(owns, rows, strict=True):
                    if own != key:
                        key, state = own, start()
                    state, value = step(state, row)
                    made.append(value)
                columns, names = [*batch.columns, pa.array(made, kind)], [*batch.schema.names, made_field.name]
                if before is None:
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    continue
                if held is not None:
                    yield pa.RecordBatch.from_arrays([*held[0], pa.nulls(len(held[0][0]), pa.string())], names=[*held[1], _STATE])
                held = (columns, names) if made else held
            if held is not None:  # the state stands in the span's last row
                left = base64.b64encode(pickle.dumps((key, state))).decode()
                yield pa.RecordBatch.from_arrays([*held[0], pa.array([None] * (len(held[0][0]) - 1) + [left], pa.string())], names=[*held[1], _STATE])

        return fold

    return run


def _chained(rows: DataFrame, order: list[str], n: int, run: Callable, made_field: StructField) -> DataFrame:
    """The fold over rows of hot keys, numbered by _PART, span after span of each key."""
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "fold")
    rows.repartitionByRange(n, _PART, *order).sortWithinPartitions(_PART, *order).write.partitionBy(_PART).parquet(f"{path}/spans")
    schema = StructType([f for f in rows.schema.fields if f.name != _PART])
    made = StructType([*schema.fields, made_field, StructField(_STATE, StringType())])
    files: dict[str, list[str]] = defaultdict(list)
    for f in spark.read.schema(rows.schema).parquet(f"{path}/spans").inputFiles():
        files[f.rpartition("/")[0]].append(f)

    def chain(at: tuple[int, str]) -> list[str]:
        state, done = base64.b64encode(pickle.dumps((None, None))).decode(), []
        for f in sorted(files[at[1]], key=lambda f: f.rpartition("/")[2]):  # files are named by their task's number
            seen = Observation()
            out = spark.read.schema(schema).parquet(f).coalesce(1).mapInArrow(run(state), made)
            done.append(f"{path}/out/{at[0]}-{len(done)}")
            out.observe(seen, F.max(_STATE).alias("state")).write.parquet(done[-1])
            state = seen.get["state"] or state
        return done

    with ThreadPoolExecutor(CHAINS) as pool:
        done = [p for own in pool.map(chain, enumerate(files)) for p in own]
    delete(spark, f"{path}/spans")
    return spark.read.schema(StructType([*schema.fields, made_field])).parquet(*done)
