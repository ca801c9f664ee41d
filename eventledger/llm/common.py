"""Small helpers shared by the operators of this folder."""

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventledger.session import prepare


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its content; rows that repeat in full share the name."""
    return F.md5(
        F.concat(
            F.when(F.col(doc_id).isNull(), F.lit("-")).otherwise(F.col(doc_id).cast("string")),
            F.when(F.col(text).isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col(text))),
        )
    )


def share(spark: SparkSession, value) -> Callable:
    """Sends a value to the executors once; the returned function gives it in a task.

    It travels pickled by value, like the functions of this folder.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def arrow_map(
    df: DataFrame,
    schema: str,
    rows: Callable[[Iterable], Iterator[tuple]],
) -> DataFrame:
    """``rows`` gets the columns of a batch as Python lists and yields result tuples.

    ``rows`` is a factory: called once per task, it returns the function that
    handles one batch, so that tables are prepared once per task.
    """
    target = pa.schema(
        [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in _parsed(df, schema)]
    )

    def run(batches):
        handle = rows()
        for batch in batches:
            out = list(handle(*[c.to_pylist() for c in batch.columns]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i] for r in out], type=target.field(i).type)
                    for i in range(len(target))
                ],
                schema=target,
            )

    return df.mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
}


def _parsed(df: DataFrame, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields
