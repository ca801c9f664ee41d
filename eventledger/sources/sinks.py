"""Tables and files the jobs write."""

from pyspark.sql import DataFrame, SparkSession

from ..schemas import STORE
from ..streaming.manifest import BATCH, Files
from ..streaming.store import BUCKET, batches_of

TAB = "\t"


def create_store(spark: SparkSession, name: str, path: str) -> None:
    """Name the orders that ``PersistJob`` writes to ``path`` as a SQL table; does nothing where it exists.

    Call ``refresh_store`` after batches were added. The bloom filters and the
    order within files come from the writer, see ``streaming.store.write_orders_table``.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORE.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {BATCH} BIGINT, {BUCKET} INT) USING parquet "
        f"PARTITIONED BY ({BATCH}, {BUCKET}) LOCATION '{path}'"
    )


def refresh_store(spark: SparkSession, name: str, path: str) -> None:
    """The named table shows what the commits of the store hold now: new folders, and none that were merged."""
    shown = {int(r[0].split("/")[0].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    held = batches_of(spark, path)
    for folder in sorted(shown - held):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({BATCH}={folder})")
    files = Files(spark)
    for folder in sorted(held - shown):
        buckets = [n.split("=")[1] for n in files.names(f"{path}/{BATCH}={folder}") if n.startswith(f"{BUCKET}=")]
        parts = " ".join(f"PARTITION ({BATCH}={folder}, {BUCKET}={b})" for b in buckets)
        if parts:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a single JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_tsv(result: DataFrame, path: str) -> None:
    """A small result table as one tab-separated file with a header."""
    result.coalesce(1).write.mode("overwrite").csv(path, sep=TAB, header=True)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep=TAB, header=True, schema=schema)
