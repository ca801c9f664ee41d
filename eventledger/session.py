"""Session settings the package relies on, and the shared scratch folder."""

import hashlib
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Set at run time on any session handed to us; results depend on them.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # of two equal keys in a JSON object the last one wins
    "spark.sql.variant.allowDuplicateKeys": "true",
    # what a Python worker holds at a time: batches of long texts are cut by their size
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def prepare(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # as many partitions as cores: merging small ones would leave cores idle
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # a test table is read by a single task; a broadcast join would keep the rest
        # of the query in that task
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .config("spark.sql.adaptive.localShuffleReader.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is named, a temporary folder serves a session whose master is
    local. On a cluster each executor would write to a disk of its own, so that
    is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="eventledger-")
    return _own_folders[app]


def run_folder(spark: SparkSession, *parts: str) -> str:
    """A folder of this application below the shared one."""
    return "/".join([shared_folder(spark).rstrip("/"), spark.sparkContext.applicationId, *parts])


_tables: dict[tuple[str, str, str], str] = {}


def input_version(spark: SparkSession, path: str) -> str:
    """Changes when a file below ``path`` is added, removed or rewritten."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return ""
    files, seen = system.listFiles(root, True), []
    while files.hasNext():
        file = files.next()
        seen.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def _as_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def table_of(
    spark: SparkSession, name: str, sf_dir: str, inputs: Sequence[str], build, write=_as_parquet
) -> DataFrame:
    """Write ``build()`` once per application as a Parquet table and read it back."""
    return spark.read.parquet(folder_of(spark, name, sf_dir, inputs, build, write))


def folder_of(spark: SparkSession, name: str, sf_dir: str, inputs: Sequence[str], build, write=_as_parquet) -> str:
    """Where ``write`` has put ``build()``, once per application.

    Used for what in production is a stored table (the two record logs, the
    orders) rather than something recomputed by each reader. Built again when
    one of its ``inputs`` has changed.
    """
    root = sf_dir.rstrip("/")
    version = ":".join(input_version(spark, f"{root}/{i}.parquet") for i in inputs)
    where = (spark.sparkContext.applicationId, name, f"{root} {version}")
    if where not in _tables:
        tag = hashlib.md5(where[2].encode()).hexdigest()[:12]
        path = run_folder(spark, f"{name}-{tag}")
        write(build(), path)
        _tables[where] = path
    return _tables[where]
