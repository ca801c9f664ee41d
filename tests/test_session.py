"""Where intermediate tables go, and when they are built again."""

from types import SimpleNamespace

import pytest

from eventledger import session


def named_session(master, folder=None):
    settings = SimpleNamespace(get=lambda name, default=None: folder if name == "spark.checkpoint.dir" else default)
    context = SimpleNamespace(master=master, applicationId=f"app {master}", getConf=lambda: settings)
    return SimpleNamespace(conf=settings, sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,3000]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(named_session(master))
    assert session.shared_folder(named_session(master, "hdfs:///work")) == "hdfs:///work"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_a_local_session_may_use_a_temporary_one(master):
    first = session.shared_folder(named_session(master))
    assert first == session.shared_folder(named_session(master))


def test_a_stored_table_follows_its_input(spark, folder):
    source = f"{folder}/things.parquet"
    read = lambda: session.table_of(
        spark, "things", folder, ["things"], lambda: spark.read.parquet(source)
    )
    spark.range(3).write.parquet(source)
    assert read().count() == 3
    spark.range(5).write.mode("append").parquet(source)
    assert read().count() == 8
