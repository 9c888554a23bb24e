import os
from types import SimpleNamespace

import pytest

from corpusloom.llm import common


def session_of(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder, set=lambda key, value: None)
    own = SimpleNamespace(get=lambda key: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: own))


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn", "k8s://x"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(session_of(master))
    assert common.shared_dir(session_of(master, "hdfs:///shared/")) == "hdfs:///shared"


def test_local_mode_has_a_folder_of_its_own():
    assert os.path.isdir(common.shared_dir(session_of("local[4]")).removeprefix("file://"))


def test_written_tables_go_when_dropped(spark):
    a = common.written(spark.range(5), "test")
    path = a.written_to.removeprefix("file://")
    assert a.count() == 5 and os.path.isdir(path)
    common.dropped(a)
    assert not os.path.exists(path)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, B_ int")
    assert common.fresh(df, "A", "b", "b_", "c") == ["A_", "b", "b__", "c"]
