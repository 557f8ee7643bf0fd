from types import SimpleNamespace

import pytest

from streetloom.plans.shared import shared_dir


def test_no_folder_of_one_machine_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)
    context.getCheckpointDir = lambda: "hdfs://host/tables"
    assert shared_dir(spark) == "hdfs://host/tables"
