import os

import pytest

from sparkseries.plans import scratch


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())


def test_shared_folder_and_clearing(spark):
    df = spark.range(10)
    assert scratch.cut(df).count() == 10 and scratch.stored(df, "t").count() == 10
    table = scratch.bucketed(df, "texts", "id")
    plan = table.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and table.count() == 10
    folder = scratch.shared_dir(spark).removeprefix("file://") + "/sparkseries"
    assert os.listdir(folder)
    scratch.clear_scratch(spark)
    assert not os.path.exists(folder)
