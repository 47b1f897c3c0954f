from pathlib import Path

import pytest

from weftgraph import runtime


def test_tables_go_when_released(spark):
    t = runtime.cut(spark.range(5))
    path = Path(runtime._written[-1].removeprefix("file://"))
    assert t.count() == 5 and path.exists()
    runtime.release(spark)
    assert not path.exists()


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())
