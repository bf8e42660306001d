from pathlib import Path
from types import SimpleNamespace

from driftspark import runtime


def test_intermediate_tables_go_when_the_caller_is_done(spark):
    table = runtime.materialize(spark.range(5), "numbers")
    folder = Path(runtime.scratch_dir(spark).removeprefix("file:"))
    assert table.count() == 5 and any(p.name.startswith("numbers-") for p in folder.iterdir())
    assert folder.parent == Path(spark.conf.get("spark.checkpoint.dir"))
    kept = runtime.scratch_dir(spark)
    try:
        runtime.release(spark)
        assert not folder.exists()
    finally:
        assert runtime.scratch_dir(spark) == kept


def test_shared_folder_without_the_setting():
    settings = {"spark.sql.warehouse.dir": "hdfs://store/warehouse"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: settings.get(name, default)))
    assert runtime.shared_dir(session) == "hdfs://store/warehouse/_scratch"
    settings["spark.checkpoint.dir"] = "hdfs://store/shared/"
    assert runtime.shared_dir(session) == "hdfs://store/shared"
