import datetime as dt
import json

from siltstone.__main__ import main
from siltstone.sinks.tables import FILES, Store
from siltstone.streaming import files as S


def test_stream_keeps_the_newest_record_of_each_path(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    day = lambda d: dt.datetime(2024, 1, d)

    def put(*rows):
        spark.createDataFrame(list(rows), FILES).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = S.keep_newest(spark.readStream.schema(FILES).parquet(source), store, str(tmp_path / "checkpoint"))
        q.awaitTermination()
        return {r.path: r.content_hash for r in store.read("files").collect()}

    put(("a", "r", "1", 10, 1, day(1), None), ("b", "r", "1", 10, 1, None, None), ("a", "r", "1", 10, 1, day(1), None))
    assert run() == {"a": "1", "b": "1"}
    put(("a", "r", "0", 5, 1, day(2), None), ("b", "r", "2", 20, 1, day(3), "bad"), ("c", None, "3", 1, 1, day(3), None))
    assert run() == {"a": "1", "b": "2", "c": "3"}
    assert run() == {"a": "1", "b": "2", "c": "3"}
    q = S.counts_by_window(spark.readStream.schema(FILES).parquet(source)).writeStream.format("memory").queryName("per_day").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from per_day").first()[0] == 5


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "one.py").write_text('def load(x):\n    """Load the table."""\n    return save(x)\n\n\ndef save(x):\n    return x\n')
    root = str(tmp_path)

    def run(*argv):
        assert main([argv[0], root, *argv[1:]], spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert run("index")[0]["new"] == 1
    assert {r["table"]: r["n"] for r in run("status")}["units"] == 4
    assert run("search", "load table", "--limit", "2")[0]["path"] == "one.py"
    assert [r["label"] for r in run("callees", "function:one.py:one.load")] == ["one.save"]
    run("map")
    graph = str(tmp_path / "graph-out" / "graph.json")
    assert run("explain", graph, "load")[0]["edge_type"] in ("calls", "defines")
    assert len(run("path", graph, "load", "save")) == 1
    assert run("query", graph, "load", "--limit", "3")
