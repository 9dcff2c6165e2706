import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from symdex import config
from symdex.engine import Engine
from symdex.functions import queries, text
from symdex.operators import changes
from symdex.plans.catalog import search
from symdex.sources import chunker

INDEX = ("words", "grams", "sizes")


def test_engine_builds_and_repairs_its_index(spark, tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    for k in range(30):
        (root / f"m{k}.py").write_text(f"def call_{k}(x):\n    return load_user_{k}(x)\n")
    e = Engine(spark, root, str(tmp_path / "kb"), buckets=3)
    found = e.search("call", max_results=25)  # built by the first question; more than the text form shows
    assert len(found["results"]) == 25 and found["results"][0]["rank"] == 1
    assert len(e.search("call", max_results=3, budget=15, encoder=len)["results"]) == 0
    assert len(e.search_text("call", max_results=25).split("## ")) == 21
    index = {t: e.store.read(t) for t in INDEX}
    chunks = e.store.read("chunks")
    plain = sorted((r["chunk_id"], round(r["score"], 6)) for r in search(chunks, "load call_7", 8).collect())
    assert plain == sorted((r["chunk_id"], round(r["score"], 6)) for r in search(chunks, "load call_7", 8, index=index).collect())
    assert {r["file_path"][:2] for r in search(chunks, "call", 8, path_glob="m1*.py", index=index).collect()} == {"m1"}
    assert "PushedFilters: [In(term, [a,b])]" in index["words"].where("term in ('a', 'b')")._jdf.queryExecution().toString()
    # an update writes the touched bucket only, and what it replaced goes with the next one
    folder = tmp_path / "kb" / e.store.root.rpartition("/")[2]
    before = e.store._pointer()["tables"]["chunks"]["parts"]
    (root / "m3.py").write_text("import os\n\n\ndef call_other(x):\n    return x\n")
    e.apply(spark.createDataFrame([("m3.py", "upsert")], "path string, action string"))
    after = e.store._pointer()["tables"]["chunks"]["parts"]
    changed = [b for b in before if before[b] != after[b]]
    assert len(changed) == 1 and e.store.read("chunks").count() == 31 and (folder / before[changed[0]]).is_dir()
    e.rebuild_graph()
    assert not (folder / before[changed[0]]).exists()
    node = {r["name"]: r for r in e.store.read("nodes").collect()}
    assert node["m3"]["exports"] == ["call_other"] and node["m3"]["lines_of_code"] == 1 and node["m3.call_other"]["is_private"] is False
    e.store.export_json("nodes", str(tmp_path / "nodes"))
    assert spark.read.json(str(tmp_path / "nodes")).count() == len(node)
    e.apply(spark.createDataFrame([("../outside.py", "upsert"), ("m4.py", "delete")], "path string, action string"))
    assert e.store.read("chunks").count() == 30


@pytest.mark.parametrize("harm", ["contents", "table", "schema"])
def test_broken_and_older_indexes_are_built_anew(spark, tmp_path, harm):
    root = tmp_path / "project"
    root.mkdir()
    (root / "m.py").write_text("def call_other(x):\n    return x\n")
    e = Engine(spark, root, str(tmp_path / "kb"), buckets=2)
    e.analyze()
    folder = tmp_path / "kb" / e.store.root.rpartition("/")[2]
    if harm == "contents":
        for f in folder.rglob("*.parquet"):
            f.write_bytes(b"broken")
        for f in folder.rglob(".*.crc"):
            f.unlink()
    elif harm == "table":
        shutil.rmtree(folder / "words")
    else:
        (folder / "current.json").write_text('{"schema": 1}')
        for f in folder.glob(".current.json*"):
            f.unlink()
        assert "older" in e.status()["message"]
    assert e.search("call_other")["results"][0]["file"] == "m.py"


def test_watch_applies_a_burst_once(spark, tmp_path):
    root, log = tmp_path / "project", tmp_path / "log"
    root.mkdir()
    log.mkdir()
    (root / "a.py").write_text("import b\n\n\ndef one():\n    pass\n")
    e = Engine(spark, root, tmp_path / "kb", buckets=2)
    e.analyze()
    (root / "b.py").write_text("import a\n\n\ndef two():\n    pass\n")
    (log / "1.json").write_text("\n".join(json.dumps({"ts": f"2025-01-01T00:00:00.{k}00Z", "op": "modified", "path": "b.py"}) for k in range(8)))
    told = []
    stream = spark.readStream.schema("ts timestamp, op string, path string, dest_path string").json(str(log))
    q = e.watch(stream, tmp_path / "cp", debounce_s=0.3, cooldown_s=0.0, on_change=lambda d: told.append([r["path"] for r in d.collect()]), processingTime="500 milliseconds")
    try:
        assert e.status()["watching"]
        for _ in range(150):
            time.sleep(0.5)
            if told and e.store.metadata().get("graph_stale") is False:
                break
    finally:
        q.stop()
    assert told == [["b.py"]] and e.store.read("chunks").count() == 4 and e.store.read("nodes").where("name = 'b.two'").count() == 1


def test_config(tmp_path):
    assert config.load(tmp_path) == config.defaults(tmp_path)
    config.save({"local_path": str(tmp_path / "kb")}, tmp_path)
    config.save({"x": 1}, tmp_path)
    assert config.load(tmp_path) == {"local_path": str(tmp_path / "kb"), "x": 1} and config.base_folder(tmp_path).is_dir()
    (tmp_path / ".symdex" / "config.json").write_text("{broken")
    with pytest.warns(UserWarning):
        assert config.load(tmp_path) == config.defaults(tmp_path)
    config.save({"local_path": "y"}, tmp_path)
    assert config.load(tmp_path) == {"local_path": "y"} and (tmp_path / ".symdex" / "config.json.corrupted").exists()
    config.clear(tmp_path)
    assert config.load(tmp_path) == config.defaults(tmp_path)


def test_rows_and_back(spark):
    df = spark.createDataFrame([("a", ["x", 'y"z'], None, "d"), ("b", None, "P", None), ("c", [], "", "")], "chunk_id string, imports array<string>, parent_class string, docstring string")
    rows = {r["chunk_id"]: r for r in changes.to_rows(df).collect()}
    assert json.loads(rows["a"]["imports"]) == ["x", 'y"z'] and rows["b"]["imports"] == "[]" and rows["a"]["parent_class"] == ""
    again = {r["chunk_id"]: tuple(r)[1:] for r in changes.from_rows(changes.to_rows(df)).collect()}
    assert again == {"a": (["x", 'y"z'], None, "d"), "b": ([], "P", None), "c": ([], None, None)}
    broken = spark.createDataFrame([("{", "", None)], "imports string, parent_class string, docstring string")
    assert tuple(changes.from_rows(broken).first()) == ([], None, None)


def test_imports_pragmas_and_folding(spark):
    assert chunker.python_imports("import a; import b as c, d\nfrom .x import y; import z\n") == ["a", "b", "d", ".x", "z"]
    assert chunker.python_docstring("'use client'\n'''Says it.'''\nx = 1\n") == "Says it." and chunker.python_docstring("'use strict'\nx = 1\n") is None
    df = spark.createDataFrame([("Łódź āb Ñandú Привет, й",)], "t string")
    assert df.select(text.tokens(F.col("t"))).first()[0] == ["łodz", "ab", "nandu", "привет", "й"]
    assert queries.index_tokens("Łódź āb") == ["łodz", "ab"]


def test_privacy_and_async(spark):
    rows = [("_x", "python", "async def _x():", True, True), ("x", "python", "def x(asynch):", False, False), ("Load", "go", "func Load()", False, False), ("load", "go", "func load()", True, False), ("load", "rust", "pub async fn load()", True, True), ("A", "rust", "struct A", False, False), ("_a", "java", None, False, False), (None, None, None, False, False), ("f", "typescript", "export async function f()", False, True)]
    df = spark.createDataFrame(rows, "s string, l string, g string, p boolean, a boolean")
    assert df.where((text.is_private(F.col("s"), F.col("l")) != F.col("p")) | (text.is_async(F.col("g"), F.col("l")) != F.col("a"))).count() == 0


def test_nearest_words_by_a_model():
    vectors = {"cat": (1, 0.1), "dog": (0.9, 0.2), "kitten": (1, 0), "car": (0, 1), "void": (0, 0)}
    near = queries.embedded(lambda texts: [vectors[t] for t in texts], ["cat", "dog", "car", "void"])
    assert [w for w, _ in near("kitten", {"kitten"})] == ["cat", "dog"] and near("void", set()) == []
    assert queries.expand_query("kitten", nearest=near) == "kitten cat dog"
    assert len(queries.vocabulary()) == len(set(queries.vocabulary())) > 100
