import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from symdex.engine import Engine
from symdex.sources import chunker, files
from symdex.streaming import events

PY = '''"""Module doc."""
import os
from .near import thing
LIMIT = 3


@cache
def total(items):
    """Adds up."""
    def inner(x):
        return x
    return sum(items)


class Store(Base):
    kind = "x"

    def __init__(self, path):
        self.path = path

    async def load(self):
        return 1
'''


def test_python_chunks():
    got = {c.qualified or "<module>": c for c in chunker.chunk_text("a/repo.py", PY)}
    assert list(got) == ["<module>", "total", "Store", "Store.__init__", "Store.load"]
    assert got["<module>"].imports == ["os", ".near"] and "LIMIT = 3" in got["<module>"].content and got["<module>"].docstring == "Module doc."
    assert (got["total"].first, got["total"].last, got["total"].docstring) == (7, 12, "Adds up.") and got["total"].signature.startswith("@cache")
    assert got["Store"].content == 'class Store(Base):\n    kind = "x"' and got["Store.load"].parent == "Store"


@pytest.mark.parametrize(
    "path, text, names",
    [
        ("a.go", "package a\n\ntype T struct { x int }\n\nfunc (t *T) Load() int {\n\treturn 1\n}\n", [("module", "a"), ("function", "Load")]),
        ("a.rs", "use x::y;\nimpl A { fn b() {} }\npub struct A { x: u8 }\nfn c() { }\n", [("module", "a"), ("class", "A"), ("function", "c")]),
        ("a.js", "import a from 'a';\nexport class B {\n  x = 1;\n  get y() { return `}`; }\n}\nfunction z() {}\n", [("module", "a"), ("class", "B"), ("method", "y"), ("function", "z")]),
        ("A.java", "package p;\nclass A {\n  A() {}\n  @X int b(int c) { return '}'; }\n}\n", [("module", "A"), ("class", "A"), ("method", "A"), ("method", "b")]),
        ("a.cpp", "int main() {}", []),
        ("a.py", "  \n", []),
        ("b.py", "def f(:\n    return (\n", [("function", "f")]),
    ],
)
def test_other_chunks(path, text, names):
    assert [(c.kind, c.symbol) for c in chunker.chunk_text(path, text)] == names


def test_long_functions_come_as_blocks():
    body = "".join(f"    x{i} = {i}\n" for i in range(120))
    made = [c for c in chunker.chunk_text("a.py", f"def big():\n{body}    if x1:\n        pass\n{body}") if c.kind == "function"]
    assert [c.symbol for c in made] == ["big:blk/0", "big:blk/1", "big:blk/2"] and len({c.chunk_id for c in made}) == 3
    assert "block 2/3: conditional" in made[1].content


def test_same_names_get_lines():
    ids = [c.chunk_id for c in chunker.chunk_text("a.py", "def f():\n    pass\n\n\ndef f():\n    pass\n")]
    assert ids == ["a.py::f", "a.py::f:5"]


@pytest.mark.parametrize("lines, path, hit", [(["*.log"], "a/b.log", True), (["/top"], "a/top", False), (["foo/"], "foo/x.py", True), (["*.py", "!keep.py"], "keep.py", False), (["a/**/b"], "a/x/y/b", True), (["# c", ""], "c", False)])
def test_ignore_rules(spark, lines, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(files.ignored(F.col("p"), files.ignore_rules(lines))).first()[0] is hit


def test_engine_incremental(spark, tmp_path):
    root, base = tmp_path / "project", tmp_path / "kb"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.py").write_text("def hidden(): pass\n")
    (root / "src" / "auth.py").write_text("import store\n\n\ndef verify_token(token):\n    '''Checks a token.'''\n    return token\n")
    (root / "src" / "store.py").write_text("LIMIT = 1\n\n\ndef load_user(name):\n    return name\n")
    e = Engine(spark, root, base, buckets=4, auto_build=False)
    assert e.status()["indexed"] is False
    with pytest.raises(RuntimeError):
        e.search("x")
    r = e.analyze()
    assert (r["files_analyzed"], r["files_added"], r["chunks_total"]) == (2, 2, 4)
    found = e.search("verify token", max_results=2)
    assert found["results"][0]["ref"] == "src/auth.py:4" and "return token" in found["results"][0]["content"]
    assert "verify_token" in e.search_text("verify token")
    assert [x["neighbour"] for x in e.module_context("src/auth.py").collect()] == ["store"]
    assert e.module_text("src/auth.py") == "# src/auth.py\nimports: store\nstore: load_user\nfunction verify_token at src/auth.py:4: def verify_token(token):"
    time.sleep(1.1)
    (root / "src" / "store.py").write_text("LIMIT = 1\n\n\ndef load_user(name):\n    return name + 'x'\n\n\ndef drop_user(name):\n    pass\n")
    os.remove(root / "src" / "auth.py")
    r = e.analyze()
    assert (r["files_added"], r["files_modified"], r["files_deleted"], r["chunks_added"], r["chunks_updated"], r["chunks_deleted"], r["chunks_total"]) == (0, 1, 1, 1, 1, 2, 3)
    assert e.file_info("src/store.py")["symbols"][1]["symbol"] == "load_user"
    assert e.project_symbols().first()["symbols"] == 2
    log = tmp_path / "log"
    log.mkdir()
    (root / "src" / "new.py").write_text("def fresh():\n    pass\n")
    (log / "1.json").write_text(json.dumps({"ts": "2025-01-01T00:00:00", "op": "created", "path": "src/new.py"}) + "\n" + json.dumps({"ts": "2025-01-01T00:00:01", "op": "deleted", "path": "src/store.py"}) + "\n")
    stream = spark.readStream.schema("ts timestamp, op string, path string, dest_path string").json(str(log))
    told = []
    e.watch(stream, tmp_path / "cp", debounce_s=0, on_change=lambda d: told.append([tuple(r) for r in d.select("path", "action").collect()]), availableNow=True).awaitTermination(90)
    assert {x["file_path"] for x in e.store.read("chunks").collect()} == {"src/new.py"}
    assert told == [[("src/new.py", "upsert"), ("src/store.py", "delete")]] and e.store.metadata()["graph_stale"] is False
    assert e.search("load user")["results"] == [] and e.search("fresh")["results"][0]["file"] == "src/new.py"
    assert [r["chunk_id"] for r in e.get_chunks(["src/new.py::fresh", "none", "src/new.py::fresh"]).collect()] == ["src/new.py::fresh"]
    assert e.module_context("src/new.py").first()["symbol"] == "fresh"  # no neighbours: its own first symbol


def test_debounce_and_cooldown(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, t + dt.timedelta(milliseconds=ms), "p") for i, ms in enumerate((0, 300, 800, 1200))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, path string")
    assert [r["event_id"] for r in events.debounce(df, "path", "ts").orderBy("ts").collect()] == [1, 3]
    assert [r["ts"] for r in events.cooldown(df, "path", "ts", 0.7).orderBy("ts").collect()] == [rows[0][1], rows[2][1]]


def test_session_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for k, times in enumerate((["00:00:00.0", "00:00:00.3", "00:00:05.0"], ["01:00:00.0"], ["02:00:00.0"])):
        (log / f"{k}.json").write_text("\n".join(json.dumps({"ts": f"2025-01-01T{x}00Z", "path": "a"}) for x in times))
        os.utime(log / f"{k}.json", (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema("ts timestamp, path string").option("maxFilesPerTrigger", 1).json(str(log))
    q = events.session_stream(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("bursts").where("ts < '2025-01-01 00:30:00'").collect()) == [1, 2]


def test_move_without_target(spark):
    df = spark.createDataFrame([(1, None, "moved", "a", None), (2, None, "moved", "a", "b")], "event_id long, ts timestamp, op string, path string, dest_path string")
    assert sorted((r["event_id"], r["path"], r["action"]) for r in events.actions(df).collect()) == [(1, "a", "delete"), (2, "a", "delete"), (2, "b", "upsert")]


def test_debounce_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text("\n".join(json.dumps({"ts": f"2025-01-01T00:00:0{k}Z", "path": p}) for k, p in enumerate("aab")))
    stream = spark.readStream.schema("ts timestamp, path string").json(str(log)).withColumn("action", F.lit("upsert"))
    q = events.debounce_stream(stream, gap_s=0.3).writeStream.format("memory").queryName("quiet").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for k in range(60):
            time.sleep(0.5)
            (log / f"x{k}.json").write_text("")
            if spark.table("quiet").count() == 2:
                break
    finally:
        q.stop()
    assert {(r["path"], r["ts"].second) for r in spark.table("quiet").collect()} == {("a", 1), ("b", 2)}


def test_stream_sessions_are_those_of_the_batch(spark, tmp_path):
    from symdex.plans import catalog

    t = dt.datetime(2025, 1, 1)
    last = t + dt.timedelta(days=90)
    ms = lambda x, k: x + dt.timedelta(milliseconds=k)
    rows = [(1, t, "a"), (2, ms(t, 300), "./a"), (2, ms(t, 300), "./a"), (3, ms(t, 5000), "a"), (4, ms(last, -400), "b"), (5, last, "b"), (5, last, "b"), (6, ms(last, -86_400_000), "only late"), (7, None, "a"), (8, t, None)]
    spark.createDataFrame([(i, x, "modified", p, None, x) for i, x, p in rows], "event_id long, ts timestamp, op string, path string, dest_path string, received_at timestamp").write.parquet(str(tmp_path / "file_events.parquet"))
    got = sorted((r["path"], r["ts"], r["n"]) for r in catalog.stream_sessions(spark, str(tmp_path)).collect())
    assert got == [("a", ms(t, 300), 2), ("a", ms(t, 5000), 1), ("b", last, 2), ("only late", ms(last, -86_400_000), 1)]
    once = events.once(catalog.read(spark, str(tmp_path), "file_events"))
    batch = once.groupBy(F.session_window("ts", "500 milliseconds"), "path").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    assert got == sorted((r["path"], r["ts"], r["n"]) for r in batch.collect())
