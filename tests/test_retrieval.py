import sqlite3

import pytest
from pyspark.sql import functions as F

from symdex.functions.queries import parse_query
from symdex.operators import assemble, changes, graph, lexical, rank, vectors

TEXTS = ["load the user file", "load load user profile and more words here", "fetch remote url", "café user", "", "user file file user file"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


@pytest.mark.parametrize("query, match", [("user", "user"), ("load file", "load OR file"), ('"user file"', '"user file"'), ("cafe", "cafe")])
def test_bm25_is_that_of_fts5(docs, query, match):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, body)")
    con.executemany("insert into t values (?, ?)", list(enumerate(TEXTS)))
    want = {i: round(-s, 6) for i, s in con.execute("select id, bm25(t) from t where t match ?", (match,))}
    got = {r["id"]: round(r["score"], 6) for r in lexical.bm25(docs, F.col("text"), parse_query(query)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    p = lexical.postings(docs, "id", F.col("text"))
    totals = docs.select(F.size(lexical.tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))
    stored = {r["id"]: round(r["score"], 6) for r in lexical.bm25_postings(p, totals, parse_query(query)).collect()}
    assert stored == pytest.approx(want, abs=1e-6)


def test_stored_postings_prune(spark, docs, tmp_path):
    lexical.write_postings(lexical.postings(docs, "id", F.col("text")), tmp_path / "p", files=4)
    plan = spark.read.parquet(str(tmp_path / "p")).where(F.col("term").isin("user"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [user])]" in plan or "EqualTo(term,user)" in plan


def test_substring(docs):
    got = {r["id"] for r in lexical.substring(docs, F.col("text"), "ER FI").collect()}
    assert got == {0, 5}
    assert lexical.substring(docs, F.col("text"), "us").count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    b = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = {r["id"]: r["score"] for r in rank.fuse([a, b]).collect()}
    assert got["b"] == pytest.approx(1 / 61 + 1 / 62) and got["a"] == pytest.approx(1 / 61)


def test_boost_rerank_diversify(spark):
    scores = spark.createDataFrame([("x", 1.0), ("y", 0.5), ("z", 0.5)], "id string, score double")
    mods = spark.createDataFrame([("x", "m"), ("y", "n"), ("z", "o")], "id string, module string")
    edges = spark.createDataFrame([("n", "m")], "src string, dst string")
    got = {r["id"]: r["score"] for r in rank.boost(scores, mods, edges).collect()}
    assert got == pytest.approx({"x": 1.0, "y": 0.5 + 0.5 / 61, "z": 0.5})
    row = spark.createDataFrame([("x", 0.5, "load", "A.load", "def load(file)", "Reads a file.")], "id string, score double, symbol string, qualified_name string, signature string, docstring string")
    assert rank.rerank(row, "load file").first()["score"] == pytest.approx(0.5 + 0.05 + 0.03 + 0.01 + 0.02 + 0.01)
    many = spark.createDataFrame([("a", 0.9, "f"), ("b", 0.8, "f"), ("c", 0.7, "g")], "id string, score double, file string")
    assert {r["id"]: r["score"] for r in rank.diversify(many, "file").collect()} == {"a": 0.9, "b": 0.65, "c": 0.7}


def test_pack_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, 3), ("q", 2, 9), ("q", 3, 2)], "g string, o int, c int")
    got = [(r["o"], r["included"], r["running"]) for r in assemble.pack(df, "g", "o", "c", 5).orderBy("o").collect()]
    assert got == [(1, True, 3), (2, False, 3), (3, True, 5)]


def test_fetch_clamps(spark):
    files = spark.createDataFrame([("f", "a\r\nb\nc\n")], "file_path string, content string")
    asked = spark.createDataFrame([(0, "f", 2, 2, 1, None), (1, "f", 9, 9, 0, 0), (2, "g", 1, 1, 0, 0), (3, "f", -3, 99, 5, 5)], "idx int, file_path string, start_line int, end_line int, context_before int, context_after int")
    got = {r["idx"]: r["content"] for r in assemble.fetch(asked, files).collect()}
    assert got == {0: "a\nb", 1: "", 2: None, 3: "a\nb\nc\n"}


def test_graph(spark):
    rows = [("m1", "module", "src/pkg/a.py", "a", 1, 10, ["b", "os"]), ("m2", "module", "src/pkg/b.py", "b", 1, 4, []), ("f1", "function", "src/pkg/b.py", "run", 2, 3, []), ("f2", "function", "src/pkg/b.py", "_hid", 3, 4, []), ("k", "method", "src/pkg/b.py", "m", 3, 4, [])]
    c = spark.createDataFrame(rows, "chunk_id string, chunk_type string, file_path string, symbol string, start_line int, end_line int, imports array<string>").withColumn("signature", F.lit("s"))
    assert [(r["src"], r["dst"]) for r in graph.edges(c).collect()] == [("pkg.a", "pkg.b")]
    assert {r["name"] for r in graph.nodes(c).collect()} == {"pkg.a", "pkg.b", "pkg.b.run", "pkg.b._hid"}
    assert graph.stats(c).first()[:] == (2, 2, 1)
    assert [(r["name"], r["symbol"]) for r in graph.context(c).collect()] == [("pkg.a", "run")]


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "chunk_id string, content_hash string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "chunk_id string, content_hash string")
    assert {r[0]: r[1] for r in changes.manifest_diff(old, new).collect()} == {"a": "deleted", "b": "unchanged", "c": "updated", "d": "added"}
    assert {tuple(r) for r in changes.upsert(old, new).collect()} == {("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")}


def test_nearest_is_brute_force(spark):
    import numpy as np

    m = np.random.default_rng(1).normal(size=(60, 8))
    m[5] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.nearest(df, df.where("vec_id % 10 = 0"), 3).collect()}
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in range(0, 60, 10):
        s = u @ u[q]
        s[q] = -9
        assert [got[q, r] for r in (1, 2, 3)] == list(np.argsort(-s)[:3])
