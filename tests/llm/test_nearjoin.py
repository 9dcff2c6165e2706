import itertools
import random

import pytest
from pyspark.sql import functions as F

from symdex.llm import nearjoin as N


def brute(rows, t=0.7):
    sets = {}
    for i, text in rows:
        tokens = N.TOKEN.findall(text or "")
        if i is not None and len(tokens) >= 60:
            sets[i] = {tuple(tokens[k : k + 4]) for k in range(len(tokens) - 3)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def corpus(n=60, seed=1, words=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"word{rng.randrange(words)}" for _ in range(rng.choice((58, 62, 90, 200)))]
        for k in range(rng.choice((1, 1, 2, 4))):
            copy = list(base)
            for _ in range(k * rng.choice((0, 1, 3, 8))):
                copy[rng.randrange(len(copy))] = f"other{rng.randrange(99)}"
            rows.append((f"d{i:03d}{k}", rng.choice((" ", "\n", "  ")).join(copy)))
    return rows + [("null", None), ("", "x"), (None, "y " * 70), rows[0]]


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, content string")
    return {(r["id_a"], r["id_b"]) for r in N.similar(df.where("content is not null and id is not null"), **kw).collect()}


@pytest.mark.parametrize("bucket", [1000, 6])
def test_all_pairs_whatever_the_bucket(spark, bucket):
    rows = corpus()
    want = brute([r for r in dict(rows).items()])
    assert len(want) > 20 and found(spark, rows, bucket=bucket) == want


def test_crowded_runs_go_deeper(spark):
    head = [f"LongSharedName{k}" for k in range(40)]
    rng = random.Random(4)
    rows = [(f"c{i:02d}", " ".join(head + [f"w{rng.randrange(12)}" for _ in range(30)])) for i in range(30)]
    assert found(spark, rows, bucket=8) == brute(rows)


def test_frequent_runs_are_spread_over_tasks(spark, monkeypatch):
    head = [f"LongSharedNameOfAll{k}" for k in range(5)]
    rng = random.Random(6)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(65)]
        rows += [(f"c{i:03d}a", " ".join(head + base)), (f"c{i:03d}b", " ".join(head + base[:-3] + ["x", str(i)]))]
    monkeypatch.setattr(N, "SAMPLE", 1)
    df = spark.createDataFrame(rows, "id string, content string")
    first = N.prefixes(df, 0.7)
    hot = N.frequent(first, 4)
    assert len(hot) >= 2 and found(spark, rows, bucket=4) == brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = N.candidates(N.marked(first, hot), 0.7, 4).where("run is not null").withColumn("task", F.spark_partition_id())
        one = out.where(F.col("run") == hot[0]).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in one) == 80 and max(r["count"] for r in one) < 40  # all rows of the run, in several tasks


def test_classes_whose_short_names_collide(spark, monkeypatch):
    rows = corpus(20, seed=3)
    real = N.members

    def colliding(df, collided=frozenset()):
        who = real(df, collided)
        return who if collided else who.withColumn("key", F.lit(7).cast("long"))

    monkeypatch.setattr(N, "members", colliding)
    assert found(spark, rows) == brute(list(dict(rows).items()))


def test_voronoi_loses_no_pair(spark):
    rng = random.Random(5)
    rows = []
    for c in range(4):
        base = [f"c{c}w{k}" for k in range(80)]
        rows += [(c * 100 + i, [b if rng.random() > 0.03 else f"x{rng.randrange(50)}" for b in base]) for i in range(20)]
    runs = N.Runs()
    state = spark.createDataFrame([("r", k, bytearray(runs.of(w).tobytes()), True) for k, w in rows], "region string, key long, runs binary, core boolean")
    got = {(r["a"], r["b"]) for r in N.voronoi(state, 0.7, bucket=15, pivots=6, levels=2).collect()}
    sets = {k: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for k, w in rows}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}


def test_large_class_is_a_star_and_keeps_links(spark):
    text = " ".join(f"t{k}" for k in range(100))
    rows = [(f"a{i:02d}", text) for i in range(20)] + [("z", text.replace("t50", "u"))]
    got = found(spark, rows)
    assert {(a, b) for a, b in got if b != "z"} == {("a00", f"a{i:02d}") for i in range(1, 20)} and ("a00", "z") in got
    g = {r["id"]: r for r in N.groups(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert len(g) == 21 and {r["group_id"] for r in g.values()} == {"a00"} and g["z"]["n_links"] == 1 and g["a05"]["class_size"] == 20


def test_large_class_of_other_layouts_is_paired_in_full(spark):
    words = [f"t{k}" for k in range(100)]
    rows = [(f"a{i:02d}", " ".join(words[:i]) + "\n" + " ".join(words[i:])) for i in range(1, 21)] + [("z", " ".join(words).replace("t50", "u"))]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 210


def test_empty_and_columns(spark):
    df = spark.createDataFrame([], "chunk_id string, chunk_type string, content string, key string, id string, run long")
    assert N.similar(N.source(df)).count() == 0 and N.groups(N.source(df)).count() == 0
    one = spark.createDataFrame([("a", "function", "w " * 80, "k", "i", 1), ("b", "module", "w " * 80, "k", "i", 1), ("c", "method", None, None, None, None)], df.schema)
    assert N.source(one).count() == 1 and N.replication(N.source(one)).agg(F.sum("texts")).first()[0] == 1
