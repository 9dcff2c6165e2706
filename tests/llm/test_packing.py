import random

from symdex.llm import packing as P


def test_best_fit_takes_the_tightest():
    assert sorted(map(sorted, P.best_fit([6, 5, 4, 3, 2], 10))) == [[0, 2], [1, 3, 4]]
    assert P.best_fit([], 10) == []


def test_containers(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice((0, 1, 30, 400, 700, 1100, 2048, 2049, 9000)) for i in range(400)}
    rows = [(i, None if i == 7 else n, "x", 1) for i, n in sizes.items()] + [(None, 5, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, n int, first string, size int").repartition(6)
    got = P.pack(df, "doc_id", "n", items_per_task=60).collect()
    whole, bins = {}, {}
    for r in got:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["size"]
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["size"]
    assert whole == {i: n for i, n in sizes.items() if n and i != 7}
    assert max(bins.values()) <= 2048 and len(got) == len({(r["doc_id"], r["part"]) for r in got})
    assert all(r["part"] == 0 for r in got if sizes[r["doc_id"]] <= 2048)
    assert len(bins) <= 1.05 * -(-sum(whole.values()) // 2048) + 2


def test_items_that_never_fit_together(spark):
    df = spark.createDataFrame([(i, 1200) for i in range(300)], "doc_id long, n int").repartition(5)
    assert P.pack(df, "doc_id", "n", items_per_task=50).select("bin_id").distinct().count() == 300
    assert P.pack(df.limit(0), "doc_id", "n").count() == 0
