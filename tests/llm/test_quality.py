import random

import numpy as np
import pytest

from symdex.llm import quality as Q

COMMON = "the of and to in is was for that with as it on".split()


def prose(rng):
    return " ".join(" ".join(rng.choice(COMMON if rng.random() < 0.45 else ["table", "index", "ledger", "window", "reader", "file"]) for _ in range(12)).capitalize() + "." for _ in range(rng.choice((2, 6))))


def junk(rng):
    return rng.choice((lambda: "\n".join(f"- [ ] item{rng.randrange(99)}" for _ in range(20)), lambda: "\n".join(f"a{rng.randrange(9)}\t{rng.random():.3f}\tn/a" for _ in range(20)), lambda: " ".join(str(rng.randrange(10**6)) for _ in range(60))))()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    docs = [(i, junk(rng) if i % 4 == 0 else prose(rng)) for i in range(240)] + [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 200_000), (1004, "的 是 在 了。")]
    labels = [(i, "r", "list" if (i % 4 == 0) != (i % 29 == 1) else "prose") for i in range(160)] + [(1, "q", None), (2, "q", "junk"), (999, "q", "prose")]
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_words int, lines string"), spark.createDataFrame(labels, "doc_id long, rater string, label string"), spark.createDataFrame([("en", w, 1) for w in COMMON] + [("zh", "的", 1), (None, None, None)], "lang string, word string, word_rank int")


def test_statistics(spark, tables):
    df = spark.createDataFrame([(1, "The cat is on it.\r\n- one two"), (2, None), (3, "在的x")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in Q.statistics(df, tables[2]).collect()}
    assert (r[1]["n_lines"], r[1]["n_words"]) == (2, 7) and r[1]["end_punct_share"] == 0.5 and r[1]["common_share"] == pytest.approx(4 / 7)
    assert r[2]["n_words"] == 0 and r[2]["mean_word_len"] == 0.0 and r[3]["n_words"] == 3 and r[3]["common_share"] == pytest.approx(1 / 3)


def test_rules_tell_held_out_texts(tables):
    rows = {r["doc_id"]: r["is_prose"] for r in Q.classify(*tables).collect()}
    assert len(rows) == 245 and rows[1000] is None and rows[1002] is None
    held = [(rows[i], i % 4 != 0) for i in range(160, 240)]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_no_labels(tables):
    docs, labels, words = tables
    assert Q.classify(docs, labels.limit(0), words).where("not is_prose").count() == 0
    assert Q.classify(docs.limit(0), labels, words).count() == 0


def test_learner_prunes_noise():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(600), "b": rng.random(600)}
    y = (x["a"] < 0.3) ^ (rng.random(600) < 0.05)
    rules = Q.learn(x, y, np.arange(600) % 3)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= Q.covers(r, x)
    assert (hit == (x["a"] < 0.3)).mean() > 0.95


def test_words_joined_beyond_the_bound(spark, monkeypatch):
    words = spark.createDataFrame([("en", w, 1) for w in COMMON] + [("zh", w, 1) for w in ("的", "我们", "们的", "我们的", "T恤")] + [(None, None, None)], "lang string, word string, word_rank int")
    docs = spark.createDataFrame([(1, "The cat is on it.\n我们的猫和们的T恤 of x\nzzz"), (1, "The cat is on it.\n我们的猫和们的T恤 of x\nzzz"), (2, None), (None, "of the 的"), (3, "")], "doc_id long, text string")
    names = ["doc_id", *Q.FEATURES]
    key = lambda r: str(r)
    plain = sorted((tuple(r) for r in Q.statistics(docs, words).select(names).collect()), key=key)
    monkeypatch.setattr(Q, "MAX_WORDS", 3)
    assert sorted((tuple(r) for r in Q.statistics(docs, words).select(names).collect()), key=key) == plain


def test_found_is_what_classify_tells(tables):
    told = {r["doc_id"] for r in Q.classify(*tables).where("not is_prose").collect()}
    assert {r["doc_id"] for r in Q.found(*tables).collect()} == told and told


def test_lazy_statistics_decide_alike(tables):
    rules = [(Q.Condition("common_share", False, 0.3), Q.Condition("prose_share", False, 0.5)), (Q.Condition("digit_ratio", True, 0.3),)]
    names = Q.named(rules)
    whole = Q._told(Q.statistics(tables[0], tables[2], features=names), rules)
    lazy = Q._told(Q.statistics(tables[0], tables[2], features=names, only_where=Q._needed(rules, "prose_share")), rules)
    told = lambda d: sorted((r["doc_id"], r["is_prose"]) for r in d.collect())
    assert told(whole) == told(lazy) and 0 < whole.where("not is_prose").count() < whole.count()
    assert lazy.where("prose_share is null").count() > 0 and lazy.columns == whole.columns


def test_only_named_statistics(spark, tables):
    made = Q.statistics(tables[0], tables[2], features=("digit_ratio",))
    assert made.columns == ["doc_id", "n_lines", "digit_ratio"] and made.count() == tables[0].count()
