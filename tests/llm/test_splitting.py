import random

import pytest

from symdex.llm import splitting as S


def check(text, lines=200, chars=8000, overlap=5):
    pieces = S.split_text(text, lines, chars, overlap)
    out = ""
    for i, (a, b, n, at, content) in enumerate(pieces):
        assert len(content) <= chars and len(content[:-1].split("\n")) <= lines
        body = content.split("\n", n)[n] if n else content
        out += ("\n" if i and at == 0 else "") + body
        if n:
            assert content.split("\n")[:n] == text.split("\n")[a : a + n]
    assert out == text
    return pieces


@pytest.mark.parametrize("text", ["a", "\n" * 500, "x" * 50_000, "x\n" * 201, "é" * 8001, "\n".join(["y" * 3000] * 9), "a = [" + "1, " * 9000 + "]"])
def test_covers_the_text(text):
    check(text)


def test_random():
    rng = random.Random(2)
    for _ in range(60):
        check("\n".join("x" * rng.choice((0, 3, 90, 3000, 9000)) for _ in range(rng.choice((1, 5, 300)))) + rng.choice(("", "\n")))


def test_cuts_before_definitions_and_repeats_five_lines():
    text = "\n\n".join(f"def f{i}():\n" + "\n".join(f"    x{j} = {j}" for j in range(37)) for i in range(10))
    pieces = check(text)
    for a, _, n, _, content in pieces[1:]:
        assert n == 5 and content.split("\n")[5].startswith("def f")


def test_table(spark):
    big = "x = 1\r\n" * 300
    df = spark.createDataFrame([("a", big, 10, "p"), ("a", big, 10, "p"), ("b", None, 1, "p"), ("c", "", 1, "p"), ("d", "short", 1, "p"), ("e", big, None, "p"), ("f", "y\n" * 200, 1, "p")], "chunk_id string, content string, start_line int, piece string")
    rows = S.split(df).collect()
    assert {r["chunk_id"] for r in rows} == {"a", "e"} and len({(r["chunk_id"], r["piece"]) for r in rows}) == len(rows)
    assert min(r["start_line"] for r in rows if r["chunk_id"] == "a") == 10 and max(r["end_line"] for r in rows if r["chunk_id"] == "a") == 309
    assert sorted(r[0] for r in S.found(df).collect()) == ["a", "e"]
    assert {r["chunk_id"] for r in S.split(df, only_oversized=False).collect()} == {"a", "d", "e", "f"}
    assert S.split(df.limit(0)).count() == 0
