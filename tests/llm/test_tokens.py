import random

import pytest
import tiktoken

from symdex.llm import tokens as T

RANKS = T.load_ranks()
T1 = T.Transducer(RANKS)
ORACLE = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("text", ["Hello world", "it's 12 o'clock\r\n\r\n  x", "日本語 ß é 🙂", "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "=-" * 2000, "é" * 2000, "\n" * 999, "x" * 47 + "日" * 40])
def test_ids_are_the_public_ones(text):
    ids = T1.encode(text)
    assert ids == ORACLE.encode_ordinary(text)
    assert "".join(T1.decode(ids)) == text


def test_random_texts():
    rng = random.Random(7)
    for _ in range(150):
        text = "".join(rng.choice("abcdeinorst " * 3 + "äß日ё_-9") for _ in range(rng.choice((5, 80, 900))))
        assert T1.encode(text) == ORACLE.encode_ordinary(text)


def test_stream_emits_before_the_end():
    seen = []

    def blocks():
        for _ in range(20):
            seen.append(len(out))
            yield b"abcdefgh" * 200

    out = []
    for i in T1.stream(blocks()):
        out.append(i)
    assert seen[-1] > 1000 and out == ORACLE.encode_ordinary("abcdefgh" * 4000)


def test_table(spark):
    df = spark.createDataFrame([(1, None, 9, "k"), (2, "", 9, "k"), (3, "ab", 9, "k"), (3, "ab", 9, "k"), (None, "x", None, None)], "doc_id long, text string, value int, key string")
    got = [(r["doc_id"], list(r["ids"])) for r in T.encode(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, T1.encode("ab")), (3, T1.encode("ab")), (None, T1.encode("x"))], key=str)
    assert T.encode(df.limit(0)).count() == 0
    assert all(r["same"] for r in T.roundtrip(df).collect())
